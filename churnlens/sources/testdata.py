"""Views over the driver-generated test tables that give the library's shapes.

The test tables are a TPC-H-like star schema plus text tables; nothing in
them is a code snapshot or a review answer, so these views derive the
library's input tables from them (``analyses``, ``findings``, snapshots,
tags, code lines, an access log, CVE feed rows ...).  Every view reads whole
tables, so its work grows with the data.

Each ``fx_*`` DataFrame has a twin SQL text in ``FIXTURE_SQL`` (DuckDB
dialect) so the oracle can rebuild the same rows independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

NL = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---------------------------------------------------------------------------
# analyses / findings
# ---------------------------------------------------------------------------

def fx_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per order (id, created_at, finished_at, status, source, params)."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    prio = F.col("o_orderpriority")
    duration = F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_orderkey") % 5000 - 200)
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("o_orderkey").alias("analysis_id"),
                    F.col("o_orderdate").alias("created_at"),
                    duration.cast("bigint").alias("duration_s"),
                    F.when(F.col("o_orderstatus") == "F", "completed")
                     .when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
                    F.when(prio == "1-URGENT", "library_auto").when(prio == "2-HIGH", "cve_auto")
                     .when(prio == "3-MEDIUM", "products").when(prio == "4-NOT SPECIFIED", "folder")
                     .otherwise("library").alias("source"),
                    F.when(prio == "3-MEDIUM", F.col("c_mktsegment")).alias("product"),
                    F.when(prio.isin("1-URGENT", "2-HIGH", "5-LOW"), F.col("n_name")).alias("repo_name"))
            .withColumn("finished_at", F.when(F.col("duration_s").isNotNull(),
                                              F.col("created_at") + F.make_interval(secs=F.col("duration_s")))))


def _finding_filename() -> Column:
    ext = (F.when(F.col("l_partkey") % 8 == 0, ".php").when(F.col("l_partkey") % 8 == 1, ".js")
           .when(F.col("l_partkey") % 8 == 2, ".py").when(F.col("l_partkey") % 8 == 3, ".C")
           .when(F.col("l_partkey") % 8 == 4, ".tsx").when(F.col("l_partkey") % 8 == 5, ".rb")
           .when(F.col("l_partkey") % 8 == 6, ".min.js").otherwise(".txt"))
    return F.concat(F.lit("src/m"), _s("l_partkey"), F.lit("/s"), _s("l_suppkey"), F.lit("_"),
                    _s("l_linenumber"), ext)


def _finding_response() -> Column:
    qty = _s(F.col("l_quantity").cast("int"))
    head = (F.when(F.col("l_returnflag") == "A",
                   F.concat(F.lit("Vulnerability Existed: yes" + NL + "CWE-"), qty, F.lit(": "), F.col("p_name"),
                            F.lit(" weakness - src/f.php ["), _s("l_linenumber"), F.lit("]")))
            .when(F.col("l_returnflag") == "R",
                  F.concat(F.lit("Vulnerability Existed: not sure" + NL + "CWE-0"), qty, F.lit(" - "),
                           F.col("p_type"), F.lit(" issue")))
            .otherwise(F.lit("Vulnerability Existed: no")))
    tail = F.when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"),
                  F.concat(F.lit(NL + "Vulnerability Existed: YES (medium)" + NL + "CWE-"),
                           _s(F.col("l_partkey") % 200), F.lit(" - "), F.col("p_type"), F.lit(" issue"))
                  ).otherwise(F.lit(""))
    return F.concat(head, tail)


def fx_finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (analysis_id, filename, ai_response, ...) rows, one per line item."""
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_orderkey").alias("analysis_id"), _finding_filename().alias("filename"),
                    _finding_response().alias("ai_response"),
                    F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_linestatus")))


def fx_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings keyed by (analysis_id, filename): the raw rows de-duplicated."""
    return (fx_finding_rows(spark, sf_dir)
            .groupBy("analysis_id", "filename").agg(F.max("ai_response").alias("ai_response")))


def fx_cve_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CVE questions asked about findings, with the model's answer text.

    One row per line item; the CVE id is derived from the part, the answer
    from the line status and flag.
    """
    li = table(spark, sf_dir, "lineitem")
    answer = (F.when(F.col("l_returnflag") == "A", F.lit("Analysis:" + NL + "Description Matches: YES"))
              .when(F.col("l_linestatus") == "F", F.lit("  match: no  " + NL + "matches: yes"))
              .otherwise(F.lit("No decision")))
    return (li.select(F.col("l_orderkey").alias("analysis_id"), _finding_filename().alias("filename"),
                      F.concat(F.lit("CVE-"), _s(1995 + F.col("l_partkey") % 7), F.lit("-"),
                               _s(F.col("l_partkey") + 10000)).alias("cve_id"),
                      answer.alias("answer")))


# ---------------------------------------------------------------------------
# snapshots, tags, code, access log
# ---------------------------------------------------------------------------

def _doc_path() -> Column:
    ext = (F.when(F.col("lang") == "en", ".php").when(F.col("lang") == "fr", ".js")
           .when(F.col("lang") == "de", ".py").otherwise(".c"))
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), _s("doc_id"), ext)


def fx_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of one tree per language: (repo, version, path, content)."""
    d = table(spark, sf_dir, "documents")
    old = (d.where(F.col("doc_id") % 10 != 3)
           .select(F.lit("old").alias("version"), _doc_path().alias("path"), F.col("text").alias("content"), F.col("lang").alias("repo")))
    new = (d.where(F.col("doc_id") % 10 != 2)
           .select(F.lit("new").alias("version"), _doc_path().alias("path"),
                   F.when(F.col("doc_id") % 3 == 1, F.replace(F.col("text"), F.lit(" the "), F.lit(" teh ")))
                    .otherwise(F.col("text")).alias("content"), F.col("lang").alias("repo")))
    return old.unionByName(new)


def fx_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three releases of one tree per language; most files are the same in two or all of them."""
    d = table(spark, sf_dir, "documents")
    k, text = F.col("doc_id"), F.col("text")
    mended = F.when(k % 3 == 1, F.replace(text, F.lit(" the "), F.lit(" teh "))).otherwise(text)
    release = lambda version, left_out, content: F.when(k % 10 != left_out, F.struct(F.lit(version).alias("version"), content.alias("content")))
    releases = F.array(release("1.0", 3, text), release("1.1", 2, mended),
                       release("2.0", 4, F.when(k % 7 == 0, F.concat(mended, F.lit("\nQx"))).otherwise(mended)))
    return (d.select(F.col("lang").alias("repo"), _doc_path().alias("path"), F.explode(F.array_compact(releases)).alias("r"))
            .select("repo", "r.version", "path", "r.content"))


def fx_tree_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of the trees' repositories; one of them has tagged two releases only."""
    langs = table(spark, sf_dir, "documents").select(F.col("lang").alias("repo")).distinct()
    tags = F.when(F.col("repo") == "es", F.array(F.lit("1.0"), F.lit("1.1"))).otherwise(F.array(F.lit("1.0"), F.lit("1.1"), F.lit("2.0")))
    return langs.select("repo", F.explode(tags).alias("tag"))


def fx_library_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seen and the next release of each library, made from the documents of the source with its number."""
    d = table(spark, sf_dir, "documents").withColumn("id", F.regexp_extract("source", "[0-9]+$", 0))
    lib = fx_library(spark, sf_dir).select("id", "repo_url", "last_version")
    k, text = F.col("doc_id"), F.col("text")
    old = F.when(k % 10 != 3, F.struct(F.col("last_version").alias("version"), text.alias("content")))
    new = F.when(k % 10 != 2, F.struct(F.lit("next").alias("version"),
                                       F.when(k % 3 == 1, F.replace(text, F.lit(" the "), F.lit(" teh "))).otherwise(text).alias("content")))
    return (d.join(lib, "id").select(F.col("repo_url").alias("repo"), _doc_path().alias("path"), F.explode(F.array_compact(F.array(old, new))).alias("r"))
            .select("repo", "r.version", "path", "r.content"))


def fx_module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files of two folder levels: a third of them above all others."""
    # keys without copies give rows without copies: each key has its own text
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    s = F.col("l_suppkey")
    path = F.concat(F.lit("lib/"), F.when(s % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), _s(s % 5), F.lit("/"))), F.lit("s"), _s(s), F.lit(".php"))
    line = F.concat(F.lit("function fn_"), _s("l_partkey"), F.lit("() { return fn_"), _s(F.col("l_partkey") * 7 % 997), F.lit("($x) + strlen($y); }"))
    return li.select(F.lit("code").alias("repo"), F.lit("new").alias("version"), path.alias("path"), line.alias("content"))


def fx_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release tags per repository: (repo, tag, published_at)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    tag = F.concat(F.when(eid % 2 == 0, F.lit("v")).otherwise(F.lit("")), _s(eid % 4), F.lit("."), _s(eid % 13),
                   F.when(eid % 3 == 0, F.concat(F.lit("_"), _s(eid % 11)))
                    .when(eid % 3 == 1, F.concat(F.lit("-"), _s(eid % 5))).otherwise(F.lit("")))
    return e.select(F.col("user_id").alias("repo"), tag.alias("tag"), F.col("ts").alias("published_at"))


def fx_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line PHP functions with one user call and one builtin call."""
    # keys without copies give lines without copies: each key has its own text
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.concat(F.lit("src/s"), _s("l_suppkey"), F.lit(".php")).alias("path"),
                     F.concat(F.lit("fn_"), _s("l_partkey")).alias("caller"),
                     F.concat(F.lit("function fn_"), _s("l_partkey"), F.lit("() { return fn_"),
                              _s(F.col("l_partkey") * 7 % 997), F.lit("($x) + strlen($y); }")).alias("line"))


def fx_code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files as (repo, version, path, content); each one-line function is its own chunk of the file."""
    return fx_code_lines(spark, sf_dir).select(F.lit("code").alias("repo"), F.lit("new").alias("version"), "path",
                                               F.col("line").alias("content"))


def fx_code_diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added diff lines of the code files: every function."""
    return (fx_code_lines(spark, sf_dir)
            .select(F.lit("code").alias("repo"), F.lit("new").alias("version"), "path",
                    F.concat(F.lit("+"), F.col("line")).alias("line")))


def fx_cves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known CVEs: one per part, keyed to a CPE name."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.concat(F.lit("CVE-"), _s(1995 + k % 7), F.lit("-"), _s(k + 10000)).alias("cve_id"),
        F.when(k % 11 == 0, F.lit("")).otherwise(
            F.concat(F.col("p_name"), F.lit(" allows "), F.lower("p_type"), F.lit(" &amp; more"))).alias("description"),
        F.concat(F.lit("cpe:2.3:a:org:lib"), _s(k % 50), F.lit(":"), _s(F.col("p_size") % 3), F.lit(":"),
                 _s(F.col("p_size") % 7)).alias("cpe_name"))


def fx_release_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with release-time tags appended, built from the event of the same id."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("page_id"), "ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    m = F.col("page_id") % 4
    tag = (F.when(m == 0, F.concat(F.lit('<relative-time class="no-wrap" threshold="P30D" datetime="2000-01-01T00:00:00Z">'),
                                   F.lit('<relative-time class="no-wrap" datetime="'), iso, F.lit('Z">')))
           .when(m == 1, F.concat(F.lit('<relative-time class="no-wrap x" datetime="'), iso, F.lit('Z">'),
                                  F.lit('<relative-time datetime="'), plain, F.lit(' UTC" class="no-wrap">')))
           .when(m == 2, F.concat(F.lit('<relative-time class="no-wrap" datetime="'), iso, F.lit('+02:00">')))
           .otherwise(F.lit('<relative-time class="no-wrap" datetime="soon">')))
    return p.join(e, "page_id", "left").select("page_id", F.concat("html", F.coalesce(tag, F.lit(""))).alias("html"))


def fx_nvd_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NVD 2.0 response per event: two CVEs with varied descriptions and date layouts."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    k = F.col("event_id")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    pub = (F.when(k % 6 == 0, F.concat(base, F.lit(".000"))).when(k % 6 == 1, F.concat(base, F.lit(".000Z")))
           .when(k % 6 == 2, F.concat(base, F.lit("Z"))).when(k % 6 == 3, base)
           .when(k % 6 == 4, F.concat(base, F.lit(".000-05:00"))).otherwise(F.concat(base, F.lit("+01:00"))))
    mod = F.when(k % 5 == 0, F.lit("")).when(k % 5 == 1, F.lit("not a date")).otherwise(F.concat(base, F.lit("Z")))
    descs = (F.when(k % 3 == 0, F.concat(F.lit('[{"lang":"es","value":"evento '), F.col("event_type"),
                                         F.lit('"},{"lang":"en","value":"event '), F.col("event_type"), F.lit('"}]')))
             .when(k % 3 == 1, F.concat(F.lit('[{"lang":"fr","value":"type '), F.col("event_type"),
                                        F.lit('"},{"lang":"en","value":""}]')))
             .otherwise(F.lit("[]")))
    cve = lambda n, d, p, m_: F.concat(F.lit('{"cve":{"id":"CVE-2024-'), _s(k * 2 + n), F.lit('","descriptions":'), d,
                                        F.lit(',"published":"'), p, F.lit('","lastModified":"'), m_, F.lit('"}}'))
    json = F.concat(F.lit('{"resultsPerPage":2,"startIndex":0,"totalResults":2,"vulnerabilities":['),
                    cve(0, descs, pub, mod), F.lit(","), cve(1, F.lit('[{"lang":"en","value":"second"}]'), base, base),
                    F.lit("]}"))
    return e.select("event_id", json.alias("json"))


def fx_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-service replies: each conversation turn wrapped in one of three envelopes."""
    c = table(spark, sf_dir, "conversations")
    # the JSON-escaped text: to_json gives {"v":"..."}; keep what follows '{"v":' without the final '}'
    inner = F.expr("substring(to_json(named_struct('v', text)), 6, length(to_json(named_struct('v', text))) - 6)")
    k = (F.col("conv_id") + F.col("turn")) % 4
    body = (F.when(k == 0, F.concat(F.lit('{"model":"m","response":'), inner, F.lit("}")))
            .when(k == 1, F.concat(F.lit('{"choices":[{"message":{"role":"assistant","content":'), inner, F.lit("}}]}")))
            .when(k == 2, F.concat(F.lit('{"content":[{"type":"text","text":'), inner, F.lit("}]}")))
            .otherwise(F.lit('{"error":"overloaded"}')))
    return c.select("conv_id", "turn", "text", body.alias("body"))


def fx_document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of analysis documents: created (running), then finished (final status)."""
    a = fx_analyses(spark, sf_dir)
    first = a.select("analysis_id", F.lit("running").alias("status"), "source", F.col("created_at").alias("modified_at"),
                     F.lit(1).alias("revision"))
    final = (a.where(F.col("finished_at").isNotNull())
             .select("analysis_id", "status", "source", F.col("finished_at").alias("modified_at"), F.lit(2).alias("revision")))
    return first.unionByName(final)


def fx_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache access log; user_id doubles as the client id for throttling."""
    e = table(spark, sf_dir, "events")
    kind = (F.when(F.col("event_type") == "view", "hit").when(F.col("event_type") == "click", "miss")
            .when(F.col("event_type") == "purchase", "download").otherwise("other"))
    return e.select("ts", "user_id", kind.alias("kind"), "value", "event_id")


def fx_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored library repositories, one per supplier."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        _s(k).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("https://github.com/org"), _s(k % 10), F.lit("/lib"), _s(k)).alias("repo_url"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("cpe:2.3:a:org:lib"), _s(k % 50))).alias("cpe"),
        F.concat(_s(k % 3), F.lit("-"), _s(k % 7)).alias("last_version"),
        (k % 2 == 0).alias("auto_scan"),
        F.when(k % 3 == 0, F.lit(None).cast("timestamp"))
         .otherwise(F.timestamp_seconds(F.lit(1704067200) + k * 3600)).alias("last_checked"))


def fx_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured products: one per market segment."""
    return (table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("product")).distinct()
            .withColumn("repo_url", F.concat(F.lit("https://github.com/products/"), F.lower("product"))))


# ---------------------------------------------------------------------------
# The same views in DuckDB SQL (oracle side).
# ---------------------------------------------------------------------------

FIXTURE_SQL = {
    "fx_analyses": """
SELECT o_orderkey AS analysis_id, o_orderdate AS created_at,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5000 - 200 END AS BIGINT) AS duration_s,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'library_auto' WHEN '2-HIGH' THEN 'cve_auto' WHEN '3-MEDIUM' THEN 'products'
       WHEN '4-NOT SPECIFIED' THEN 'folder' ELSE 'library' END AS source,
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN c_mktsegment END AS product,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','5-LOW') THEN n_name END AS repo_name,
  o_orderdate + to_seconds(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5000 - 200 END) AS finished_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_finding_rows": """
SELECT l_orderkey AS analysis_id,
  'src/m' || l_partkey || '/s' || l_suppkey || '_' || l_linenumber || CASE l_partkey % 8 WHEN 0 THEN '.php' WHEN 1 THEN '.js'
    WHEN 2 THEN '.py' WHEN 3 THEN '.C' WHEN 4 THEN '.tsx' WHEN 5 THEN '.rb' WHEN 6 THEN '.min.js' ELSE '.txt' END AS filename,
  CASE l_returnflag
    WHEN 'A' THEN 'Vulnerability Existed: yes' || chr(10) || 'CWE-' || CAST(l_quantity AS INT) || ': ' || p_name || ' weakness - src/f.php [' || l_linenumber || ']'
    WHEN 'R' THEN 'Vulnerability Existed: not sure' || chr(10) || 'CWE-0' || CAST(l_quantity AS INT) || ' - ' || p_type || ' issue'
    ELSE 'Vulnerability Existed: no' END
  || CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN chr(10) || 'Vulnerability Existed: YES (medium)' || chr(10)
       || 'CWE-' || (l_partkey % 200) || ' - ' || p_type || ' issue' ELSE '' END AS ai_response,
  l_partkey, l_suppkey, l_linenumber, l_linestatus
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_findings": """
SELECT analysis_id, filename, max(ai_response) AS ai_response FROM fx_finding_rows GROUP BY analysis_id, filename""",
    "fx_cve_checks": """
SELECT l_orderkey AS analysis_id,
  'src/m' || l_partkey || '/s' || l_suppkey || '_' || l_linenumber || CASE l_partkey % 8 WHEN 0 THEN '.php' WHEN 1 THEN '.js'
    WHEN 2 THEN '.py' WHEN 3 THEN '.C' WHEN 4 THEN '.tsx' WHEN 5 THEN '.rb' WHEN 6 THEN '.min.js' ELSE '.txt' END AS filename,
  'CVE-' || (1995 + l_partkey % 7) || '-' || (l_partkey + 10000) AS cve_id,
  CASE WHEN l_returnflag = 'A' THEN 'Analysis:' || chr(10) || 'Description Matches: YES'
       WHEN l_linestatus = 'F' THEN '  match: no  ' || chr(10) || 'matches: yes'
       ELSE 'No decision' END AS answer
FROM lineitem""",
    "fx_snapshots": """
SELECT 'old' AS version, source || '/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.php' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.py' ELSE '.c' END AS path,
  text AS content, lang AS repo FROM documents WHERE doc_id % 10 <> 3
UNION ALL
SELECT 'new', source || '/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.php' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.py' ELSE '.c' END,
  CASE WHEN doc_id % 3 = 1 THEN replace(text, ' the ', ' teh ') ELSE text END, lang FROM documents WHERE doc_id % 10 <> 2""",
    "fx_trees": """
SELECT lang AS repo, version, path, content FROM (
  SELECT *, source || '/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.php' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.py' ELSE '.c' END AS path,
         CASE WHEN doc_id % 3 = 1 THEN replace(text, ' the ', ' teh ') ELSE text END AS mended FROM documents),
  LATERAL (SELECT '1.0' AS version, text AS content WHERE doc_id % 10 <> 3
           UNION ALL SELECT '1.1', mended WHERE doc_id % 10 <> 2
           UNION ALL SELECT '2.0', CASE WHEN doc_id % 7 = 0 THEN mended || chr(10) || 'Qx' ELSE mended END WHERE doc_id % 10 <> 4)""",
    "fx_tree_tags": """
SELECT repo, tag FROM (SELECT DISTINCT lang AS repo FROM documents), (VALUES ('1.0'), ('1.1'), ('2.0')) t(tag)
WHERE NOT (repo = 'es' AND tag = '2.0')""",
    "fx_library_trees": """
SELECT l.repo_url AS repo, r.version, d.path, r.content FROM (
  SELECT *, source || '/' || lang || '/d' || doc_id || CASE lang WHEN 'en' THEN '.php' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.py' ELSE '.c' END AS path,
         CASE WHEN doc_id % 3 = 1 THEN replace(text, ' the ', ' teh ') ELSE text END AS mended FROM documents) d
  JOIN fx_library l ON l.id = regexp_extract(d.source, '[0-9]+$'),
  LATERAL (SELECT l.last_version AS version, d.text AS content WHERE d.doc_id % 10 <> 3
           UNION ALL SELECT 'next', d.mended WHERE d.doc_id % 10 <> 2) r""",
    "fx_module_files": """
SELECT DISTINCT 'lib/' || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'm' || (l_suppkey % 5) || '/' END || 's' || l_suppkey || '.php' AS path,
  'function fn_' || l_partkey || '() { return fn_' || (l_partkey * 7 % 997) || '($x) + strlen($y); }' AS line FROM lineitem""",
    "fx_tags": """
SELECT user_id AS repo, CASE WHEN event_id % 2 = 0 THEN 'v' ELSE '' END || (event_id % 4) || '.' || (event_id % 13)
  || CASE event_id % 3 WHEN 0 THEN '_' || (event_id % 11) WHEN 1 THEN '-' || (event_id % 5) ELSE '' END AS tag,
  ts AS published_at FROM events""",
    "fx_code_lines": """
SELECT DISTINCT 'src/s' || l_suppkey || '.php' AS path, 'fn_' || l_partkey AS caller,
  'function fn_' || l_partkey || '() { return fn_' || (l_partkey * 7 % 997) || '($x) + strlen($y); }' AS line FROM lineitem""",
    "fx_library": """
SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'https://github.com/org' || (s_suppkey % 10) || '/lib' || s_suppkey AS repo_url,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'cpe:2.3:a:org:lib' || (s_suppkey % 50) END AS cpe,
  (s_suppkey % 3) || '-' || (s_suppkey % 7) AS last_version, s_suppkey % 2 = 0 AS auto_scan,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE to_timestamp(1704067200 + s_suppkey * 3600) END AS last_checked FROM supplier""",
    "fx_products": """
SELECT product, 'https://github.com/products/' || lower(product) AS repo_url FROM (SELECT DISTINCT c_mktsegment AS product FROM customer)""",
    "fx_cves": """
SELECT 'CVE-' || (1995 + p_partkey % 7) || '-' || (p_partkey + 10000) AS cve_id,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || ' allows ' || lower(p_type) || ' &amp; more' END AS description,
  'cpe:2.3:a:org:lib' || (p_partkey % 50) || ':' || (p_size % 3) || ':' || (p_size % 7) AS cpe_name
FROM part""",
    "fx_release_pages": """
SELECT p.page_id, p.html || coalesce(CASE p.page_id % 4
  WHEN 0 THEN '<relative-time class="no-wrap" threshold="P30D" datetime="2000-01-01T00:00:00Z"><relative-time class="no-wrap" datetime="' || strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z">'
  WHEN 1 THEN '<relative-time class="no-wrap x" datetime="' || strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || 'Z"><relative-time datetime="' || strftime(e.ts, '%Y-%m-%d %H:%M:%S') || ' UTC" class="no-wrap">'
  WHEN 2 THEN '<relative-time class="no-wrap" datetime="' || strftime(e.ts, '%Y-%m-%dT%H:%M:%S') || '+02:00">'
  ELSE '<relative-time class="no-wrap" datetime="soon">' END, '') AS html, e.ts AS event_ts
FROM pages p LEFT JOIN events e ON e.event_id = p.page_id""",
    "fx_document_log": """
SELECT analysis_id, 'running' AS status, source, created_at AS modified_at, 1 AS revision FROM fx_analyses
UNION ALL
SELECT analysis_id, status, source, finished_at, 2 FROM fx_analyses WHERE finished_at IS NOT NULL""",
    "fx_access": """
SELECT ts, user_id, CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss' WHEN 'purchase' THEN 'download' ELSE 'other' END AS kind,
  value, event_id FROM events""",
}

# Dependencies between fixture views (for building a WITH clause).
_FIXTURE_DEPS = {"fx_findings": ["fx_finding_rows"], "fx_library_trees": ["fx_library"], "fx_document_log": ["fx_analyses"]}


def with_fixtures(sql: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix an oracle query with the fixture views it names (and extra CTEs)."""
    ordered: list[str] = []

    def add(n):
        for d in _FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({FIXTURE_SQL[n]})" for n in ordered]
    parts += [f"{n} AS ({q})" for n, q in (ctes or [])]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql
