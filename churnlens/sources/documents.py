"""Analysis documents and dimension files.

An analysis document is one JSON object per file (``<uuid>.json``).  The
reader uses an explicit schema (no inference pass over the corpus), keeps
the file name from ``_metadata`` (the id is the stem), and drops files that
do not parse or whose stem is not a UUID, like the reference.  ``params`` is
kept both as a typed struct of the known keys and as raw JSON text so that
key presence and value types stay testable (Q5, Q6).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.cwe import extract_labels, normalize_id
from churnlens.functions.paths import UUID_PATTERN, basename, valid_repo_url
from churnlens.functions.text import clean_input

CVE_MATCH = T.StructType([T.StructField("result", T.StringType()), T.StructField("description", T.StringType())])
RESULT = T.StructType([
    T.StructField("context", T.ArrayType(T.StringType())),
    T.StructField("ai_response", T.StringType()),
    T.StructField("vulnerability_status", T.StringType()),
    T.StructField("vulnerability_status_normalized", T.StringType()),
    T.StructField("vuln_severity", T.StringType()),
    T.StructField("cwe", T.ArrayType(T.StringType())),
    T.StructField("cve_matches", T.MapType(T.StringType(), CVE_MATCH)),
])
META = T.StructType([
    T.StructField("created_at", T.StringType()), T.StructField("finished_at", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("ai_enabled", T.BooleanType()),
    T.StructField("ai_service", T.StringType()), T.StructField("ai_model", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType()),
    T.StructField("params", T.StringType()),   # raw JSON text of the dynamic parameter map
])
ANALYSIS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("meta", META),
    T.StructField("results", T.MapType(T.StringType(), RESULT)),
    T.StructField("vuln_count", T.LongType()),
    T.StructField("vulnerability_types", T.ArrayType(T.StructType([T.StructField("type", T.StringType()),
                                                                    T.StructField("count", T.LongType())]))),
    T.StructField("cve_writeups", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt", T.StringType()),
])
KNOWN_PARAMS = ["product", "repo_name", "repo_url", "old_version", "new_version", "old_folder", "new_folder",
                "extension", "special_keywords", "cve_ids", "cpe", "bulk_total"]


def parse_time(c) -> Column:
    """RFC 3339 text with offset (fractional seconds optional) -> timestamp; zero time -> null."""
    t = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")),
                   F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]")))
    return F.when(t < F.lit("0002-01-01").cast("timestamp"), F.lit(None)).otherwise(t)


def read_documents(spark: SparkSession, path: str, modified_after=None) -> DataFrame:
    """S06 (+S16): analysis documents under ``path``; optionally only files newer than a mark."""
    df = (spark.read.schema(ANALYSIS).option("multiLine", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt").option("pathGlobFilter", "*.json")
          .option("recursiveFileLookup", True).json(path)
          .select("*", F.col("_metadata.file_name").alias("_file"),
                  F.col("_metadata.file_modification_time").alias("modified_at")))
    stem = F.regexp_replace("_file", r"\.json$", "")
    # meta is referenced too: Spark refuses plans that read only the corrupt-record column (e.g. count())
    df = (df.where(F.col("_corrupt").isNull() & F.col("meta").isNotNull() & stem.rlike(UUID_PATTERN))
          .withColumn("analysis_id", stem))
    if modified_after is not None:
        df = df.where(F.col("modified_at") > F.lit(modified_after).cast("timestamp"))
    return df.drop("_corrupt", "_file")


def analysis_by_id(analyses: DataFrame, analysis_id: str) -> DataFrame:
    """One analysis by id; an id that is not a UUID is an error (checked before any scan).

    The filter is on a plain column, so it reaches the Parquet scan as a
    pushed predicate (row-group min/max pruning) when analyses are stored.
    """
    import re
    if not re.match(UUID_PATTERN, analysis_id or ""):
        raise ValueError(f"invalid analysis id: {analysis_id!r}")
    return analyses.where(F.col("analysis_id") == analysis_id)


#: Bytes of a row group of the lookup table: what one lookup reads at least.
LOOKUP_GROUP = 1 << 20


def write_lookup(analyses: DataFrame, path: str, mode: str = "overwrite", group_bytes: int = LOOKUP_GROUP) -> None:
    """Analyses clustered by id, so that a lookup reads one row group whatever the number of days or files.

    Files hold ranges of ids and are sorted, so the footers' minima and maxima leave one row group or two; ids that
    are not there are mostly ruled out by the column's Bloom filter.
    """
    (analyses.repartitionByRange("analysis_id").sortWithinPartitions("analysis_id").write.mode(mode)
     .option("parquet.block.size", group_bytes).option("parquet.bloom.filter.enabled#analysis_id", "true").parquet(path))


def parse_documents(texts: DataFrame, json_col: str = "json", id_col: str = "analysis_id") -> DataFrame:
    """S06 for documents held as text (e.g. a message stream); unparsable ones are dropped.

    Each text is parsed once: the document is a generated row, so the filter and the fields read its columns; on a
    plain column each of them would parse the text again.
    """
    keep = [c for c in texts.columns if c != json_col]
    parsed = F.from_json(F.col(json_col), ANALYSIS, {"mode": "PERMISSIVE"})
    fields = ["meta", "results", "vuln_count", "vulnerability_types", "cve_writeups"]
    return (texts.select(*keep, F.explode(F.array(parsed)).alias("_d")).where(F.col("_d.meta").isNotNull())
            .select(*keep, *[f"_d.{c}" for c in fields]))


def _params_variant() -> Column:
    return F.try_parse_json(F.col("meta.params"))


def _param(name: str) -> Column:
    """Typed string parameter: null when absent or not a JSON string (Q5)."""
    elem = F.try_variant_get(_params_variant(), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(elem) == "STRING", F.try_variant_get(_params_variant(), f"$.{name}", "string"))


def has_param(name: str) -> Column:
    """Key presence in the dynamic parameter map, whatever the value, JSON null included (Q6)."""
    return F.try_variant_get(_params_variant(), f"$.{name}", "variant").isNotNull()


def analyses_table(docs: DataFrame) -> DataFrame:
    """One row per analysis with meta flattened and the known parameters typed."""
    return docs.select("analysis_id",
                       parse_time(F.col("meta.created_at")).alias("created_at"),
                       parse_time(F.col("meta.finished_at")).alias("finished_at"),
                       F.col("meta.status").alias("status"), F.col("meta.source").alias("source"),
                       F.col("meta.ai_enabled").alias("ai_enabled"), F.col("meta.error").alias("error"),
                       *[_param(p).alias(p) for p in KNOWN_PARAMS],
                       has_param("product").alias("has_product"),
                       F.col("meta.params").alias("params_json"),
                       *([F.col("modified_at")] if "modified_at" in docs.columns else []))


def findings_table(docs: DataFrame) -> DataFrame:
    """``results`` exploded: one row per (analysis, filename)."""
    return (docs.select("analysis_id", F.explode("results").alias("filename", "r"))
            .select("analysis_id", "filename", "r.context", "r.ai_response", "r.vulnerability_status",
                    F.col("r.vulnerability_status_normalized").alias("status_normalized"), "r.vuln_severity",
                    F.coalesce(F.col("r.cwe"), F.array().cast("array<string>")).alias("cwe"), "r.cve_matches"))


def finding_cves(findings: DataFrame) -> DataFrame:
    """CVE checks of each finding: one row per (analysis, filename, cve_id)."""
    return (findings.select("analysis_id", "filename", F.explode("cve_matches").alias("cve_id", "m"))
            .select("analysis_id", "filename", "cve_id", "m.result", "m.description"))


def product_info(analyses: DataFrame) -> DataFrame:
    """F19 (summaries): product -> repo_name -> basename(old_folder) -> basename(new_folder).

    Versions come from old_version/new_version, replaced by the folders when
    the product name had to come from the folders.
    """
    p0 = F.coalesce(F.col("product"), F.lit(""))
    p1 = F.when(p0 != "", p0).otherwise(F.coalesce(F.col("repo_name"), F.lit("")))
    from_folders = p1 == ""
    of, nf = F.col("old_folder"), F.col("new_folder")
    def base(c):   # like a path base name: trailing slashes ignored
        return basename(F.regexp_replace(c, "/+$", ""))
    product = (F.when(~from_folders, p1)
               .when(of.isNotNull(), base(of))
               .when(nf.isNotNull(), base(nf)).otherwise(F.lit("")))
    old_v = F.when(from_folders & of.isNotNull(), of).otherwise(F.coalesce(F.col("old_version"), F.lit("")))
    new_v = F.when(from_folders & nf.isNotNull(), nf).otherwise(F.coalesce(F.col("new_version"), F.lit("")))
    return analyses.select("analysis_id", product.alias("product_name"), old_v.alias("old_version"),
                           new_v.alias("new_version"))


def _string_at(v: Column, path: str) -> Column:
    """The value at ``path`` when it is a JSON string, else null (no coercion of numbers)."""
    e = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(v, path, "string"))


def ingest_payload(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """Lenient copy of an external result payload.

    Only JSON strings are taken (other value types are skipped, as are
    non-string context lines); CWE labels are derived from the answer
    (status and severity are not); the source is cleaned and cut to 20 bytes.
    """
    keep = [c for c in payloads.columns if c != json_col]
    v = F.try_parse_json(F.col(json_col))
    results = F.coalesce(F.try_variant_get(v, "$.results", "map<string,variant>"),
                         F.create_map().cast("map<string,variant>"))
    enable = F.when(F.schema_of_variant(F.try_variant_get(v, "$.enable_ai", "variant")) == "BOOLEAN",
                    F.try_variant_get(v, "$.enable_ai", "boolean")).otherwise(F.lit(False))
    rows = payloads.select(*keep, clean_input(_string_at(v, "$.source"), 20).alias("source"), enable.alias("ai_enabled"),
                           F.explode(results).alias("filename", "r"))
    ctx = F.coalesce(F.try_variant_get(F.col("r"), "$.context", "array<variant>"), F.array().cast("array<variant>"))
    context = F.filter(F.transform(ctx, lambda x: F.when(F.schema_of_variant(x) == "STRING",
                                                          F.try_variant_get(x, "$", "string"))),
                       lambda x: x.isNotNull())
    resp = F.coalesce(_string_at(F.col("r"), "$.ai_response"), F.lit(""))
    return rows.select(*keep, "source", "ai_enabled", "filename", context.alias("context"), resp.alias("ai_response"),
                       F.coalesce(_string_at(F.col("r"), "$.vulnerability_status"), F.lit("")).alias("vulnerability_status"),
                       F.coalesce(_string_at(F.col("r"), "$.vuln_severity"), F.lit("")).alias("vuln_severity"),
                       extract_labels(resp).alias("cwe"))


def write_analyses(analyses: DataFrame, path: str, mode: str = "append", period: str = "day") -> None:
    """Analyses sink, partitioned by creation day (or month).

    A period's rows are brought together first, so that it has few files; a large one stays in several.
    """
    key = F.to_date("created_at") if period == "day" else F.date_format("created_at", "yyyy-MM")
    (analyses.withColumn(f"created_{period}", key).hint("rebalance", f"created_{period}")
     .write.mode(mode).partitionBy(f"created_{period}").parquet(path))


def mark_failed(analyses: DataFrame, ids: DataFrame, error_col: str = "error") -> DataFrame:
    """Status 'failed' and the error text for the given analysis ids (id, error)."""
    e = ids.select("analysis_id", F.col(error_col).alias("_err"))
    out = analyses.join(e, "analysis_id", "left")
    return (out.withColumn("status", F.when(F.col("_err").isNotNull(), F.lit("failed")).otherwise(F.col("status")))
            .withColumn("error", F.coalesce(F.col("_err"), F.col("error"))).drop("_err"))


# --------------------------------------------------------------------------- S11, S12, P19

PRODUCT = T.StructType([T.StructField("repo_url", T.StringType()),
                        T.StructField("versions", T.ArrayType(T.StringType()))])
LIBRARY = T.StructType([T.StructField(n, t) for n, t in [
    ("id", T.StringType()), ("name", T.StringType()), ("repo_url", T.StringType()), ("ai_service", T.StringType()),
    ("cpe", T.StringType()), ("created_at", T.StringType()), ("last_checked", T.StringType()),
    ("last_version", T.StringType()), ("auto_scan", T.BooleanType())]])


def products_from_json(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """A name -> {repo_url, versions} map document; missing or bad -> no rows."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), PRODUCT))
    return (texts.select(F.explode(F.coalesce(m, F.create_map().cast(T.MapType(T.StringType(), PRODUCT))))
                         .alias("product", "p"))
            .select("product", "p.repo_url", F.coalesce("p.versions", F.array().cast("array<string>")).alias("versions")))


def resolve_products(analyses: DataFrame, products: DataFrame) -> DataFrame:
    """Product analyses with the repository of their product; an unknown product gives no row."""
    return analyses.where(F.col("product").isNotNull()).join(products.select("product", "repo_url"), "product")


def library_from_json(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """The library array document; missing or bad -> no rows."""
    arr = F.from_json(F.col(json_col), T.ArrayType(LIBRARY))
    return texts.select(F.explode(F.coalesce(arr, F.array().cast(T.ArrayType(LIBRARY)))).alias("l")).select("l.*")


def library_add(library: DataFrame, new: DataFrame) -> DataFrame:
    """S12 add: entries whose name is not already present are appended (anti-join + union)."""
    fresh = new.join(library.select("name"), "name", "left_anti")
    return library.unionByName(fresh, allowMissingColumns=True)


def library_remove(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id"), "id", "left_anti")


def library_toggle(library: DataFrame, ids: DataFrame) -> DataFrame:
    t = ids.select("id", F.lit(True).alias("_t"))
    return (library.join(t, "id", "left")
            .withColumn("auto_scan", F.when(F.col("_t"), ~F.coalesce(F.col("auto_scan"), F.lit(False)))
                        .otherwise(F.col("auto_scan"))).drop("_t"))


def auto_scan_candidates(library: DataFrame) -> DataFrame:
    """Libraries with auto-scan on and a valid repository URL."""
    return library.where(F.coalesce(F.col("auto_scan"), F.lit(False)) & valid_repo_url("repo_url"))


# --------------------------------------------------------------------------- S14

def cwe_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(cwe_id, name) from the CWE XML catalogue (Weakness elements, ID/Name attributes).

    Attributes are read as strings (inference would turn '089' into 89);
    blanks are skipped and ids normalised.
    """
    schema = T.StructType([T.StructField("_ID", T.StringType()), T.StructField("_Name", T.StringType())])
    x = spark.read.format("xml").option("rowTag", "Weakness").schema(schema).load(path)
    return (x.select(normalize_id("_ID").alias("cwe_id"), F.trim("_Name").alias("name"))
            .where((F.col("cwe_id") != "") & (F.coalesce("name", F.lit("")) != "")))
