"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with DuckDB oracles.

Each query runs a library operator over views of the whole test tables
(``churnlens.sources.testdata``).  ``ORACLES`` holds the same computation
written independently in DuckDB SQL; a query without an oracle is checked
on row counts only (and by its unit tests against a brute-force version).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import findings as fnd
from churnlens.plans import oracle_sql as osql
from churnlens.sources import testdata as td
from churnlens.sources.testdata import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; its plan is always built in a UTC session (time zones bind at analysis)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def parsed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.parse_findings(td.fx_findings(spark, sf_dir))


# Oracle CTE: parsed findings (status, severity) + per-finding CWE labels.
_PARSED = ("parsed", f"""
SELECT analysis_id, filename, ai_response,
  {osql.status_text('ai_response')} AS vulnerability_status,
  {osql.status_norm('ai_response')} AS status_normalized,
  {osql.severity('ai_response')} AS vuln_severity
FROM fx_findings""")
_MENTIONS = ("mentions", osql.cwe_mentions_cte("fx_findings", "analysis_id, filename", "ai_response"))
_LABELS = ("labels", osql.cwe_labels_cte("mentions", "analysis_id, filename"))


# ---------------------------------------------------------------------------
# status and severity of every finding
# ---------------------------------------------------------------------------

@register("response_status", with_fixtures(
    "SELECT analysis_id, filename, vulnerability_status, status_normalized, vuln_severity FROM parsed",
    "fx_findings", ctes=[_PARSED]))
def response_status(spark, sf_dir):
    return parsed_findings(spark, sf_dir).select(
        "analysis_id", "filename", "vulnerability_status", "status_normalized", "vuln_severity")


# ---------------------------------------------------------------------------
# CWE labels, one row per (finding, label) in first-seen order
# ---------------------------------------------------------------------------

@register("cwe_labels", with_fixtures(
    "SELECT analysis_id, filename, cwe_pos, cwe FROM labels",
    "fx_findings", ctes=[_MENTIONS, _LABELS]))
def cwe_labels(spark, sf_dir):
    return (parsed_findings(spark, sf_dir)
            .select("analysis_id", "filename", F.posexplode("cwe").alias("cwe_pos", "cwe")))


# ---------------------------------------------------------------------------
# A19 + O02 + P10: vulnerability-type counts per analysis, ranked
# ---------------------------------------------------------------------------

_TYPES = ("types", """
SELECT p.analysis_id, p.filename, coalesce(l.cwe, 'Uncategorized') AS vuln_type,
       p.vulnerability_status, p.status_normalized, p.vuln_severity
FROM parsed p LEFT JOIN labels l ON p.analysis_id = l.analysis_id AND p.filename = l.filename
WHERE p.status_normalized IN ('yes', 'not_sure')""")

@register("vuln_type_counts", with_fixtures("""
SELECT analysis_id, vuln_type, type_count,
       CAST(row_number() OVER (PARTITION BY analysis_id ORDER BY type_count DESC, vuln_type) AS INTEGER) AS type_rank
FROM (SELECT analysis_id, vuln_type, count(*) AS type_count FROM types GROUP BY analysis_id, vuln_type)""",
    "fx_findings", ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES]))
def vuln_type_counts(spark, sf_dir):
    return fnd.vuln_type_counts(parsed_findings(spark, sf_dir))


@register("vuln_type_details", with_fixtures(
    "SELECT analysis_id, vuln_type, filename, vulnerability_status, status_normalized, vuln_severity FROM types",
    "fx_findings", ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES]))
def vuln_type_details(spark, sf_dir):
    return fnd.vuln_type_details(parsed_findings(spark, sf_dir))


# ---------------------------------------------------------------------------
# Dashboards A01-A17 (one DataFrame per metric, all from one rollup)
# ---------------------------------------------------------------------------

from churnlens.operators import dashboards as dash  # noqa: E402

AS_OF = "2002-01-01 00:00:00"


def _roll(spark, sf_dir):
    return dash.rollup(td.fx_analyses(spark, sf_dir), parsed_findings(spark, sf_dir))


_ROLL = ("roll", """
SELECT a.*, coalesce(f.n_results, 0) AS n_results, coalesce(l.vuln_count, 0) AS vuln_count
FROM fx_analyses a
LEFT JOIN (SELECT analysis_id, count(*) AS n_results FROM fx_findings GROUP BY analysis_id) f ON a.analysis_id = f.analysis_id
LEFT JOIN (SELECT analysis_id, count(*) AS vuln_count FROM labels GROUP BY analysis_id) l ON a.analysis_id = l.analysis_id""")
_ROLL_CTES = [_MENTIONS, _LABELS, _ROLL]

_PINFO_SQL = """SELECT analysis_id,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') <> '' THEN coalesce(nullif(product, ''), repo_name)
       WHEN source = 'folder' THEN 'old' ELSE '' END AS product_name,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') = '' AND source = 'folder' THEN '/srv/p' || (analysis_id % 97) || '/old/'
       WHEN source <> 'folder' THEN '1.' || (analysis_id % 7) ELSE '' END AS old_version,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') = '' AND source = 'folder' AND analysis_id % 5 <> 0 THEN '/srv/q' || (analysis_id % 89) || '/new'
       WHEN source <> 'folder' THEN '1.' || (analysis_id % 7 + 1) ELSE '' END AS new_version
FROM fx_analyses"""


def _analyses_with_params(spark, sf_dir):
    """Analyses with folder and version parameters: folders for folder analyses, versions otherwise."""
    a = td.fx_analyses(spark, sf_dir)
    folder = F.col("source") == "folder"
    return (a.withColumn("old_folder", F.when(folder, F.format_string("/srv/p%d/old/", F.col("analysis_id") % 97)))
            .withColumn("new_folder", F.when(folder & (F.col("analysis_id") % 5 != 0),
                                             F.format_string("/srv/q%d/new", F.col("analysis_id") % 89)))
            .withColumn("old_version", F.when(~folder, F.format_string("1.%d", F.col("analysis_id") % 7)))
            .withColumn("new_version", F.when(~folder, F.format_string("1.%d", F.col("analysis_id") % 7 + 1))))


def _dash_sql(sql, extra=(), ctes=None):
    return with_fixtures(sql, "fx_analyses", "fx_findings", *extra, ctes=ctes if ctes is not None else _ROLL_CTES)


@register("analysis_kpis", _dash_sql("""
SELECT CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS total_completed,
       CAST(count(*) FILTER (WHERE status IN ('running', 'in_progress', 'analyzing')) AS BIGINT) AS active_running,
       CAST(coalesce(sum(vuln_count) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS total_vulns,
       CASE WHEN count(*) FILTER (WHERE status = 'completed') > 0
            THEN sum(vuln_count) FILTER (WHERE status = 'completed')::DOUBLE / count(*) FILTER (WHERE status = 'completed')
            ELSE 0.0 END AS avg_vulns_per_analysis,
       CASE WHEN count(*) FILTER (WHERE status = 'completed') > 0
            THEN count(*) FILTER (WHERE status = 'completed' AND vuln_count > 0)::DOUBLE / count(*) FILTER (WHERE status = 'completed') * 100
            ELSE 0.0 END AS detection_rate,
       CAST(coalesce(sum(n_results) FILTER (WHERE status = 'completed'), 0) AS BIGINT) AS total_files_analyzed
FROM roll"""))
def analysis_kpis(spark, sf_dir):
    return dash.analysis_kpis(_roll(spark, sf_dir))


@register("vulns_by_product", _dash_sql("""
SELECT product_name, CAST(sum(vuln_count) AS BIGINT) AS vuln_count FROM (
  SELECT CASE WHEN product IS NOT NULL THEN product ELSE repo_name END AS product_name, vuln_count
  FROM roll WHERE status = 'completed')
WHERE coalesce(product_name, '') <> '' AND vuln_count > 0 GROUP BY product_name"""))
def vulns_by_product(spark, sf_dir):
    return dash.vulns_by_product(_roll(spark, sf_dir))


@register("top_cwes", _dash_sql("""
SELECT cwe, cwe_count, CAST(cwe_rank AS INTEGER) AS cwe_rank FROM (
  SELECT cwe, count(*) AS cwe_count, row_number() OVER (ORDER BY count(*) DESC, cwe) AS cwe_rank
  FROM labels l JOIN fx_analyses a ON a.analysis_id = l.analysis_id WHERE a.status = 'completed' GROUP BY cwe)
WHERE cwe_rank <= 10""", ctes=[_MENTIONS, _LABELS]))
def top_cwes(spark, sf_dir):
    return dash.top_cwes(td.fx_analyses(spark, sf_dir), parsed_findings(spark, sf_dir))


def cve_matches(spark, sf_dir):
    """Answers to CVE questions parsed (F17), one per (finding, cve)."""
    from churnlens.functions.responses import cve_answer
    return (td.fx_cve_checks(spark, sf_dir)
            .groupBy("analysis_id", "filename", "cve_id").agg(F.max("answer").alias("answer"))
            .withColumn("result", cve_answer("answer")))


_CVE_MATCHES = ("cve_matches", f"""
SELECT analysis_id, filename, cve_id, answer, {osql.cve_answer('answer')} AS result FROM (
  SELECT analysis_id, filename, cve_id, max(answer) AS answer FROM fx_cve_checks GROUP BY analysis_id, filename, cve_id)""")


@register("cve_answers", with_fixtures(
    "SELECT analysis_id, filename, cve_id, result FROM cve_matches", "fx_cve_checks", ctes=[_CVE_MATCHES]))
def cve_answers(spark, sf_dir):
    return cve_matches(spark, sf_dir).select("analysis_id", "filename", "cve_id", "result")


@register("cve_match_rate", with_fixtures("""
SELECT CAST(coalesce(sum(yes), 0) AS BIGINT) AS total_matches,
       CAST(count(*) FILTER (WHERE checks > 0) AS BIGINT) AS analyses_with_checks,
       CASE WHEN count(*) FILTER (WHERE checks > 0) > 0
            THEN count(*) FILTER (WHERE yes > 0)::DOUBLE / count(*) FILTER (WHERE checks > 0) * 100 ELSE 0.0 END AS match_rate
FROM (SELECT m.analysis_id, count(*) FILTER (WHERE result = 'Yes') AS yes, count(*) AS checks
      FROM cve_matches m JOIN fx_analyses a ON a.analysis_id = m.analysis_id WHERE a.status = 'completed'
      GROUP BY m.analysis_id)""", "fx_analyses", "fx_cve_checks", ctes=[_CVE_MATCHES]))
def cve_match_rate(spark, sf_dir):
    return dash.cve_match_rate(td.fx_analyses(spark, sf_dir), cve_matches(spark, sf_dir))


@register("duration_by_scale", _dash_sql("""
SELECT bucket, CAST(trunc(avg(d)) AS BIGINT) AS avg_duration_s FROM (
  SELECT CASE WHEN n_results <= 10 THEN '10_files' WHEN n_results <= 100 THEN '100_files'
              WHEN n_results <= 1000 THEN '1000_files' END AS bucket,
         (epoch_us(finished_at) - epoch_us(created_at)) / 1e6 AS d
  FROM roll WHERE status = 'completed' AND finished_at IS NOT NULL)
WHERE d > 0 AND bucket IS NOT NULL GROUP BY bucket"""))
def duration_by_scale(spark, sf_dir):
    return dash.duration_by_scale(_roll(spark, sf_dir))


@register("confidence_levels", _dash_sql("""
SELECT CAST(count(*) FILTER (WHERE contains(lower(vulnerability_status), 'yes') OR contains(lower(vulnerability_status), 'vulnerabilities')) AS BIGINT) AS confirmed,
       CAST(count(*) FILTER (WHERE NOT (contains(lower(vulnerability_status), 'yes') OR contains(lower(vulnerability_status), 'vulnerabilities'))
                              AND contains(lower(vulnerability_status), 'not sure')) AS BIGINT) AS uncertain
FROM parsed p JOIN fx_analyses a ON a.analysis_id = p.analysis_id WHERE a.status = 'completed'""", ctes=[_PARSED]))
def confidence_levels(spark, sf_dir):
    return dash.confidence_levels(td.fx_analyses(spark, sf_dir), parsed_findings(spark, sf_dir))


@register("library_kpis", with_fixtures("""
SELECT count(*) AS monitored_libraries, CAST(count(*) FILTER (WHERE auto_scan) AS BIGINT) AS auto_scan_enabled,
       count(last_checked) AS version_checks, CAST(0 AS BIGINT) AS new_versions_detected FROM fx_library""", "fx_library"))
def library_kpis(spark, sf_dir):
    return dash.library_kpis(td.fx_library(spark, sf_dir))


@register("active_repos", with_fixtures("""
SELECT repo, analyses_count, CAST(repo_rank AS INTEGER) AS repo_rank FROM (
  SELECT repo_name AS repo, count(*) AS analyses_count, row_number() OVER (ORDER BY count(*) DESC, repo_name) AS repo_rank
  FROM fx_analyses WHERE status = 'completed' AND source IN ('library', 'library_auto', 'cve_auto') AND repo_name IS NOT NULL
  GROUP BY repo_name) WHERE repo_rank <= 10""", "fx_analyses"))
def active_repos(spark, sf_dir):
    return dash.active_repos(td.fx_analyses(spark, sf_dir))


@register("analyses_per_day", with_fixtures("""
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS analyses_count
FROM fx_analyses WHERE status = 'completed' GROUP BY day""", "fx_analyses"))
def analyses_per_day(spark, sf_dir):
    return dash.analyses_per_day(td.fx_analyses(spark, sf_dir))


@register("avg_time_by_source", with_fixtures(f"""
SELECT CASE WHEN coalesce(source, '') = '' THEN 'unknown' ELSE source END AS source,
       avg((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(coalesce(finished_at, created_at))) / 1e6) AS avg_age_s
FROM fx_analyses WHERE status = 'completed' GROUP BY 1""", "fx_analyses"))
def avg_time_by_source(spark, sf_dir):
    a = td.fx_analyses(spark, sf_dir).withColumn("modified_at", F.coalesce("finished_at", "created_at"))
    return dash.avg_time_by_source(a, AS_OF)


_TREND_SQL = """
SELECT {key} AS period, CAST(sum(vuln_count) AS BIGINT) AS vuln_count FROM roll
WHERE status = 'completed' AND source IN ('library', 'library_auto', 'cve_auto') GROUP BY period"""

for _p, _key in [("daily", "strftime(created_at, '%Y-%m-%d')"),
                 ("weekly", "printf('%d-W%02d', isoyear(created_at), week(created_at))"),
                 ("monthly", "strftime(created_at, '%Y-%m')")]:
    _period = {"daily": "day", "weekly": "week", "monthly": "month"}[_p]
    register(f"trend_{_p}", _dash_sql(_TREND_SQL.format(key=_key)))(
        (lambda per: lambda spark, sf_dir: dash.vuln_trend(_roll(spark, sf_dir), per))(_period))


@register("product_activity", with_fixtures("""
SELECT product_name, analyses_count, CAST(product_rank AS INTEGER) AS product_rank FROM (
  SELECT product AS product_name, count(*) AS analyses_count, row_number() OVER (ORDER BY count(*) DESC, product) AS product_rank
  FROM fx_analyses WHERE status = 'completed' AND product IS NOT NULL GROUP BY product) WHERE product_rank <= 10""",
    "fx_analyses"))
def product_activity(spark, sf_dir):
    return dash.product_activity(td.fx_analyses(spark, sf_dir))


@register("product_kpis", with_fixtures("""
SELECT c.n AS total_configured, a.n AS total_analyses, CASE WHEN c.n > 0 THEN a.n::DOUBLE / c.n ELSE 0.0 END AS avg_coverage
FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM fx_products) c,
     (SELECT CAST(count(*) AS BIGINT) AS n FROM fx_analyses WHERE status = 'completed' AND product IS NOT NULL) a""",
    "fx_analyses", "fx_products"))
def product_kpis(spark, sf_dir):
    return dash.product_kpis(td.fx_analyses(spark, sf_dir), td.fx_products(spark, sf_dir))


# Languages of the extensions that the fixture's files have.
_DISPLAY = {".php": "PHP", ".js": "JavaScript", ".py": "Python", ".c": "C", ".tsx": "TypeScript", ".rb": "Ruby"}
_ANALYSIS = {".php": "php", ".js": "javascript", ".py": "python", ".c": "c", ".tsx": "typescript", ".rb": "ruby"}


def _lang_sql(path: str, mapping: dict, default: str | None) -> str:
    ext = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$', 0), '(\\.[^.]*)$', 1))"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sorted(mapping.items()))
    return f"(CASE {ext} {cases} ELSE {repr(default) if default else 'NULL'} END)"


def _display_lang_sql(path: str) -> str:
    return _lang_sql(path, _DISPLAY, None)


@register("language_mix", with_fixtures(f"""
SELECT category, language, file_count, CAST(language_rank AS INTEGER) AS language_rank FROM (
  SELECT category, language, CAST(count(*) AS BIGINT) AS file_count,
         row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, language) AS language_rank
  FROM (SELECT CASE WHEN a.product IS NOT NULL THEN 'products'
                    WHEN a.source IN ('library', 'library_auto', 'cve_auto') THEN 'library' ELSE 'folder' END AS category,
               {_display_lang_sql('f.filename')} AS language
        FROM fx_findings f JOIN fx_analyses a ON a.analysis_id = f.analysis_id WHERE a.status = 'completed')
  WHERE language IS NOT NULL GROUP BY category, language) WHERE language_rank <= 5""", "fx_analyses", "fx_findings"))
def language_mix(spark, sf_dir):
    return dash.language_mix(td.fx_analyses(spark, sf_dir), td.fx_findings(spark, sf_dir))


@register("vuln_count_per_analysis", with_fixtures("""
SELECT f.analysis_id, CAST(coalesce(l.n, 0) AS BIGINT) AS vuln_count, f.n_results FROM
  (SELECT analysis_id, count(*) AS n_results FROM fx_findings GROUP BY analysis_id) f
  LEFT JOIN (SELECT analysis_id, count(*) AS n FROM labels GROUP BY analysis_id) l ON f.analysis_id = l.analysis_id""",
    "fx_findings", ctes=[_MENTIONS, _LABELS]))
def vuln_count_per_analysis(spark, sf_dir):
    return fnd.vuln_count_per_analysis(parsed_findings(spark, sf_dir))


@register("analysis_summary", with_fixtures("""
SELECT r.analysis_id, r.status, r.source, pi.product_name, pi.old_version, pi.new_version,
       r.n_results AS total_files, r.vuln_count,
       CAST(coalesce(t.type_total, 0) AS BIGINT) AS type_total, CAST(coalesce(t.n_types, 0) AS BIGINT) AS n_types
FROM roll r LEFT JOIN (SELECT analysis_id, count(*) AS type_total, count(DISTINCT vuln_type) AS n_types FROM types GROUP BY analysis_id) t
  ON r.analysis_id = t.analysis_id
JOIN pinfo pi ON pi.analysis_id = r.analysis_id""", "fx_analyses", "fx_findings",
    ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES, _ROLL, ("pinfo", _PINFO_SQL)]))
def analysis_summary(spark, sf_dir):
    """A21 + F19: summary row with product and versions resolved from the parameters."""
    return fnd.analysis_summary(_analyses_with_params(spark, sf_dir), parsed_findings(spark, sf_dir))


# ---------------------------------------------------------------------------
# Versions: F20 order, W01 pairs, W02/W03 next version
# ---------------------------------------------------------------------------

from churnlens.operators import versions as ver  # noqa: E402

PAIR_COUNT = 3


def _version_key_sql(tag: str) -> str:
    parts = f"string_split(replace(regexp_replace({tag}, '^v', ''), '_', '.'), '.')"
    padded = f"list_concat({parts}, list_transform(range(greatest(0, 51 - len({parts}))), lambda x: '0'))"
    return (f"list_transform({padded}, lambda p: {{'class': CASE WHEN regexp_matches(p, '^[0-9]') THEN 1 "
            f"WHEN p = '' OR p < '0' THEN 0 ELSE 2 END, "
            f"'num': CASE WHEN regexp_matches(p, '^[0-9]') THEN CAST(regexp_extract(p, '^[0-9]+') AS DECIMAL(38,0)) "
            f"ELSE CAST(0 AS DECIMAL(38,0)) END, 'str': CASE WHEN regexp_matches(p, '^[0-9]') THEN '' ELSE p END}})")
    # (independent formulation: numeric parts as decimals, padded to the fixed P15 maximum)


_CLEAN_TAGS = ("clean_tags", f"""
SELECT DISTINCT repo, {osql.go_trim('tag')} AS tag FROM fx_tags
WHERE regexp_full_match({osql.go_trim('tag')}, '[a-zA-Z0-9._-]+') AND length({osql.go_trim('tag')}) <= 50""")
_RANKED_TAGS = ("ranked_tags", f"""
SELECT repo, tag, row_number() OVER (PARTITION BY repo ORDER BY {_version_key_sql('tag')} DESC, tag) - 1 AS version_rank
FROM clean_tags""")


@register("version_sort", with_fixtures("SELECT repo, tag, version_rank FROM ranked_tags", "fx_tags",
                                        ctes=[_CLEAN_TAGS, _RANKED_TAGS]))
def version_sort(spark, sf_dir):
    return ver.sorted_versions(td.fx_tags(spark, sf_dir)).select("repo", "tag", "version_rank")


@register("version_pairs", with_fixtures(f"""
SELECT n.repo, n.version_rank AS pair_index, n.tag AS new_version, o.tag AS old_version, t.available_versions, 'ok' AS status
FROM ranked_tags n JOIN ranked_tags o ON n.repo = o.repo AND o.version_rank = n.version_rank + 1
JOIN (SELECT repo, count(*) AS available_versions FROM clean_tags GROUP BY repo) t ON t.repo = n.repo
WHERE n.version_rank < {PAIR_COUNT} AND t.available_versions >= {PAIR_COUNT + 1}
UNION ALL
SELECT repo, NULL, NULL, NULL, count(*), 'insufficient' FROM clean_tags GROUP BY repo HAVING count(*) < {PAIR_COUNT + 1}""",
    "fx_tags", ctes=[_CLEAN_TAGS, _RANKED_TAGS]))
def version_pairs(spark, sf_dir):
    return ver.release_pairs(td.fx_tags(spark, sf_dir), PAIR_COUNT)


def _current_versions(spark, sf_dir):
    """The oldest published tag of each repository is its 'last seen' version."""
    return (td.fx_tags(spark, sf_dir).groupBy("repo")
            .agg(F.min(F.struct("published_at", "tag"))["tag"].alias("current_version")))


@register("next_version", with_fixtures(f"""
SELECT c.repo, c.current_version,
       CASE WHEN cur.date_rank > 0 THEN nw.tag ELSE coalesce(hd.tag, c.current_version) END AS next_version,
       coalesce(inc.tag, CASE WHEN cur.date_rank > 0 THEN nw.tag ELSE coalesce(hd.tag, c.current_version) END) AS next_incremental
FROM cur_v c
LEFT JOIN dated cur ON cur.repo = c.repo AND cur.tag = c.current_version
LEFT JOIN dated nw ON nw.repo = c.repo AND nw.date_rank = cur.date_rank - 1
LEFT JOIN dated hd ON hd.repo = c.repo AND hd.date_rank = 0
LEFT JOIN (SELECT c2.repo, arg_min(d.tag, d.date_rank) AS tag FROM cur_v c2
           JOIN dated cur2 ON cur2.repo = c2.repo AND cur2.tag = c2.current_version
           JOIN dated d ON d.repo = c2.repo AND d.date_rank < cur2.date_rank
           WHERE contains(c2.current_version, '-') AND starts_with(d.tag, split_part(c2.current_version, '-', 1) || '-')
           GROUP BY c2.repo) inc ON inc.repo = c.repo""",
    "fx_tags", ctes=[
        ("cur_v", "SELECT repo, min({'p': published_at, 't': tag}).t AS current_version FROM fx_tags GROUP BY repo"),
        ("dated", f"""SELECT repo, tag, row_number() OVER (PARTITION BY repo ORDER BY published_at DESC, tag) - 1 AS date_rank
                     FROM (SELECT repo, {osql.go_trim('tag')} AS tag, max(published_at) AS published_at FROM fx_tags
                           WHERE regexp_full_match({osql.go_trim('tag')}, '[a-zA-Z0-9._-]+') AND length({osql.go_trim('tag')}) <= 50
                           GROUP BY 1, 2)""")]))
def next_version(spark, sf_dir):
    return ver.next_versions(td.fx_tags(spark, sf_dir), _current_versions(spark, sf_dir))


# ---------------------------------------------------------------------------
# Snapshots: alignment, diffs, churn
# ---------------------------------------------------------------------------

from churnlens.operators import snapshots as snap  # noqa: E402

EXT_FILTER = "php, .JS"
KEYWORDS = "teh, Qx"


def fx_pairs(spark, sf_dir):
    """One real pair per repository plus one whose new snapshot does not exist."""
    repos = td.fx_snapshots(spark, sf_dir).select("repo").distinct()
    real = repos.select(F.concat("repo", F.lit(":new-old")).alias("pair_id"), "repo",
                        F.lit("old").alias("old_version"), F.lit("new").alias("new_version"))
    missing = repos.select(F.concat("repo", F.lit(":next-new")).alias("pair_id"), "repo",
                           F.lit("new").alias("old_version"), F.lit("next").alias("new_version"))
    return real.unionByName(missing)


_PAIRS_SQL = ("pairs", """
SELECT repo || ':new-old' AS pair_id, repo, 'old' AS old_version, 'new' AS new_version FROM (SELECT DISTINCT repo FROM fx_snapshots)
UNION ALL
SELECT repo || ':next-new', repo, 'new', 'next' FROM (SELECT DISTINCT repo FROM fx_snapshots)),
ok_pairs AS (SELECT * FROM pairs p WHERE EXISTS (SELECT 1 FROM fx_snapshots s WHERE s.repo = p.repo AND s.version = p.old_version)
                                    AND EXISTS (SELECT 1 FROM fx_snapshots s WHERE s.repo = p.repo AND s.version = p.new_version)""")


def _n_lines_sql(c):
    return (f"(CASE WHEN coalesce({c}, '') = '' THEN 0 WHEN suffix({c}, chr(10)) THEN len(string_split({c}, chr(10))) - 1 "
            f"ELSE len(string_split({c}, chr(10))) END)")


def _lines_sql(c):
    return (f"(CASE WHEN coalesce({c}, '') = '' THEN []::VARCHAR[] WHEN suffix({c}, chr(10)) "
            f"THEN string_split({c}, chr(10))[1:-2] ELSE string_split({c}, chr(10)) END)")


def _kept_sql(path):
    # fixed values
    excluded = (".git", "node_modules", ".vscode", "__pycache__", ".idea", ".DS_Store")
    bad = " OR ".join(f"contains({path}, '{s}')" for s in excluded)
    return f"NOT ({bad} OR starts_with(regexp_extract({path}, '[^/]*$', 0), '.'))"


def _valid_name_sql(path):
    # fixed values
    forbidden = ("..", ":", "*", "?", '"', "<", ">", "|")
    bad = " OR ".join(f"contains({path}, '{s}')" for s in forbidden)
    return f"(coalesce({path}, '') <> '' AND strlen({path}) <= 255 AND NOT ({bad}))"


def _changes_sql(ext_list=None):
    ext = "lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '(\\.[^.]*)$', 1))"
    ext_cond = "TRUE" if not ext_list else f"{ext} IN ({', '.join(repr(e) for e in ext_list)})"
    return ("changes", f"""
SELECT * FROM (
  SELECT coalesce(o.pair_id, n.pair_id) AS pair_id, coalesce(o.path, n.path) AS path,
         CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' WHEN o.h <> n.h THEN 'modified' END AS change_type,
         o.n AS old_lines, n.n AS new_lines
  FROM (SELECT p.pair_id, s.path, s.h, s.n FROM ok_pairs p JOIN scan s ON s.repo = p.repo AND s.version = p.old_version) o
  FULL OUTER JOIN (SELECT p.pair_id, s.path, s.h, s.n FROM ok_pairs p JOIN scan s ON s.repo = p.repo AND s.version = p.new_version) n
  ON o.pair_id = n.pair_id AND o.path = n.path)
WHERE change_type IS NOT NULL AND {{ext}} AND {_valid_name_sql('path')}
  AND CASE change_type WHEN 'modified' THEN coalesce(old_lines, 0) > 0 AND coalesce(new_lines, 0) > 0
                       WHEN 'deleted' THEN coalesce(old_lines, 0) > 0 ELSE coalesce(new_lines, 0) > 0 END""".replace("{ext}", ext_cond))


_SCAN_SQL = ("scan", f"""
SELECT repo, version, path, sha256(coalesce(content, '')) AS h, {_n_lines_sql('content')} AS n, content
FROM fx_snapshots WHERE {_kept_sql('path')}""")
_SNAP_CTES = [_PAIRS_SQL, _SCAN_SQL, _changes_sql()]


def _changes(spark, sf_dir, ext=None, mode="product"):
    return snap.align(td.fx_snapshots(spark, sf_dir), fx_pairs(spark, sf_dir), ext, mode)


@register("snapshot_changes", with_fixtures("SELECT pair_id, path, change_type FROM changes", "fx_snapshots",
                                            ctes=_SNAP_CTES))
def snapshot_changes(spark, sf_dir):
    return _changes(spark, sf_dir).select("pair_id", "path", "change_type")


@register("diff_by_type", with_fixtures(
    "SELECT pair_id, change_type, count(*) AS diff_count FROM changes GROUP BY pair_id, change_type",
    "fx_snapshots", ctes=_SNAP_CTES))
def diff_by_type(spark, sf_dir):
    return snap.diff_by_type(_changes(spark, sf_dir))


@register("ext_scope", with_fixtures("SELECT pair_id, path, change_type FROM changes", "fx_snapshots",
                                     ctes=[_PAIRS_SQL, _SCAN_SQL, _changes_sql([".php", ".js"])]))
def ext_scope(spark, sf_dir):
    return _changes(spark, sf_dir, EXT_FILTER).select("pair_id", "path", "change_type")


@register("line_churn", with_fixtures("""
SELECT pair_id, path, CAST(sum(CASE WHEN d > 0 THEN d ELSE 0 END) AS BIGINT) AS lines_added,
       CAST(sum(CASE WHEN d < 0 THEN -d ELSE 0 END) AS BIGINT) AS lines_removed
FROM (SELECT pair_id, path, line, sum(d) AS d FROM (
        SELECT c.pair_id, c.path, unnest(""" + _lines_sql("so.content") + """) AS line, -1 AS d
        FROM changes c JOIN pairs p ON p.pair_id = c.pair_id
        LEFT JOIN fx_snapshots so ON so.repo = p.repo AND so.version = p.old_version AND so.path = c.path
        UNION ALL
        SELECT c.pair_id, c.path, unnest(""" + _lines_sql("sn.content") + """) AS line, 1 AS d
        FROM changes c JOIN pairs p ON p.pair_id = c.pair_id
        LEFT JOIN fx_snapshots sn ON sn.repo = p.repo AND sn.version = p.new_version AND sn.path = c.path)
      GROUP BY pair_id, path, line)
GROUP BY pair_id, path""", "fx_snapshots", ctes=_SNAP_CTES))
def line_churn(spark, sf_dir):
    return snap.line_churn(_changes(spark, sf_dir), td.fx_snapshots(spark, sf_dir))


@register("whole_file_diffs", with_fixtures("""
SELECT c.pair_id, c.path, c.change_type,
       CAST(len(""" + _lines_sql("s.content") + """) + 3 AS INTEGER) AS diff_len,
       CAST(least(len(""" + _lines_sql("s.content") + """) + 3, 1000) AS INTEGER) AS context_len,
       CASE c.change_type WHEN 'deleted' THEN '--- ' || p.old_version || '/' || c.path || chr(10) || '+++ /dev/null' || chr(10)
              || '@@ -1,' || len(""" + _lines_sql("s.content") + """) || ' +0,0 @@'
            ELSE '--- /dev/null' || chr(10) || '+++ ' || p.new_version || '/' || c.path || chr(10)
              || '@@ -0,0 +1,' || len(""" + _lines_sql("s.content") + """) || ' @@' END AS diff_head,
       CASE c.change_type WHEN 'deleted' THEN '-' ELSE '+' END || """ + _lines_sql("s.content") + """[-1] AS diff_tail
FROM changes c JOIN pairs p ON p.pair_id = c.pair_id
JOIN fx_snapshots s ON s.repo = p.repo AND s.path = c.path
  AND s.version = CASE c.change_type WHEN 'deleted' THEN p.old_version ELSE p.new_version END
WHERE c.change_type IN ('added', 'deleted')""", "fx_snapshots", ctes=_SNAP_CTES))
def whole_file_diffs(spark, sf_dir):
    ch = _changes(spark, sf_dir).where(F.col("change_type").isin("added", "deleted"))
    d = snap.render_diffs(ch, td.fx_snapshots(spark, sf_dir), context_lines=1000)
    return d.select("pair_id", "path", "change_type", F.size("diff").alias("diff_len"),
                    F.size("context").alias("context_len"),
                    F.array_join(F.slice("diff", 1, 3), "\n").alias("diff_head"),
                    F.element_at("diff", -1).alias("diff_tail"))


@register("keyword_files", with_fixtures("""
SELECT c.pair_id, c.path, c.change_type FROM changes c JOIN pairs p ON p.pair_id = c.pair_id
JOIN fx_snapshots s ON s.repo = p.repo AND s.path = c.path
  AND s.version = CASE c.change_type WHEN 'deleted' THEN p.old_version ELSE p.new_version END
WHERE c.change_type IN ('added', 'deleted')
  AND len(list_filter(""" + _lines_sql("s.content") + """, lambda l: contains(l, 'teh') OR contains(l, 'Qx'))) > 0""",
    "fx_snapshots", ctes=[_PAIRS_SQL, ("scan", _SCAN_SQL[1].replace(f"WHERE {_kept_sql('path')}", "")),
                          _changes_sql()]))
def keyword_files(spark, sf_dir):
    ch = _changes(spark, sf_dir, mode="folder").where(F.col("change_type").isin("added", "deleted"))
    d = snap.render_diffs(ch, td.fx_snapshots(spark, sf_dir), context_lines=1000)
    return snap.keyword_scope(d, KEYWORDS).select("pair_id", "path", "change_type")


@register("unified_diff")
def unified_diff(spark, sf_dir):
    """F10 + F11 + P04 over every changed file (rows-only check; hunks come from difflib)."""
    d = snap.render_diffs(_changes(spark, sf_dir, mode="folder"), td.fx_snapshots(spark, sf_dir), context_lines=1000)
    kws = snap.keyword_list(KEYWORDS)
    return d.select("pair_id", "path", "change_type", F.size("diff").alias("diff_len"),
                    F.size("context").alias("context_len"),
                    snap.any_line_has_keyword(F.col("diff"), kws).alias("keyword_hit"))


@register("bulk_summary", with_fixtures("""
SELECT p.pair_id, p.repo, p.old_version, p.new_version,
       CASE WHEN o.ok AND n.ok THEN 'completed' ELSE 'error' END AS status,
       CAST(CASE WHEN o.ok AND n.ok THEN coalesce(c.file_count, 0) ELSE 0 END AS BIGINT) AS file_count,
       CASE WHEN o.ok AND n.ok THEN NULL ELSE 'snapshot not available' END AS error
FROM pairs p
LEFT JOIN (SELECT DISTINCT repo, version, TRUE AS ok FROM fx_snapshots) o ON o.repo = p.repo AND o.version = p.old_version
LEFT JOIN (SELECT DISTINCT repo, version, TRUE AS ok FROM fx_snapshots) n ON n.repo = p.repo AND n.version = p.new_version
LEFT JOIN (SELECT pair_id, count(*) AS file_count FROM changes GROUP BY pair_id) c ON c.pair_id = p.pair_id""",
    "fx_snapshots", ctes=_SNAP_CTES))
def bulk_summary(spark, sf_dir):
    files = td.fx_snapshots(spark, sf_dir)
    return snap.bulk_summary(fx_pairs(spark, sf_dir), files, _changes(spark, sf_dir))


@register("diff_artifact", with_fixtures("""
SELECT c.pair_id, p.repo, p.old_version AS version_1, p.new_version AS version_2, count(*) AS diff_count,
       list(c.path || ' (' || c.change_type || ')' ORDER BY CASE c.change_type WHEN 'modified' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END, c.path)[1:5] AS highlights
FROM changes c JOIN pairs p ON p.pair_id = c.pair_id GROUP BY c.pair_id, p.repo, p.old_version, p.new_version""",
    "fx_snapshots", ctes=_SNAP_CTES))
def diff_artifact(spark, sf_dir):
    return snap.diff_artifact(_changes(spark, sf_dir))


@register("snapshot_catalog", with_fixtures("""
SELECT repo, version, count(*) AS file_count, CAST(sum(strlen(content)) AS BIGINT) AS size_bytes
FROM fx_snapshots GROUP BY repo, version""", "fx_snapshots"))
def snapshot_catalog(spark, sf_dir):
    return snap.snapshot_catalog(td.fx_snapshots(spark, sf_dir))


# ---------------------------------------------------------------------------
# Symbols: definitions, calls, builtins, resolution, changed functions, context
# ---------------------------------------------------------------------------

from churnlens.operators import symbols as sym  # noqa: E402


def _defs(spark, sf_dir):
    return sym.definitions(td.fx_code_files(spark, sf_dir))


_DEFS_SQL = ("defs", """
SELECT 'code' AS repo, 'new' AS version, path, 'php' AS lang,
       regexp_extract(line, 'function[ \\t]+&?[ \\t]*([A-Za-z_][A-Za-z0-9_]*)[ \\t]*\\(', 1) AS name, FALSE AS is_method, 0 AS seq,
       trim(left(line, strpos(line, '{') - 1)) AS signature,
       rtrim(substring(line, strpos(line, '{') + 1, (length(line) - strpos(reverse(line), '}') + 1) - strpos(line, '{') - 1),
             chr(10) || chr(13) || ' ') AS body
FROM fx_code_lines WHERE regexp_matches(line, '^[ \\t]*function[ \\t]+&?[ \\t]*[A-Za-z_][A-Za-z0-9_]*[ \\t]*\\(')""")

_PHP_CALLS = [r"\$this\s*->\s*([a-z_][a-zA-Z0-9_]*)\s*\(", r"(?:[A-Z][a-zA-Z0-9_]*)::\s*([a-z_][a-zA-Z0-9_]*)\s*\(",
              r"\b([a-z_][a-z0-9_]*)\s*\("]
def _ordered_distinct_calls_sql():
    # DuckDB's list_distinct does not keep order: keep the first position of each name.
    pats = " || ".join(f"regexp_extract_all(body, '{p}', 1)" for p in _PHP_CALLS)
    return ("calls", f"""
SELECT repo, version, path, lang, caller, callee, CAST(row_number() OVER (PARTITION BY path, caller ORDER BY first_pos) - 1 AS INTEGER) AS call_pos
FROM (SELECT repo, version, path, lang, caller, callee, min(pos) AS first_pos FROM (
        SELECT repo, version, path, lang, name AS caller, unnest(all_calls) AS callee, unnest(generate_series(1, len(all_calls))) AS pos
        FROM (SELECT *, {pats} AS all_calls FROM defs))
      GROUP BY ALL)""")


_CALLS_SQL = _ordered_distinct_calls_sql()
# the one PHP function that the fixture's code calls besides its own
_USER_CALLS_SQL = ("user_calls", "SELECT * FROM calls WHERE callee <> 'strlen'")
_FIRST_DEFS_SQL = ("first_defs", """
SELECT repo, version, lang, name, arg_min(path, (0, path, -seq)) AS def_path, arg_min(signature, (0, path, -seq)) AS signature,
       arg_min(body, (0, path, -seq)) AS body FROM defs GROUP BY repo, version, lang, name""")
_SYM_CTES = [_DEFS_SQL, _CALLS_SQL, _USER_CALLS_SQL, _FIRST_DEFS_SQL]


@register("symbol_defs", with_fixtures("SELECT path, name, signature, body, is_method FROM defs", "fx_code_lines",
                                       ctes=[_DEFS_SQL]))
def symbol_defs(spark, sf_dir):
    return _defs(spark, sf_dir).select("path", "name", "signature", "body", "is_method")


@register("symbol_calls", with_fixtures("SELECT path, caller, callee, call_pos FROM calls", "fx_code_lines",
                                        ctes=[_DEFS_SQL, _CALLS_SQL]))
def symbol_calls(spark, sf_dir):
    return sym.calls(_defs(spark, sf_dir)).select("path", "caller", "callee", F.col("call_pos").cast("int"))


@register("user_calls", with_fixtures("SELECT path, caller, callee FROM user_calls", "fx_code_lines",
                                      ctes=[_DEFS_SQL, _CALLS_SQL, _USER_CALLS_SQL]))
def user_calls(spark, sf_dir):
    return sym.drop_builtins(sym.calls(_defs(spark, sf_dir))).select("path", "caller", "callee")


@register("call_resolution", with_fixtures("""
SELECT u.path, u.caller, u.callee, f.def_path FROM user_calls u
JOIN first_defs f ON f.repo = u.repo AND f.version = u.version AND f.lang = u.lang AND f.name = u.callee""",
    "fx_code_lines", ctes=_SYM_CTES))
def call_resolution(spark, sf_dir):
    d = sym.materialized_definitions(td.fx_code_files(spark, sf_dir))
    return sym.resolve_calls(sym.drop_builtins(sym.calls(d)), d).select("path", "caller", "callee", "def_path")


_MODULE_DEFS_SQL = ("defs", _DEFS_SQL[1].replace("fx_code_lines", "fx_module_files"))


@register("tree_resolution", with_fixtures("""
SELECT u.path, u.caller, u.callee, arg_min(d.path, (string_split(d.path, '/'), d.path)) AS def_path
FROM user_calls u JOIN defs d ON d.name = u.callee AND starts_with(d.path, regexp_replace(u.path, '[^/]*$', ''))
GROUP BY u.path, u.caller, u.callee""", "fx_module_files", ctes=[_MODULE_DEFS_SQL, _CALLS_SQL, _USER_CALLS_SQL]))
def tree_resolution(spark, sf_dir):
    """Calls resolved inside the calling file's folder."""
    d = sym.materialized_definitions(td.fx_module_files(spark, sf_dir))
    return sym.resolve_in_tree(sym.drop_builtins(sym.calls(d)), d).select("path", "caller", "callee", "def_path")


_DIFF_LINES_SQL = ("diff_lines", """
SELECT 'code' AS repo, 'new' AS version, path, '+' || line AS line FROM fx_code_lines""")
_CHANGED_SQL = ("changed", """
SELECT DISTINCT d.repo, d.version, d.path, d.lang, d.name FROM defs d
JOIN (SELECT DISTINCT repo, version, path, unnest(regexp_extract_all(lower(line), '[a-z0-9_]+', 0)) AS token FROM diff_lines) t
  ON t.repo = d.repo AND t.version = d.version AND t.path = d.path AND t.token = lower(d.name)
WHERE regexp_full_match(d.name, '[A-Za-z0-9_]+')""")


@register("changed_functions", with_fixtures("SELECT path, name FROM changed", "fx_code_lines",
                                             ctes=[_DEFS_SQL, _DIFF_LINES_SQL, _CHANGED_SQL]))
def changed_functions(spark, sf_dir):
    return sym.changed_functions(td.fx_code_diff_lines(spark, sf_dir), _defs(spark, sf_dir)).select("path", "name")


@register("function_context", with_fixtures(f"""
SELECT path, count(*) AS n_functions,
       '{sym.CONTEXT_HEADER}' || string_agg(block, chr(10) || '---' || chr(10) || chr(10) ORDER BY callee) || '{sym.CONTEXT_FOOTER}' AS context
FROM (SELECT DISTINCT c.repo, c.version, c.path, cl.callee FROM changed c
      JOIN user_calls cl ON cl.repo = c.repo AND cl.version = c.version AND cl.path = c.path AND cl.caller = c.name) cc
JOIN (SELECT f.*, '[Function: ' || f.name || ']' || chr(10) || 'Language: ' || f.lang || chr(10)
                  || 'File: ' || regexp_extract(f.def_path, '[^/]*$', 0) || chr(10) || chr(10) || f.body AS block
      FROM first_defs f) fd ON fd.repo = cc.repo AND fd.version = cc.version AND fd.name = cc.callee
GROUP BY path""".replace("'\n=== Function Context", "chr(10) || '=== Function Context").replace(
        "code:\n\n'", "code:' || chr(10) || chr(10)").replace("===\n\n'", "===' || chr(10) || chr(10)").replace(
        "'\n=== End", "chr(10) || '=== End").replace("Context ===\n\nThe", "Context ===' || chr(10) || chr(10) || 'The"),
    "fx_code_lines", ctes=_SYM_CTES + [_DIFF_LINES_SQL, _CHANGED_SQL]))
def function_context(spark, sf_dir):
    d = sym.materialized_definitions(td.fx_code_files(spark, sf_dir))
    return sym.function_context(td.fx_code_diff_lines(spark, sf_dir), d).select("path", "n_functions", "context")


# ---------------------------------------------------------------------------
# Enrichment: prompts, envelopes, CVE lookups, bundles, scrapes, NVD feed
# ---------------------------------------------------------------------------

from churnlens.operators import enrich as enr  # noqa: E402


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _described_matches(spark, sf_dir):
    return enr.describe_cves(cve_matches(spark, sf_dir), td.fx_cves(spark, sf_dir))


_DESCRIBED_SQL = ("described", f"""
SELECT m.*, coalesce(c.description, '{enr.NO_DESCRIPTION}') AS description
FROM cve_matches m LEFT JOIN fx_cves c ON c.cve_id = m.cve_id""")


@register("cve_lookup", with_fixtures("SELECT analysis_id, filename, cve_id, description FROM described",
                                      "fx_cve_checks", "fx_cves", ctes=[_CVE_MATCHES, _DESCRIBED_SQL]))
def cve_lookup(spark, sf_dir):
    return _described_matches(spark, sf_dir).select("analysis_id", "filename", "cve_id", "description")


_CVE_PROMPT = ("Earlier review:\n{ai_response}\n\nCVE description:\n{cve_description}\n\nDoes the review describe this CVE? "
               "Reply 'Description Matches: Yes' or 'Description Matches: No'.")


@register("prompt_render", with_fixtures(f"""
SELECT d.analysis_id, d.filename, d.cve_id,
       replace(replace({_sql_str(_CVE_PROMPT)}, '{{ai_response}}', coalesce(f.ai_response, '')),
               '{{cve_description}}', d.description) AS prompt
FROM described d LEFT JOIN fx_findings f ON f.analysis_id = d.analysis_id AND f.filename = d.filename""",
    "fx_cve_checks", "fx_cves", "fx_findings", ctes=[_CVE_MATCHES, _DESCRIBED_SQL]))
def prompt_render(spark, sf_dir):
    d = _described_matches(spark, sf_dir)
    f = td.fx_findings(spark, sf_dir)
    return (d.join(f, ["analysis_id", "filename"], "left")
            .select("analysis_id", "filename", "cve_id",
                    enr.render_prompt("cve_analysis", ai_response="ai_response",
                                      cve_description="description").alias("prompt")))


@register("cve_bundle", with_fixtures(f"""
SELECT analysis_id, cve_id, count(*) AS n_files,
       coalesce(min(CASE WHEN coalesce(description, '') <> '' THEN {{'f': filename, 'd': description}} END).d, '') AS cve_description,
       string_agg('File: ' || filename || chr(10) || chr(10) || 'AI Analysis:' || chr(10) || coalesce(ai_response, ''),
                  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY filename) AS evidence
FROM (SELECT d.*, f.ai_response FROM described d LEFT JOIN fx_findings f ON f.analysis_id = d.analysis_id AND f.filename = d.filename
      WHERE d.result = 'Yes')
GROUP BY analysis_id, cve_id""", "fx_cve_checks", "fx_cves", "fx_findings", ctes=[_CVE_MATCHES, _DESCRIBED_SQL]))
def cve_bundle(spark, sf_dir):
    return enr.cve_bundles(_described_matches(spark, sf_dir), td.fx_findings(spark, sf_dir))


def _library_requests(spark, sf_dir):
    return td.fx_library(spark, sf_dir).select(F.col("id").alias("request_id"), "cpe",
                                               F.col("last_version").alias("version"))


_LIB_CVES_SQL = ("lib_cves", """
SELECT l.id AS request_id, c.cve_id, c.description FROM fx_library l
JOIN fx_cves c ON c.cpe_name = l.cpe || ':' || replace(l.last_version, '-', ':')
WHERE coalesce(l.cpe, '') <> '' AND coalesce(l.last_version, '') <> ''""")


@register("cve_versions", with_fixtures(
    "SELECT request_id, array_to_string(list_sort(list_distinct(list(cve_id))), ', ') AS cve_ids FROM lib_cves GROUP BY request_id",
    "fx_library", "fx_cves", ctes=[_LIB_CVES_SQL]))
def cve_versions(spark, sf_dir):
    return enr.cve_lists(_library_requests(spark, sf_dir), td.fx_cves(spark, sf_dir))


@register("cve_seed", with_fixtures("""
SELECT l.request_id AS pair_id, c.path, l.cve_id, 'Pending AI analysis' AS result
FROM changes c JOIN (SELECT DISTINCT request_id, cve_id FROM lib_cves) l
  ON split_part(c.path, '/', 1) = 'src' || (CAST(l.request_id AS INT) % 20)""",
    "fx_snapshots", "fx_library", "fx_cves", ctes=_SNAP_CTES + [_LIB_CVES_SQL]))
def cve_seed(spark, sf_dir):
    """J08 + C05: each library's changes (its tree is one source's) seeded with the CVEs of its last version."""
    requests = _library_requests(spark, sf_dir)
    asked, kinds = enr.asked_names(requests)
    set_cves = (enr.cves_for_versions(kinds, td.fx_cves(spark, sf_dir))
                .select(F.col("request_id").alias("set_id"), "cve_id").distinct())
    trees = requests.join(asked, "request_id").select(
        F.col("request_id").alias("pair_id"), "set_id", F.concat(F.lit("src"), F.col("request_id").cast("int") % 20).alias("source"))
    changes = _changes(spark, sf_dir).select("path", F.substring_index("path", "/", 1).alias("source"))
    return enr.seed_cve_matches(enr.deal(changes, "path").join(trees, "source"), set_cves, "set_id").select("pair_id", "path", "cve_id", "result")


@register("envelope_extract", with_fixtures("""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN 'No AI response' ELSE text END AS answer FROM conversations"""))
def envelope_extract(spark, sf_dir):
    r = td.fx_replies(spark, sf_dir)
    return r.select("conv_id", "turn", enr.envelope_text("body").alias("answer"))


MARKER = "<article>"


def _scrape_sql(html: str, marker: str) -> str:
    start = f"strpos({html}, '{marker}')"
    after = f"substring({html}, {start})"
    gt = f"strpos({after}, '>')"
    rest = f"substring({html}, {start} + {gt})"
    close = f"strpos({rest}, '</p>')"
    d = osql.go_trim(f"left({rest}, {close} - 1)")
    for a, b in [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
                 ("' || chr(10) || '", " "), ("' || chr(9) || '", " ")]:
        d = f"replace({d}, '{a}', '{b}')"
    d = f"regexp_replace({d}, ' {{2,}}', ' ', 'g')"
    return (f"CASE WHEN {start} = 0 THEN '{enr.SCRAPE_FAILURES['missing']}' WHEN {gt} = 0 THEN '{enr.SCRAPE_FAILURES['format']}' "
            f"WHEN {close} = 0 THEN '{enr.SCRAPE_FAILURES['unclosed']}' WHEN {d} = '' THEN '{enr.SCRAPE_FAILURES['empty']}' ELSE {d} END")


@register("page_description", with_fixtures(f"SELECT page_id, {_scrape_sql('html', MARKER)} AS description FROM pages"))
def page_description(spark, sf_dir):
    return td.table(spark, sf_dir, "pages").select("page_id", enr.scrape_description("html", MARKER).alias("description"))


@register("release_date", with_fixtures("""
SELECT page_id, CASE page_id % 4
    WHEN 0 THEN strftime(event_ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(event_ts, '%Y-%m-%d %H:%M:%S')
    WHEN 2 THEN strftime(event_ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS released_at
FROM fx_release_pages""", "fx_release_pages"))
def release_date(spark, sf_dir):
    p = td.fx_release_pages(spark, sf_dir)
    return p.select("page_id", F.date_format(enr.release_time("html"), "yyyy-MM-dd HH:mm:ss").alias("released_at"))


@register("nvd_parse", with_fixtures("""
SELECT event_id, pos, 'CVE-2024-' || (event_id * 2 + pos) AS cve_id,
       CASE WHEN pos = 1 THEN 'second' WHEN event_id % 3 = 0 THEN 'event ' || event_type
            WHEN event_id % 3 = 1 THEN 'type ' || event_type ELSE '' END AS description,
       CASE WHEN pos = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            WHEN event_id % 6 = 4 THEN strftime(date_trunc('second', ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S')
            WHEN event_id % 6 = 5 THEN strftime(date_trunc('second', ts) - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS published,
       CASE WHEN pos = 1 OR event_id % 5 >= 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS modified,
       'UNKNOWN' AS severity
FROM events, (SELECT unnest([0, 1]) AS pos)"""))
def nvd_parse(spark, sf_dir):
    rows = enr.parse_nvd(td.fx_nvd_feed(spark, sf_dir))
    return rows.select("event_id", F.col("pos").cast("int").alias("pos"), "cve_id", "description",
                       F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"),
                       F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), "severity")


@register("score_merge", with_fixtures(f"""
SELECT analysis_id, filename, {osql.status_norm('ai_response')} AS status_normalized FROM fx_findings""", "fx_findings"))
def score_merge(spark, sf_dir):
    """J13 / T06 batch twin: results get their scored status."""
    f = td.fx_findings(spark, sf_dir)
    results = f.select("analysis_id", "filename", F.lit("unknown").alias("status_normalized"))
    scored = fnd.parse_findings(f).select("analysis_id", "filename", "status_normalized")
    return enr.merge_back(results, scored, ["analysis_id", "filename"], ["status_normalized"])


# ---------------------------------------------------------------------------
# Reports and the download cache
# ---------------------------------------------------------------------------

from churnlens.operators import reports as rep  # noqa: E402

PAGE, PER_PAGE = 3, 20
SEARCH = "nation_1"
FOCUS = "uncategorized"
RETENTION_AS_OF = "2024-02-15 00:00:00"


@register("report_page", with_fixtures(f"""
SELECT analysis_id, status, source, strftime(created_at, '%Y-%m-%d') AS day FROM fx_analyses
ORDER BY created_at DESC, analysis_id LIMIT {PER_PAGE} OFFSET {(PAGE - 1) * PER_PAGE}""", "fx_analyses"))
def report_page(spark, sf_dir):
    a = td.fx_analyses(spark, sf_dir)
    return rep.page(a, PAGE, PER_PAGE).select("analysis_id", "status", "source",
                                              F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@register("report_page_info", with_fixtures(f"""
SELECT {PAGE} AS page, {PER_PAGE} AS per_page, count(*) AS total, CAST(ceil(count(*) / {PER_PAGE}) AS BIGINT) AS total_pages,
       {PAGE} < ceil(count(*) / {PER_PAGE}) AS has_next, {PAGE} > 1 AS has_prev FROM fx_analyses""", "fx_analyses"))
def report_page_info(spark, sf_dir):
    return rep.page_info(td.fx_analyses(spark, sf_dir), PAGE, PER_PAGE)


@register("report_filter", with_fixtures(f"""
SELECT analysis_id, CASE WHEN coalesce(product, '') <> '' THEN 'product' WHEN source IN ('library', 'library_auto') THEN 'library'
                         ELSE 'folder' END AS report_class
FROM fx_analyses
WHERE contains(lower(concat_ws(' ', CASE WHEN product IS NOT NULL THEN 'product: ' || product END,
                                    CASE WHEN repo_name IS NOT NULL THEN 'repo_name: ' || repo_name END,
                                    CASE WHEN source IS NOT NULL THEN 'source: ' || source END)), '{SEARCH}')""", "fx_analyses"))
def report_filter(spark, sf_dir):
    a = td.fx_analyses(spark, sf_dir)
    return (rep.search(a, SEARCH, ["product", "repo_name", "source"])
            .select("analysis_id", rep.report_class("product", "source").alias("report_class")))


@register("focus_type", with_fixtures(f"""
SELECT analysis_id, min({{'miss': CASE WHEN lower(vuln_type) = '{FOCUS}' THEN 0 ELSE 1 END, 'r': type_rank, 't': vuln_type}}).t AS focus_type
FROM (SELECT analysis_id, vuln_type, row_number() OVER (PARTITION BY analysis_id ORDER BY type_count DESC, vuln_type) AS type_rank
      FROM (SELECT analysis_id, vuln_type, count(*) AS type_count FROM types GROUP BY analysis_id, vuln_type))
GROUP BY analysis_id""", "fx_findings", ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES]))
def focus_type(spark, sf_dir):
    return rep.focus_type(fnd.vuln_type_counts(parsed_findings(spark, sf_dir)), FOCUS)


@register("client_relevance", with_fixtures("""
SELECT analysis_id, filename, (contains(lower(vulnerability_status), 'yes') OR contains(lower(vulnerability_status), 'not sure')
   OR (contains(lower(vulnerability_status), 'vulnerabilit') AND NOT contains(lower(vulnerability_status), 'no vulnerabilit'))) AS relevant
FROM parsed""", "fx_findings", ctes=[_PARSED]))
def client_relevance(spark, sf_dir):
    return parsed_findings(spark, sf_dir).select("analysis_id", "filename",
                                                 rep.client_relevance("vulnerability_status").alias("relevant"))


@register("report_rows", with_fixtures("""
SELECT a.analysis_id, coalesce(f.n, 0) AS total_files, coalesce(l.n, 0) AS vuln_count, 0 AS bulk_count
FROM fx_analyses a LEFT JOIN (SELECT analysis_id, count(*) AS n FROM fx_findings GROUP BY analysis_id) f ON f.analysis_id = a.analysis_id
LEFT JOIN (SELECT analysis_id, count(*) AS n FROM labels GROUP BY analysis_id) l ON l.analysis_id = a.analysis_id""",
    "fx_analyses", "fx_findings", ctes=[_MENTIONS, _LABELS]))
def report_rows(spark, sf_dir):
    s = fnd.analysis_summary(td.fx_analyses(spark, sf_dir), parsed_findings(spark, sf_dir))
    return rep.report_rows(s).withColumn("bulk_count", F.col("bulk_count").cast("int"))


@register("download_moving_avg", with_fixtures("""
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq,
       CAST(sum(CAST(value AS DECIMAL(38,9))) OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS DOUBLE)
         / count(*) OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS moving_avg_s
FROM fx_access WHERE kind = 'download'""", "fx_access"))
def download_moving_avg(spark, sf_dir):
    return rep.download_moving_avg(td.fx_access(spark, sf_dir))


@register("cache_kpis", with_fixtures("""
SELECT c.cached_versions, c.size_bytes,
       CASE WHEN h.hits + h.misses > 0 THEN h.hits::DOUBLE / (h.hits + h.misses) * 100 ELSE 0.0 END AS hit_rate,
       d.avg_download_s,
       CASE WHEN h.hits > 0 AND c.size_bytes > 0 THEN CAST(trunc(h.hits * (c.size_bytes::DOUBLE / c.cached_versions)) AS BIGINT) ELSE 0 END AS disk_space_saved
FROM (SELECT count(*) AS cached_versions, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM
        (SELECT repo, version, sum(strlen(content)) AS size_bytes FROM fx_snapshots GROUP BY repo, version)) c,
     (SELECT CAST(count(*) FILTER (WHERE kind = 'hit') AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE kind = 'miss') AS BIGINT) AS misses FROM fx_access) h,
     (SELECT coalesce(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / count(*), 0.0) AS avg_download_s
      FROM (SELECT value FROM fx_access WHERE kind = 'download' ORDER BY ts DESC, event_id DESC LIMIT 100)) d""",
    "fx_access", "fx_snapshots"))
def cache_kpis(spark, sf_dir):
    return rep.cache_kpis(td.fx_access(spark, sf_dir), snap.snapshot_catalog(td.fx_snapshots(spark, sf_dir)))


def _catalog_with_mtime(spark, sf_dir):
    """Cached snapshots with a modification time: the newest event time for 'new', the oldest for 'old'."""
    e = td.table(spark, sf_dir, "events").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    cat = snap.snapshot_catalog(td.fx_snapshots(spark, sf_dir))
    return cat.withColumn("modified_at", F.when(F.col("version") == "old", F.lit(e["first"])).otherwise(F.lit(e["last"])))


@register("retention", with_fixtures(f"""
SELECT repo, version FROM (SELECT DISTINCT repo, version FROM fx_snapshots) s, (SELECT min(ts) AS first, max(ts) AS last FROM events) e
WHERE CASE WHEN version = 'old' THEN first ELSE last END < TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 30 DAY""", "fx_snapshots"))
def retention(spark, sf_dir):
    return rep.expired_snapshots(_catalog_with_mtime(spark, sf_dir), RETENTION_AS_OF).select("repo", "version")


# ---------------------------------------------------------------------------
# Composed compares over a content-addressed store
# ---------------------------------------------------------------------------

import uuid  # noqa: E402

from churnlens.plans import compare as cmp  # noqa: E402
from churnlens.session import checkpoint_dir  # noqa: E402
from churnlens.sources import store as st  # noqa: E402


def _store_of(spark, files) -> st.Store:
    """The trees in a new store of the session's shared folder."""
    return st.create_store(spark, f"{checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}").add(files)


def _tree_pairs(spark, sf_dir, old: str, new: str):
    return td.fx_tree_tags(spark, sf_dir).select("repo").distinct().select(
        F.format_string("%s:%s..%s", "repo", F.lit(old), F.lit(new)).alias("pair_id"), "repo", F.lit(old).alias("old_version"), F.lit(new).alias("new_version"))


def _compare_ctes(pairs: str, tree: str = "fx_trees", mode: str = "product", exts=None):
    """pairs, ok_pairs, scan, changes and rows (a review row per change) over a tree fixture."""
    kept = _kept_sql("path") if mode == "product" else "TRUE"
    scan = f"SELECT repo, version, path, sha256(coalesce(content, '')) AS h, {_n_lines_sql('content')} AS n, content FROM {tree} WHERE {kept}"
    changes = _changes_sql(exts)[1]
    if mode == "folder":
        changes = changes.replace(f"AND {_valid_name_sql('path')}", "").replace(
            "coalesce(old_lines, 0) > 0 AND coalesce(new_lines, 0) > 0", "coalesce(old_lines, 0) > 0 OR coalesce(new_lines, 0) > 0")
    both = f"""
SELECT c.*, p.repo, p.old_version, p.new_version, o.content AS old_content, n.content AS new_content,
       {_lines_sql("CASE c.change_type WHEN 'deleted' THEN o.content ELSE n.content END")} AS ls
FROM changes c JOIN pairs p ON p.pair_id = c.pair_id
LEFT JOIN {tree} o ON o.repo = p.repo AND o.version = p.old_version AND o.path = c.path
LEFT JOIN {tree} n ON n.repo = p.repo AND n.version = p.new_version AND n.path = c.path"""
    rows = """
SELECT *, coalesce(new_lines, 0) - coalesce(old_lines, 0) AS net_lines,
       CASE change_type
         WHEN 'deleted' THEN '--- ' || old_version || '/' || path || chr(10) || '+++ /dev/null' || chr(10) || '@@ -1,' || len(ls) || ' +0,0 @@' || chr(10)
              || array_to_string(list_transform(ls, lambda l: '-' || l), chr(10))
         WHEN 'added' THEN '--- /dev/null' || chr(10) || '+++ ' || new_version || '/' || path || chr(10) || '@@ -0,0 +1,' || len(ls) || ' @@' || chr(10)
              || array_to_string(list_transform(ls, lambda l: '+' || l), chr(10)) END AS diff
FROM both_sides"""
    ok = f"""SELECT * FROM pairs p WHERE EXISTS (SELECT 1 FROM {tree} s WHERE s.repo = p.repo AND s.version = p.old_version)
             AND EXISTS (SELECT 1 FROM {tree} s WHERE s.repo = p.repo AND s.version = p.new_version)"""
    return [("pairs", pairs), ("ok_pairs", ok), ("scan", scan), ("changes", changes), ("both_sides", both), ("review", rows)]


def _review_row(diffs):
    """A diff by what every diff of the file must have: added minus removed lines, and the text of whole-file diffs."""
    body = F.slice("diff", 3, F.size("diff"))
    count = lambda mark: F.size(F.filter(body, lambda l: l.startswith(mark)))
    return [F.col("pair_id"), F.col("path"), F.col("change_type"), F.col("vuln_severity"), (count("+") - count("-")).alias("net_lines"),
            F.when(F.col("change_type") != "modified", F.sha2(F.array_join("diff", "\n"), 256)).alias("diff_sha256")]


_REVIEW = "pair_id, path, change_type, 'unknown' AS vuln_severity, CAST(net_lines AS INTEGER) AS net_lines, sha256(diff) AS diff_sha256"
_STEP_SQL = """SELECT repo || ':{0}..{1}' AS pair_id, repo, '{0}' AS old_version, '{1}' AS new_version FROM (SELECT DISTINCT repo FROM fx_tree_tags)"""


@register("folder_compare", with_fixtures(f"""
SELECT {_REVIEW} FROM review
WHERE CASE change_type WHEN 'modified' THEN contains(new_content, 'teh') ELSE len(list_filter(ls, lambda l: contains(l, 'teh') OR contains(l, 'Qx'))) > 0 END""",
    "fx_trees", "fx_tree_tags", ctes=_compare_ctes(_STEP_SQL.format("1.0", "1.1"), mode="folder", exts=[".php", ".js"])))
def folder_compare(spark, sf_dir):
    """Two folders, extension scope and keywords (P04 on diffs, P05 on whole files)."""
    store = _store_of(spark, td.fx_trees(spark, sf_dir))
    rows = cmp.compare_snapshots(store, _tree_pairs(spark, sf_dir, "1.0", "1.1"), EXT_FILTER, KEYWORDS, mode="folder")
    return rows.select(*_review_row(rows))


@register("release_compare", with_fixtures(f"SELECT {_REVIEW} FROM review", "fx_trees", "fx_tree_tags",
                                           ctes=_compare_ctes(_STEP_SQL.format("1.1", "2.0"))))
def release_compare(spark, sf_dir):
    """Two releases of each product."""
    store = _store_of(spark, td.fx_trees(spark, sf_dir))
    rows = cmp.compare_snapshots(store, _tree_pairs(spark, sf_dir, "1.1", "2.0"))
    return rows.select(*_review_row(rows))


_BULK_SQL = """SELECT repo || ':' || o || '..' || n AS pair_id, repo, o AS old_version, n AS new_version
FROM (SELECT DISTINCT repo FROM fx_tree_tags WHERE repo <> 'es'), (VALUES ('1.1', '2.0'), ('1.0', '1.1')) t(o, n)"""


@register("bulk_compare", with_fixtures(f"""
SELECT {_REVIEW}, '[' || new_version || '→' || old_version || '] ' || path AS result_key FROM review""",
    "fx_trees", "fx_tree_tags", ctes=_compare_ctes(_BULK_SQL)))
def bulk_compare(spark, sf_dir):
    """The two newest release pairs of every repository, results under '[new→old] path'."""
    rows, _ = cmp.bulk_compare(_store_of(spark, td.fx_trees(spark, sf_dir)), td.fx_tree_tags(spark, sf_dir), 2)
    return rows.select(*_review_row(rows), "result_key")


@register("bulk_compare_summary", with_fixtures("""
SELECT p.pair_id, p.repo, p.old_version, p.new_version, 'completed' AS status, CAST(coalesce(c.n, 0) AS BIGINT) AS file_count, CAST(NULL AS VARCHAR) AS error
FROM pairs p LEFT JOIN (SELECT pair_id, count(*) AS n FROM changes GROUP BY pair_id) c ON c.pair_id = p.pair_id""",
    "fx_trees", "fx_tree_tags", ctes=_compare_ctes(_BULK_SQL)[:4]))
def bulk_compare_summary(spark, sf_dir):
    """Status and file count of every pair."""
    return cmp.bulk_compare(_store_of(spark, td.fx_trees(spark, sf_dir)), td.fx_tree_tags(spark, sf_dir), 2)[1]


_LIBRARY_PAIRS_SQL = """SELECT {} AS pair_id, repo_url AS repo, last_version AS old_version, 'next' AS new_version, id, cpe FROM fx_library"""


@register("library_compare", with_fixtures(f"SELECT {_REVIEW} FROM review", "fx_library_trees", ctes=_compare_ctes(
    _LIBRARY_PAIRS_SQL.format("repo_url || ':' || last_version || ':next'"), "fx_library_trees")))
def library_compare(spark, sf_dir):
    """Each monitored library from its last seen to its next release, by repository URL."""
    requests = td.fx_library(spark, sf_dir).select("repo_url", F.col("last_version").alias("old_version"), F.lit("next").alias("new_version"))
    rows = cmp.library_compare(_store_of(spark, td.fx_library_trees(spark, sf_dir)), requests)
    return rows.select(*_review_row(rows))


@register("cve_compare", with_fixtures(f"""
SELECT r.pair_id, r.path, l.cve_id, 'Pending AI analysis' AS result
FROM review r JOIN (SELECT DISTINCT request_id, cve_id FROM lib_cves) l ON l.request_id = r.pair_id""",
    "fx_library_trees", "fx_cves", ctes=[*_compare_ctes(_LIBRARY_PAIRS_SQL.format("id"), "fx_library_trees"), _LIB_CVES_SQL]))
def cve_compare(spark, sf_dir):
    """The libraries' changes seeded with the CVEs of the old release."""
    requests = td.fx_library(spark, sf_dir).select(F.col("id").alias("pair_id"), F.col("repo_url").alias("repo"),
                                                   F.col("last_version").alias("old_version"), F.lit("next").alias("new_version"), "cpe")
    return cmp.cve_compare(_store_of(spark, td.fx_library_trees(spark, sf_dir)), requests, td.fx_cves(spark, sf_dir))


@register("review_requests", with_fixtures("""
SELECT pair_id, path, 'Review the change below to ' || path || ' for security impact.' || chr(10) || chr(10) || diff || chr(10) || chr(10)
       || 'For each issue write ''Vulnerability Existed: yes'', ''no'' or ''not sure'', followed by the CWE id and a short description.' AS prompt
FROM review WHERE change_type <> 'modified'""", "fx_trees", "fx_tree_tags", ctes=_compare_ctes(_STEP_SQL.format("1.1", "2.0"))))
def review_requests(spark, sf_dir):
    """The prompts for added and deleted files (their diffs have one form; those of modified files have many)."""
    store = _store_of(spark, td.fx_trees(spark, sf_dir))
    changes = snap.align(store.manifest, _tree_pairs(spark, sf_dir, "1.1", "2.0")).where("change_type <> 'modified'")
    newer = store.files().join(td.fx_tree_tags(spark, sf_dir).select("repo", F.lit("2.0").alias("version")).distinct(), ["repo", "version"], "left_semi")
    return cmp.review_requests(cmp.render_changes(changes, store.contents), newer)


# ---------------------------------------------------------------------------
# Streaming twins: release detection (T02), requests (T03), throttle (T04), documents
# ---------------------------------------------------------------------------

from churnlens.streaming import jobs as stream  # noqa: E402


def _polls(spark, sf_dir):
    return td.fx_tags(spark, sf_dir).select("repo", F.col("published_at").alias("polled_at"), "tag")


_CHANGES_SQL = ("rel_changes", """
SELECT repo, polled_at, prev AS old_version, tag AS new_version FROM (
  SELECT repo, published_at AS polled_at, tag, lag(tag) OVER (PARTITION BY repo ORDER BY published_at, tag) AS prev
  FROM fx_tags WHERE coalesce(tag, '') <> '')
WHERE prev IS NOT NULL AND prev <> tag""")


@register("release_detect", with_fixtures(
    "SELECT repo, strftime(polled_at, '%Y-%m-%d %H:%M:%S.%f') AS polled_at, old_version, new_version FROM rel_changes",
    "fx_tags", ctes=[_CHANGES_SQL]))
def release_detect(spark, sf_dir):
    c = stream.release_changes(_polls(spark, sf_dir))
    return c.select("repo", F.date_format("polled_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("polled_at"),
                    "old_version", "new_version")


@register("auto_requests", with_fixtures("""
SELECT c.repo, strftime(c.polled_at, '%Y-%m-%d %H:%M:%S.%f') AS polled_at, l.name AS repo_name, l.repo_url,
       c.old_version, c.new_version, CASE WHEN coalesce(l.cpe, '') <> '' THEN 'cve_auto' ELSE 'library_auto' END AS mode
FROM rel_changes c JOIN fx_library l ON l.id = CAST(c.repo AS VARCHAR)
WHERE regexp_full_match(c.old_version, '[a-zA-Z0-9._-]+') AND length(c.old_version) <= 50
  AND regexp_full_match(c.new_version, '[a-zA-Z0-9._-]+') AND length(c.new_version) <= 50""",
    "fx_tags", "fx_library", ctes=[_CHANGES_SQL]))
def auto_requests(spark, sf_dir):
    r = stream.auto_requests(stream.release_changes(_polls(spark, sf_dir)), td.fx_library(spark, sf_dir))
    return r.withColumn("polled_at", F.date_format("polled_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@register("throttle_labels")
def throttle_labels(spark, sf_dir):
    """T04 batch twin over the whole access log (rows-only check; unit-tested against a brute force)."""
    a = td.fx_access(spark, sf_dir).select(F.col("user_id").alias("client"), "ts", "event_id")
    return stream.throttle_labels(a)


@register("latest_documents", with_fixtures("""
SELECT analysis_id, max({'m': modified_at, 'r': revision}).r AS revision,
       arg_max(status, {'m': modified_at, 'r': revision}) AS status FROM fx_document_log GROUP BY analysis_id""",
    "fx_document_log"))
def latest_documents(spark, sf_dir):
    return stream.latest_documents(td.fx_document_log(spark, sf_dir)).select("analysis_id", "revision", "status")


@register("incremental_kpis", with_fixtures("""
SELECT CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS total_completed,
       CAST(count(*) FILTER (WHERE status IN ('running', 'in_progress', 'analyzing')) AS BIGINT) AS active_running
FROM (SELECT analysis_id, arg_max(status, {'m': modified_at, 'r': revision}) AS status FROM fx_document_log GROUP BY analysis_id)""",
    "fx_document_log"))
def incremental_kpis(spark, sf_dir):
    """T01 batch twin: status KPIs over the newest revision of every document."""
    latest = stream.latest_documents(td.fx_document_log(spark, sf_dir))
    return latest.agg(
        F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("bigint").alias("total_completed"),
        F.sum(F.when(F.col("status").isin("running", "in_progress", "analyzing"), 1).otherwise(0)).cast("bigint")
        .alias("active_running"))


# ---------------------------------------------------------------------------
# Streams run to their end in several batches
# ---------------------------------------------------------------------------

from churnlens.streaming import maintained as kept  # noqa: E402


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _as_stream(spark, rows, batches: int = 3):
    """The rows as a file stream of about ``batches`` micro-batches."""
    folder, files = _scratch(spark, "stream"), spark.sparkContext.defaultParallelism
    rows.repartition(batches * files).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


@register("incremental_dashboard", with_fixtures("""
SELECT metric, key, count(*) AS value FROM (
  SELECT unnest(list_filter([
    CASE WHEN status = 'completed' THEN {'metric': 'total_completed', 'key': ''} END,
    CASE WHEN status IN ('running', 'in_progress', 'analyzing') THEN {'metric': 'active_running', 'key': ''} END,
    CASE WHEN status = 'completed' THEN {'metric': 'completed_by_source', 'key': coalesce(source, '')} END,
    CASE WHEN lib THEN {'metric': 'library_day', 'key': strftime(m, '%Y-%m-%d')} END,
    CASE WHEN lib THEN {'metric': 'library_week', 'key': strftime(m, '%G-W%V')} END,
    CASE WHEN lib THEN {'metric': 'library_month', 'key': strftime(m, '%Y-%m')} END], lambda p: p IS NOT NULL), recursive := true)
  FROM (SELECT *, status = 'completed' AND source IN ('library', 'library_auto', 'cve_auto') AS lib FROM (
          SELECT analysis_id, max(modified_at) AS m, arg_max(status, {'m': modified_at, 'r': revision}) AS status,
                 arg_max(source, {'m': modified_at, 'r': revision}) AS source FROM fx_document_log GROUP BY analysis_id)))
GROUP BY metric, key""", "fx_document_log"))
def incremental_dashboard(spark, sf_dir):
    """Totals kept over a stream of document revisions in three batches, old ones taken back."""
    folder = _scratch(spark, "dashboard")
    kept.run_available(_as_stream(spark, td.fx_document_log(spark, sf_dir)), kept.dashboard_writer(folder), f"{folder}/checkpoint")
    return kept.dashboard_totals(spark, folder)


_SCORED = "analysis_id long, filename string, ai_response string"


@register("scored_merge", with_fixtures("SELECT analysis_id, filename, ai_response FROM fx_findings", "fx_findings"))
def scored_merge(spark, sf_dir):
    """Answers that come in batches, merged by (analysis, file); the largest text of a key stays, as in the batch table."""
    folder, keys = _scratch(spark, "scored"), ["analysis_id", "filename"]
    rows = td.fx_finding_rows(spark, sf_dir).select(F.col("analysis_id").cast("long").alias("analysis_id"), "filename", "ai_response")
    kept.run_available(_as_stream(spark, rows), kept.merge_writer(f"{folder}/rows", keys, ["ai_response"], _SCORED), f"{folder}/checkpoint")
    return kept.merged(spark, f"{folder}/rows", keys, ["ai_response"], _SCORED)


_TREND_ROWS = "created_at timestamp, vuln_count long"


@register("trend_stream", _dash_sql("""
SELECT strftime(created_at, '%Y-%m-%d') AS period, CAST(sum(vuln_count) AS BIGINT) AS value FROM roll
WHERE status = 'completed' AND source IN ('library', 'library_auto', 'cve_auto') GROUP BY 1"""))
def trend_stream(spark, sf_dir):
    """The daily trend over a stream; rows that came after their watermark are added from the side table, none is lost."""
    folder = _scratch(spark, "trend")
    rows = _roll(spark, sf_dir).where((F.col("status") == "completed") & F.col("source").isin(*dash.LIBRARY_SOURCES)).select(
        F.col("created_at").cast("timestamp").alias("created_at"), F.col("vuln_count").cast("long").alias("vuln_count"))
    kept.run_available(_as_stream(spark, rows), kept.trend_writer(folder, "day", _TREND_ROWS), f"{folder}/checkpoint")
    late = (kept.late_rows(spark, folder, _TREND_ROWS).groupBy(dash.period_key("day").alias("period")).agg(F.sum("vuln_count").alias("value")))
    return kept.trend(spark, folder).unionByName(late).groupBy("period").agg(F.sum("value").alias("value"))


@register("release_stream", with_fixtures(
    "SELECT CAST(repo AS VARCHAR) AS repo, strftime(polled_at, '%Y-%m-%d %H:%M:%S.%f') AS polled_at, old_version, new_version FROM rel_changes",
    "fx_tags", ctes=[_CHANGES_SQL]))
def release_stream(spark, sf_dir):
    """Release detection as a stateful stream keyed by repository name."""
    folder = _scratch(spark, "releases")
    changes = stream.release_changes_stream(_as_stream(spark, _polls(spark, sf_dir), 1))
    kept.run_available(changes, lambda batch, epoch: kept.write_epoch(batch, f"{folder}/changes", epoch), f"{folder}/checkpoint")
    rows = kept.read_before(spark, f"{folder}/changes", stream.CHANGE_SCHEMA)
    return rows.select("repo", F.date_format("polled_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("polled_at"), "old_version", "new_version")


# ---------------------------------------------------------------------------
# The dashboard in one table; S07: lookup in an id-clustered table
# ---------------------------------------------------------------------------

from churnlens.functions import paths as pth  # noqa: E402
from churnlens.plans import dashboard as bundle  # noqa: E402
from churnlens.sources import documents as docs  # noqa: E402


def _scalars_sql(table: str, **columns: str) -> str:
    """(metric, key, value) rows of one-row expressions over a table."""
    items = ", ".join(f"{{'metric': '{m}', 'key': '', 'value': CAST({x} AS DOUBLE)}}" for m, x in columns.items())
    return f"SELECT unnest([{items}], recursive := true) FROM {table}"


_DONE = "status = 'completed'"
_LIB = "status = 'completed' AND source IN ('library', 'library_auto', 'cve_auto')"
_BUNDLE_SQL = "\nUNION ALL ".join([
    _scalars_sql("roll", total_completed=f"count(*) FILTER (WHERE {_DONE})",
                 active_running="count(*) FILTER (WHERE status IN ('running', 'in_progress', 'analyzing'))",
                 total_vulns=f"coalesce(sum(vuln_count) FILTER (WHERE {_DONE}), 0)",
                 total_files_analyzed=f"coalesce(sum(n_results) FILTER (WHERE {_DONE}), 0)",
                 product_analyses=f"count(*) FILTER (WHERE {_DONE} AND product IS NOT NULL)",
                 avg_vulns_per_analysis=f"coalesce(sum(vuln_count) FILTER (WHERE {_DONE})::DOUBLE / nullif(count(*) FILTER (WHERE {_DONE}), 0), 0)",
                 detection_rate=f"coalesce(count(*) FILTER (WHERE {_DONE} AND vuln_count > 0)::DOUBLE / nullif(count(*) FILTER (WHERE {_DONE}), 0), 0) * 100"),
    _scalars_sql("(SELECT * FROM roll, (SELECT count(*) AS configured FROM fx_products))",
                 avg_coverage=f"coalesce(count(*) FILTER (WHERE {_DONE} AND product IS NOT NULL)::DOUBLE / nullif(any_value(configured), 0), 0)"),
    "SELECT * FROM (" + _scalars_sql("fx_products", total_configured="count(*)") + ")",
    _scalars_sql("fx_library", monitored_libraries="count(*)", auto_scan_enabled="count(*) FILTER (WHERE auto_scan)", version_checks="count(last_checked)"),
    _scalars_sql("(SELECT p.* FROM parsed p JOIN fx_analyses a ON a.analysis_id = p.analysis_id WHERE a.status = 'completed')",
                 confirmed="count(*) FILTER (WHERE contains(lower(vulnerability_status), 'yes') OR contains(lower(vulnerability_status), 'vulnerabilities'))",
                 uncertain="count(*) FILTER (WHERE NOT (contains(lower(vulnerability_status), 'yes') OR contains(lower(vulnerability_status), 'vulnerabilities'))"
                           " AND contains(lower(vulnerability_status), 'not sure'))"),
    _scalars_sql("""(SELECT m.analysis_id, count(*) FILTER (WHERE result = 'Yes') AS yes FROM cve_matches m
                     JOIN fx_analyses a ON a.analysis_id = m.analysis_id WHERE a.status = 'completed' GROUP BY 1)""",
                 total_matches="coalesce(sum(yes), 0)", analyses_with_checks="count(*)",
                 match_rate="coalesce(count(*) FILTER (WHERE yes > 0)::DOUBLE / nullif(count(*), 0), 0) * 100"),
    _scalars_sql("""(SELECT * FROM (SELECT count(*) AS versions, sum(size_bytes) AS bytes FROM
                       (SELECT repo, version, sum(strlen(content)) AS size_bytes FROM fx_snapshots GROUP BY repo, version)),
                     (SELECT count(*) FILTER (WHERE kind = 'hit') AS hits, count(*) FILTER (WHERE kind = 'miss') AS misses FROM fx_access),
                     (SELECT coalesce(CAST(sum(CAST(value AS DECIMAL(38,9))) AS DOUBLE) / count(*), 0.0) AS mean
                      FROM (SELECT value FROM fx_access WHERE kind = 'download' ORDER BY ts DESC, event_id DESC LIMIT 100)))""",
                 cached_versions="any_value(versions)", size_bytes="any_value(bytes)", avg_download_s="any_value(mean)",
                 hit_rate="any_value(CASE WHEN hits + misses > 0 THEN hits::DOUBLE / (hits + misses) * 100 ELSE 0 END)",
                 disk_space_saved="any_value(CASE WHEN hits > 0 AND bytes > 0 THEN trunc(hits * (bytes::DOUBLE / versions)) ELSE 0 END)"),
    f"""SELECT 'vulns_by_product', coalesce(product, repo_name), CAST(sum(vuln_count) AS DOUBLE) FROM roll
        WHERE {_DONE} AND vuln_count > 0 AND CASE WHEN product IS NOT NULL THEN product ELSE coalesce(repo_name, '') END <> '' GROUP BY 2""",
    f"SELECT 'analyses_per_day', strftime(created_at, '%Y-%m-%d'), CAST(count(*) AS DOUBLE) FROM roll WHERE {_DONE} GROUP BY 2",
    *[f"SELECT 'trend_{p}', {k}, CAST(sum(vuln_count) AS DOUBLE) FROM roll WHERE {_LIB} GROUP BY 2" for p, k in (
        ("day", "strftime(created_at, '%Y-%m-%d')"), ("week", "printf('%d-W%02d', isoyear(created_at), week(created_at))"), ("month", "strftime(created_at, '%Y-%m')"))],
    f"""SELECT 'duration_by_scale', bucket, CAST(trunc(sum(us) / count(*) / 1000000) AS DOUBLE) FROM (
          SELECT CASE WHEN n_results <= 10 THEN '10_files' WHEN n_results <= 100 THEN '100_files' WHEN n_results <= 1000 THEN '1000_files' END AS bucket,
                 epoch_us(finished_at) - epoch_us(created_at) AS us FROM roll WHERE {_DONE} AND finished_at IS NOT NULL)
        WHERE us > 0 AND bucket IS NOT NULL GROUP BY 2""",
    """SELECT 'top_cwes', cwe, CAST(n AS DOUBLE) FROM (
          SELECT l.cwe, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l.cwe) AS r FROM labels l
          JOIN fx_analyses a ON a.analysis_id = l.analysis_id WHERE a.status = 'completed' GROUP BY l.cwe) WHERE r <= 10""",
    f"""SELECT 'active_repos', repo_name, CAST(n AS DOUBLE) FROM (
          SELECT repo_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, repo_name) AS r FROM fx_analyses
          WHERE {_LIB} AND repo_name IS NOT NULL GROUP BY repo_name) WHERE r <= 10""",
    f"""SELECT 'product_activity', product, CAST(n AS DOUBLE) FROM (
          SELECT product, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, product) AS r FROM fx_analyses
          WHERE {_DONE} AND product IS NOT NULL GROUP BY product) WHERE r <= 10""",
    f"""SELECT 'language_' || category, language, CAST(n AS DOUBLE) FROM (
          SELECT category, language, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, language) AS r FROM (
            SELECT CASE WHEN a.product IS NOT NULL THEN 'products' WHEN a.source IN ('library', 'library_auto', 'cve_auto') THEN 'library' ELSE 'folder' END AS category,
                   {_display_lang_sql('f.filename')} AS language FROM fx_findings f JOIN fx_analyses a ON a.analysis_id = f.analysis_id WHERE a.status = 'completed')
          WHERE language IS NOT NULL GROUP BY category, language) WHERE r <= 5"""])


@register("dashboard_bundle", with_fixtures(_BUNDLE_SQL, "fx_analyses", "fx_findings", "fx_cve_checks", "fx_library", "fx_products", "fx_access", "fx_snapshots",
                                            ctes=[_PARSED, *_ROLL_CTES, _CVE_MATCHES]))
def dashboard_bundle(spark, sf_dir):
    """All dashboard metrics as (metric, key, value) from one load."""
    return bundle.dashboard_bundle(td.fx_analyses(spark, sf_dir), parsed_findings(spark, sf_dir), cve_matches(spark, sf_dir), td.fx_library(spark, sf_dir),
                                   td.fx_products(spark, sf_dir), td.fx_access(spark, sf_dir), snap.snapshot_catalog(td.fx_snapshots(spark, sf_dir)))


def _with_uuid(spark, sf_dir):
    """Analyses under ids of the reference's form, in no order of creation."""
    h = F.md5(F.col("analysis_id").cast("string"))
    uid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return td.fx_analyses(spark, sf_dir).withColumn("number", F.col("analysis_id")).withColumn("analysis_id", uid)


_UUID_SQL = "concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32])"


@register("analysis_by_id", with_fixtures(f"""
SELECT number, status, source, {_UUID_SQL} AS analysis_id FROM (SELECT analysis_id AS number, status, source, md5(CAST(analysis_id AS VARCHAR)) AS h FROM fx_analyses)
WHERE number = (SELECT max(analysis_id) FROM fx_analyses)""", "fx_analyses"))
def analysis_by_id(spark, sf_dir):
    """The last analysis, looked up in a table that is clustered by id."""
    folder, rows = _scratch(spark, "analyses"), _with_uuid(spark, sf_dir)
    docs.write_lookup(rows, folder)
    wanted = rows.orderBy(F.desc("number")).limit(1).first()["analysis_id"]
    return docs.analysis_by_id(spark.read.parquet(folder), wanted).select("number", "status", "source", "analysis_id")


@register("report_deep_page", with_fixtures("""
SELECT analysis_id, status, source FROM fx_analyses ORDER BY created_at DESC, analysis_id LIMIT 10 OFFSET 990""", "fx_analyses"))
def report_deep_page(spark, sf_dir):
    """Page 100 out of a table that is cut into blocks with a sparse index."""
    folder = _scratch(spark, "reports")
    rep.write_paged(td.fx_analyses(spark, sf_dir), folder)
    return rep.stored_page(spark, folder, 100).select("analysis_id", "status", "source")


# ---------------------------------------------------------------------------
# Sources and sinks as text and back (S06, S08-S12, S14, S16), path sets (U01), pending work (P18), index scope (P20)
# ---------------------------------------------------------------------------

def _document_texts(spark, sf_dir):
    """Analysis documents as JSON text: meta with times as text, params, and all results by file name."""
    a, f = td.fx_analyses(spark, sf_dir), td.fx_findings(spark, sf_dir)
    results = f.groupBy("analysis_id").agg(F.map_from_entries(F.collect_list(F.struct("filename", F.struct("ai_response")))).alias("results"))
    when = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    meta = F.struct(when("created_at").alias("created_at"), when("finished_at").alias("finished_at"), "status", "source",
                    F.to_json(F.struct("product", "repo_name")).alias("params"))
    return a.join(results, "analysis_id", "left").select("analysis_id", F.to_json(F.struct(meta.alias("meta"), "results")).alias("json"))


@register("document_texts", with_fixtures("""
SELECT a.analysis_id, a.status, a.source, a.product, a.repo_name, strftime(a.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(f.n, 0) AS n_results,
       coalesce(f.chars, 0) AS n_chars
FROM fx_analyses a LEFT JOIN (SELECT analysis_id, count(*) AS n, CAST(sum(length(ai_response)) AS BIGINT) AS chars FROM fx_findings GROUP BY analysis_id) f
  ON f.analysis_id = a.analysis_id""", "fx_analyses", "fx_findings"))
def document_texts(spark, sf_dir):
    """Analysis documents written as JSON text and parsed back into analyses and findings.

    The parsed documents are stored, so that each text is parsed once and not again for the findings.
    """
    texts, folder = _scratch(spark, "documents"), _scratch(spark, "parsed")
    _document_texts(spark, sf_dir).write.parquet(texts)
    docs.parse_documents(spark.read.parquet(texts)).write.parquet(folder)
    parsed = spark.read.parquet(folder)
    n = docs.findings_table(parsed).groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("ai_response")).alias("chars"))
    return (docs.analyses_table(parsed).join(n, "analysis_id", "left")
            .select("analysis_id", "status", "source", "product", "repo_name", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    F.coalesce("n", F.lit(0)).alias("n_results"), F.coalesce("chars", F.lit(0)).alias("n_chars")))


@register("analysis_sink", with_fixtures("""
SELECT strftime(created_at, '%Y-%m') AS created_month, CASE WHEN analysis_id % 7 = 0 THEN 'failed' ELSE status END AS status,
       CASE WHEN analysis_id % 7 = 0 THEN 'lost' END AS error, count(*) AS n FROM fx_analyses GROUP BY ALL""", "fx_analyses"))
def analysis_sink(spark, sf_dir):
    """Analyses with some marked failed, written by creation month and read back."""
    folder, a = _scratch(spark, "sink"), td.fx_analyses(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    failed = a.where(F.col("analysis_id") % 7 == 0).select("analysis_id", F.lit("lost").alias("error"))
    docs.write_analyses(docs.mark_failed(a, failed), folder, period="month")
    return (spark.read.parquet(folder).groupBy(F.col("created_month").cast("string").alias("created_month"), "status", "error")
            .agg(F.count(F.lit(1)).alias("n")))


@register("changed_documents", with_fixtures("""
SELECT analysis_id, revision, status FROM fx_document_log WHERE modified_at > (SELECT median(modified_at) FROM fx_document_log)""", "fx_document_log"))
def changed_documents(spark, sf_dir):
    """Document revisions newer than a mark; the mark is the middle of the log."""
    log = td.fx_document_log(spark, sf_dir)
    mark = log.agg(F.percentile(F.unix_micros(F.col("modified_at").cast("timestamp")), 0.5).alias("m"))
    return log.where(F.unix_micros(F.col("modified_at").cast("timestamp")) > mark.scalar()).select("analysis_id", "revision", "status")


@register("external_payloads", with_fixtures("""
SELECT CAST(analysis_id AS BIGINT) AS analysis_id, filename, ai_response, 'external scanner' AS source, len(l) AS n_labels, coalesce(l[1], '') AS first_label
FROM (SELECT f.analysis_id, f.filename, f.ai_response, list(b.cwe ORDER BY b.cwe_pos) FILTER (WHERE b.cwe IS NOT NULL) AS l
      FROM fx_findings f LEFT JOIN labels b ON b.analysis_id = f.analysis_id AND b.filename = f.filename GROUP BY ALL)""".replace("len(l)", "CAST(coalesce(len(l), 0) AS INTEGER)"),
    "fx_findings", ctes=[_MENTIONS, _LABELS]))
def external_payloads(spark, sf_dir):
    """Result payloads of another tool, one JSON text an analysis, with values of wrong types among them."""
    f = td.fx_findings(spark, sf_dir)
    result = F.struct("ai_response", F.array(F.lit("+ line")).alias("context"), F.lit(7).alias("vuln_severity"))
    texts = (f.groupBy("analysis_id").agg(F.map_from_entries(F.collect_list(F.struct("filename", result))).alias("results"))
             .select("analysis_id", F.to_json(F.struct(F.lit("external scanner, with a long name").alias("source"), "results")).alias("json")))
    rows = docs.ingest_payload(texts)
    return rows.select("analysis_id", "filename", "ai_response", F.rtrim(F.regexp_replace("source", ",.*", "")).alias("source"),
                       F.size("cwe").alias("n_labels"), F.coalesce(F.get("cwe", 0), F.lit("")).alias("first_label"))


@register("dimension_texts", with_fixtures("""
SELECT 'library' AS kind, name, repo_url, CASE WHEN CAST(id AS INT) % 5 = 0 THEN NOT auto_scan ELSE auto_scan END AS flag FROM fx_library WHERE CAST(id AS INT) % 9 <> 4
UNION ALL SELECT 'library', 'added ' || name, repo_url, NULL FROM fx_library WHERE CAST(id AS INT) % 9 = 4
UNION ALL SELECT 'product', product, repo_url, NULL FROM fx_products""", "fx_library", "fx_products"))
def dimension_texts(spark, sf_dir):
    """Products and libraries as JSON documents (one an organisation), parsed, and the list changed: some removed, toggled and added."""
    lib = td.fx_library(spark, sf_dir)
    texts = lib.groupBy(F.regexp_extract("repo_url", "github.com/([^/]+)", 1).alias("org")).agg(
        F.to_json(F.collect_list(F.struct("id", "name", "repo_url", "cpe", "last_version", "auto_scan"))).alias("json"))
    parsed = docs.library_from_json(texts)
    n = F.col("id").cast("int")
    changed = docs.library_toggle(docs.library_remove(parsed, parsed.where(n % 9 == 4)), parsed.where(n % 5 == 0))
    # names that the list still has are refused
    new = parsed.select(F.when(n % 9 == 4, F.concat(F.lit("added "), "name")).otherwise(F.col("name")).alias("name"), "repo_url")
    names = docs.library_add(changed, new)
    products = td.fx_products(spark, sf_dir).groupBy(F.substring("product", 1, 1).alias("c")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("product", F.struct("repo_url"))))).alias("json"))
    return (names.select(F.lit("library").alias("kind"), "name", "repo_url", F.col("auto_scan").alias("flag"))
            .unionByName(docs.products_from_json(products).select(F.lit("product").alias("kind"), F.col("product").alias("name"), "repo_url",
                                                                  F.lit(None).cast("boolean").alias("flag"))))


@register("cwe_catalogue", """
SELECT regexp_replace(printf('%03d', p_partkey), '^0+', '') AS cwe_id, p_type AS name FROM part WHERE p_partkey % 10 <> 0""")
def cwe_catalogue(spark, sf_dir):
    """A CWE catalogue in XML, some of its weaknesses without a name."""
    folder, p = _scratch(spark, "cwe"), td.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 10 != 0, F.col("p_type")).otherwise(F.lit(" "))
    element = F.format_string('<Weakness ID="%03d" Name="%s"><Description>x</Description></Weakness>', "p_partkey", name)
    # a catalogue is one document; there are sixteen of them, one a file
    text = F.concat(F.lit("<Weakness_Catalog>"), F.array_join(F.array_sort(F.collect_list(element)), ""), F.lit("</Weakness_Catalog>"))
    p.groupBy((F.col("p_partkey") % 16).alias("part")).agg(text.alias("text")).write.partitionBy("part").text(folder)
    return docs.cwe_dictionary(spark, folder)


@register("path_sets", with_fixtures("""
SELECT path, CASE WHEN bool_or(version = '1.0') AND bool_or(version = '2.0') THEN 'common' WHEN bool_or(version = '1.0') THEN 'deleted' ELSE 'added' END AS kind
FROM fx_trees WHERE version <> '1.1' GROUP BY path""", "fx_trees"))
def path_sets(spark, sf_dir):
    """Paths of two snapshots in common, deleted and added."""
    t = td.fx_trees(spark, sf_dir)
    sets = snap.path_sets(t.where("version = '1.0'"), t.where("version = '2.0'"))
    common, deleted, added = (s.withColumn("kind", F.lit(k)) for s, k in zip(sets, ("common", "deleted", "added"), strict=True))
    return common.unionByName(deleted).unionByName(added)


@register("pending_results", with_fixtures("""
SELECT analysis_id, filename FROM fx_findings f
WHERE length(ai_response) % 3 = 0 AND NOT EXISTS (SELECT 1 FROM cve_matches c WHERE c.analysis_id = f.analysis_id AND c.filename = f.filename AND result = 'Yes')""",
    "fx_findings", "fx_cve_checks", ctes=[_CVE_MATCHES]))
def pending_results(spark, sf_dir):
    """Results without an answer that nothing has scored yet; every third answer is taken away."""
    f = td.fx_findings(spark, sf_dir)
    open_ = f.withColumn("ai_response", F.when(F.length("ai_response") % 3 != 0, F.col("ai_response")))
    return stream.pending_feed(open_, cve_matches(spark, sf_dir).where("result = 'Yes'"), ["analysis_id", "filename"]).select("analysis_id", "filename")


@register("indexed_paths", with_fixtures("""
SELECT path FROM (
  SELECT CASE doc_id % 6 WHEN 0 THEN 'a/node_modules/' WHEN 1 THEN 'Vendor/' WHEN 2 THEN '.git/x/' WHEN 3 THEN 'src/' WHEN 4 THEN 'a/vendor_x/' ELSE '' END
         || 'f' || doc_id || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '.php' END AS path, doc_id FROM documents)
WHERE doc_id % 4 <> 0 AND doc_id % 6 > 2"""))
def indexed_paths(spark, sf_dir):
    """P20: paths that the symbol index takes: none below an excluded folder, and with an extension."""
    k = F.col("doc_id")
    folder = F.element_at(F.array(*map(F.lit, ["a/node_modules/", "Vendor/", ".git/x/", "src/", "a/vendor_x/", ""])), (k % 6 + 1).cast("int"))
    paths = td.table(spark, sf_dir, "documents").select(F.concat(folder, F.lit("f"), k.cast("string"), F.when(k % 4 == 0, "").otherwise(".php")).alias("path"))
    return paths.where(pth.index_path_kept("path"))


@register("diff_artifact_files", with_fixtures("""
SELECT p.pair_id, p.repo, '2024-05-01 12:00:00' AS generated_at, count(*) AS diff_count, count(*) AS n_files,
       CAST(sum(len(r.ls) + 3) AS BIGINT) AS n_lines, bit_xor(CAST('0x' || substr(sha256(r.path || r.diff), 1, 15) AS BIGINT)) AS digest
FROM review r JOIN pairs p ON p.pair_id = r.pair_id WHERE r.change_type <> 'modified' GROUP BY p.pair_id, p.repo""",
    "fx_trees", "fx_tree_tags", ctes=_compare_ctes(_STEP_SQL.format("1.1", "2.0"))))
def diff_artifact_files(spark, sf_dir):
    """Artefacts of added and deleted files with their diffs, written as JSON and read back."""
    folder, files = _scratch(spark, "artifacts"), td.fx_trees(spark, sf_dir)
    changes = snap.align(files, _tree_pairs(spark, sf_dir, "1.1", "2.0")).where("change_type <> 'modified'")
    snap.write_artifacts(snap.render_diffs(changes, files), folder, "2024-05-01 12:00:00")
    read = (snap.read_artifact_files(spark, folder).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.size("diff")).alias("n_lines"),
        F.bit_xor(F.conv(F.substring(F.sha2(F.concat("path", F.array_join("diff", "\n")), 256), 1, 15), 16, 10).cast("long")).alias("digest")))
    heads = spark.read.schema("pair_id string, repo string, diff_count long, generated_at timestamp").json(f"{folder}/headers")
    return heads.join(read, "pair_id").select("pair_id", "repo", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
                                              "diff_count", "n_files", "n_lines", "digest")


@register("request_windows", with_fixtures("""
SELECT user_id AS client, strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests,
       greatest(count(*) - 50, 0) AS over_limit FROM fx_access GROUP BY ALL""", "fx_access"))
def request_windows(spark, sf_dir):
    """Requests of each client in fixed windows, and those beyond the limit."""
    a = td.fx_access(spark, sf_dir).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    rows = stream.requests_per_window(a)
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


# ---------------------------------------------------------------------------
# Sources and composed jobs: F19, J11, P19, J09 + dictionary, W07, W09/S15, C06/A25/P22
# ---------------------------------------------------------------------------

from churnlens.functions import cwe as cwefn  # noqa: E402
from churnlens.plans import compare as cmp  # noqa: E402
from churnlens.sources import documents as docs  # noqa: E402


@register("product_info", with_fixtures("""
SELECT analysis_id,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') <> '' THEN coalesce(nullif(product, ''), repo_name)
       WHEN source = 'folder' THEN 'old' ELSE '' END AS product_name,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') = '' AND source = 'folder' THEN '/srv/p' || (analysis_id % 97) || '/old/'
       WHEN source <> 'folder' THEN '1.' || (analysis_id % 7) ELSE '' END AS old_version,
  CASE WHEN coalesce(nullif(product, ''), repo_name, '') = '' AND source = 'folder' AND analysis_id % 5 <> 0 THEN '/srv/q' || (analysis_id % 89) || '/new'
       WHEN source <> 'folder' THEN '1.' || (analysis_id % 7 + 1) ELSE '' END AS new_version
FROM fx_analyses""", "fx_analyses"))
def product_info(spark, sf_dir):
    return docs.product_info(_analyses_with_params(spark, sf_dir))


@register("product_repos", with_fixtures("""
SELECT a.analysis_id, a.product, p.repo_url FROM fx_analyses a JOIN fx_products p ON p.product = a.product""",
    "fx_analyses", "fx_products"))
def product_repos(spark, sf_dir):
    """Product analyses resolved to their repository (unknown product -> no row)."""
    return docs.resolve_products(td.fx_analyses(spark, sf_dir), td.fx_products(spark, sf_dir)).select("analysis_id", "product", "repo_url")


@register("auto_scan_candidates", with_fixtures("""
SELECT id, name, repo_url FROM fx_library WHERE auto_scan AND (starts_with(repo_url, 'https://github.com/') OR starts_with(repo_url, 'http://github.com/'))""",
    "fx_library"))
def auto_scan_candidates(spark, sf_dir):
    return docs.auto_scan_candidates(td.fx_library(spark, sf_dir)).select("id", "name", "repo_url")


def _cwe_dict(spark, sf_dir):
    """A CWE dictionary derived from parts: one name per id below 200 (bounded)."""
    p = td.table(spark, sf_dir, "part")
    return (p.groupBy(F.format_string("%03d", F.col("p_partkey") % 200).alias("cwe_id"))
            .agg(F.min(F.initcap("p_type")).alias("name")))


def _dict_text():
    return F.concat(F.col("ai_response"), F.lit(" (see also CWE-"), (F.col("analysis_id") % 50).cast("string"),
                    F.lit(" and CWE-"), (F.col("analysis_id") % 400).cast("string"), F.lit(")"))


_DICT_SQL = ("dict", """
SELECT regexp_replace(printf('%03d', p_partkey % 200), '^0+', '') AS id, min(upper(left(p_type, 1)) || lower(substr(p_type, 2))) AS name
FROM part GROUP BY 1""")
_DTEXT_SQL = ("dtext", """
SELECT analysis_id, filename, ai_response || ' (see also CWE-' || (analysis_id % 50) || ' and CWE-' || (analysis_id % 400) || ')' AS t
FROM fx_findings""")


@register("cwe_labels_dict", with_fixtures("""
SELECT analysis_id, filename, CAST(row_number() OVER (PARTITION BY analysis_id, filename ORDER BY pass, pos) - 1 AS INTEGER) AS cwe_pos,
       label AS cwe
FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, filename, norm ORDER BY pass, pos) AS k FROM (
        SELECT m.analysis_id, m.filename, 1 AS pass, m.pos, m.norm,
               'CWE-' || m.norm || CASE WHEN coalesce(d.name, m.name) <> '' THEN ': ' || coalesce(d.name, m.name) ELSE '' END AS label
        FROM dmentions m LEFT JOIN dict d ON d.id = m.norm
        UNION ALL
        SELECT b.analysis_id, b.filename, 2, b.pos, b.norm, 'CWE-' || b.norm || ': ' || d.name
        FROM (SELECT analysis_id, filename, regexp_replace(unnest(regexp_extract_all(t, 'CWE-(\\d+)', 1)), '^0+', '') AS norm,
                     unnest(generate_series(1, len(regexp_extract_all(t, 'CWE-(\\d+)', 1)))) AS pos FROM dtext) b
        JOIN dict d ON d.id = b.norm WHERE b.norm <> '' AND d.name <> ''))
WHERE k = 1""", "fx_findings", ctes=[_DICT_SQL, _DTEXT_SQL, ("dmentions", f"""
SELECT analysis_id, filename, pos, norm, name FROM (
  SELECT analysis_id, filename, pos, regexp_replace(raw_id, '^0+', '') AS norm, {osql.sanitize('raw_desc', 'raw_id')} AS name
  FROM (SELECT analysis_id, filename, unnest(ids) AS raw_id, unnest(descs) AS raw_desc, unnest(generate_series(1, len(ids))) AS pos
        FROM (SELECT analysis_id, filename, regexp_extract_all(t, '{osql.CWE_LABELLED_RE2}', 1) AS ids,
                     regexp_extract_all(t, '{osql.CWE_LABELLED_RE2}', 2) AS descs FROM dtext)))
WHERE norm <> ''""")]))
def cwe_labels_dict(spark, sf_dir):
    """F14 with a CWE dictionary (J09): names from the dictionary; bare ids it knows are added."""
    f = cwefn.with_dictionary(td.fx_findings(spark, sf_dir).withColumn("t", _dict_text()), _cwe_dict(spark, sf_dir), "names", "t", ["analysis_id", "filename"])
    return f.select("analysis_id", "filename",
                    F.posexplode(cwefn.extract_labels("t", F.col("names"))).alias("cwe_pos", "cwe"))


@register("row_index", with_fixtures("""
SELECT analysis_id, filename, row_number() OVER (PARTITION BY analysis_id ORDER BY filename) - 1 AS file_index FROM fx_findings""",
    "fx_findings"))
def row_index(spark, sf_dir):
    """Dense 0-based index of each result over the sorted file names of its analysis."""
    from churnlens.operators.sequence import index_within
    f = td.fx_findings(spark, sf_dir).select("analysis_id", "filename")
    return index_within(f, ["analysis_id"], [F.asc("filename")], out="file_index")


_REF_ITEMS = 17


def _refs_json_spark():
    k = F.col("event_id")
    items = []
    for i in range(_REF_ITEMS):
        m = i % 4
        if m == 0:
            items.append(F.concat(F.lit('"v'), (k % 4).cast("string"), F.lit(f'.{i}"')))
        elif m == 1:
            items.append(F.lit(str(i)))
        elif m == 2:
            items.append(F.concat(F.lit('" '), (k % 7).cast("string"), F.lit(f'.{i} "')))
        else:
            items.append(F.lit(f'"bad tag {i}"'))
    return F.concat(F.lit('{"refs":['), F.concat_ws(",", *items), F.lit("]}"))


def _refs_json_sql():
    items = []
    for i in range(_REF_ITEMS):
        m = i % 4
        items.append({0: f"'\"v' || (event_id % 4) || '.{i}\"'", 1: f"'{i}'",
                      2: f"'\" ' || (event_id % 7) || '.{i} \"'", 3: f"'\"bad tag {i}\"'"}[m])
    return "'{\"refs\":[' || " + " || ',' || ".join(items) + " || ']}'"


@register("tag_feed", with_fixtures(f"""
SELECT event_id AS repo, CAST(pos AS INTEGER) AS pos, tag FROM (
  SELECT event_id, pos, {osql.go_trim('json_extract_string(elem, \'$\')')} AS tag FROM (
    SELECT event_id, unnest(CAST(json_extract(j, '$.refs') AS JSON[])) AS elem,
           unnest(generate_series(0, CAST(json_array_length(j, '$.refs') AS BIGINT) - 1)) AS pos
    FROM (SELECT event_id, {_refs_json_sql()} AS j FROM events))
  WHERE pos < 15 AND json_type(elem) = 'VARCHAR')
WHERE regexp_full_match(tag, '[a-zA-Z0-9._-]+') AND length(tag) <= 50"""))
def tag_feed(spark, sf_dir):
    """S15 + W09: the first 15 refs of each feed, strings only, trimmed and validated."""
    e = td.table(spark, sf_dir, "events").select("event_id", _refs_json_spark().alias("json"))
    return ver.first_tags(ver.feed_refs(e.withColumnRenamed("event_id", "repo")), limit=15).select("repo", "pos", "tag")


def _projects(spark, sf_dir):
    d = td.table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", "[0-9]+$", 0).cast("int")
    lang = (F.when(n % 5 == 0, "php").when(n % 5 == 1, "javascript").when(n % 5 == 2, "python")
            .when(n % 5 == 3, "c").otherwise("ruby"))
    # the tree that holds files of the language; none of them has Ruby files
    repo = F.when(n % 5 == 1, "fr").when(n % 5 == 2, "de").when(n % 5 == 3, "es").otherwise("en")
    return d.select(F.col("source").alias("project"), lang.alias("language"), repo.alias("repo"),
                    F.lit("old").alias("version_1"), F.when(n % 7 == 6, "next").otherwise("new").alias("version_2"))


_PROJECTS_SQL = ("projects", """
SELECT source AS project,
  CASE CAST(regexp_extract(source, '[0-9]+$', 0) AS INT) % 5 WHEN 0 THEN 'php' WHEN 1 THEN 'javascript' WHEN 2 THEN 'python'
       WHEN 3 THEN 'c' ELSE 'ruby' END AS language,
  CASE CAST(regexp_extract(source, '[0-9]+$', 0) AS INT) % 5 WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'es' ELSE 'en' END AS repo,
  CASE WHEN CAST(regexp_extract(source, '[0-9]+$', 0) AS INT) % 7 = 6 THEN 'next' ELSE 'new' END AS version_2
FROM (SELECT DISTINCT source FROM documents)""")


@register("validation_batch", with_fixtures("""
SELECT p.project, CASE WHEN p.version_2 = 'new' THEN 'completed' ELSE 'error' END AS status,
       CAST(CASE WHEN p.version_2 = 'new' THEN coalesce(c.n, 0) ELSE 0 END AS BIGINT) AS file_count
FROM projects p LEFT JOIN (
  SELECT lang, count(*) AS n FROM (
    SELECT CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.php' THEN 'php' WHEN '.js' THEN 'javascript'
                WHEN '.py' THEN 'python' WHEN '.c' THEN 'c' END AS lang FROM changes) GROUP BY lang) c ON c.lang = p.language""",
    "fx_snapshots", ctes=_SNAP_CTES + [_PROJECTS_SQL]))
def validation_batch(spark, sf_dir):
    """C06 + P22: each project's pair compared within its language's extension scope."""
    summary, _ = cmp.validation_batch(td.fx_snapshots(spark, sf_dir), _projects(spark, sf_dir))
    return summary.select("project", "status", "file_count")


@register("validation_totals", with_fixtures("""
SELECT CAST(count(*) FILTER (WHERE found) AS BIGINT) AS success, CAST(count(*) FILTER (WHERE NOT found) AS BIGINT) AS failure
FROM (SELECT EXISTS (SELECT 1 FROM fx_snapshots s WHERE s.repo = p.repo AND s.version = 'old')
             AND EXISTS (SELECT 1 FROM fx_snapshots s WHERE s.repo = p.repo AND s.version = p.version_2) AS found FROM projects p)""",
    "fx_snapshots", ctes=[_PROJECTS_SQL]))
def validation_totals(spark, sf_dir):
    """Success / failure counts of a validation batch."""
    _, totals = cmp.validation_batch(td.fx_snapshots(spark, sf_dir), _projects(spark, sf_dir))
    return totals


@register("detail_batches", with_fixtures("""
SELECT analysis_id, vuln_type, filename, row_number() OVER (PARTITION BY analysis_id, vuln_type ORDER BY filename) - 1 AS detail_index,
       CAST(floor((row_number() OVER (PARTITION BY analysis_id, vuln_type ORDER BY filename) - 1) / 5) AS BIGINT) AS batch
FROM types""", "fx_findings", ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES]))
def detail_batches(spark, sf_dir):
    """Drill-down details per (analysis, type) by file name, in batches of five."""
    d = fnd.vuln_type_details(parsed_findings(spark, sf_dir)).select("analysis_id", "vuln_type", "filename")
    return fnd.detail_batches(d)


# ---------------------------------------------------------------------------
# Scalar functions over whole tables: F01-F05, F07, F08, F34, P03, P15-P17, S05
# ---------------------------------------------------------------------------

from churnlens.functions import paths as pth  # noqa: E402
from churnlens.functions import text as txt  # noqa: E402


def _byte_prefix_sql(x: str, n: int) -> str:
    return (f"left({x}, CAST(list_max(list_filter(range(0, {n} + 1), lambda k: strlen(left({x}, k)) <= {n})) AS BIGINT))")


@register("input_cleaning", with_fixtures(f"""
SELECT conv_id, turn,
  {osql.go_trim(_byte_prefix_sql("regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g')", 120))} AS clean_text,
  {osql.go_trim(_byte_prefix_sql("regexp_replace(text, '[\\x00\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g')", 300))} AS clean_prompt,
  CASE WHEN coalesce(role, '') = '' THEN 'unknown'
       WHEN regexp_replace(regexp_replace(lower(role), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'value'
       ELSE regexp_replace(regexp_replace(lower(role), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS role_slug
FROM conversations"""))
def input_cleaning(spark, sf_dir):
    """F01 / F02 / F03 over every conversation turn (byte cuts at 120 / 300)."""
    c = td.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", txt.clean_input("text", 120).alias("clean_text"),
                    txt.clean_prompt("text", 300).alias("clean_prompt"), txt.path_slug("role").alias("role_slug"))


@register("path_checks", with_fixtures(f"""
SELECT analysis_id, filename,
  lower(regexp_extract(regexp_extract(filename, '[^/]*$', 0), '(\\.[^.]*)$', 1)) AS ext,
  {_lang_sql('filename', _ANALYSIS, 'unknown')} AS language,
  {_lang_sql('filename', _DISPLAY, None)} AS display_language,
  regexp_extract(filename, '[^/]*$', 0) AS base_name,
  (coalesce(filename, '') <> '' AND strlen(filename) <= 255 AND NOT regexp_matches(filename, '\\.\\.|[:*?"<>|]')) AS valid_name
FROM fx_findings""", "fx_findings"))
def path_checks(spark, sf_dir):
    """F05-F08 + P03 over every finding's file name."""
    f = td.fx_findings(spark, sf_dir)
    return f.select("analysis_id", "filename", pth.extension("filename").alias("ext"),
                    pth.analysis_language("filename").alias("language"),
                    pth.display_language("filename").alias("display_language"),
                    pth.basename("filename").alias("base_name"), pth.valid_filename("filename").alias("valid_name"))


@register("library_checks", with_fixtures("""
SELECT id, regexp_extract(regexp_replace(repo_url, '/$', ''), '[^/]*$', 0) AS repo_name,
  starts_with(repo_url, 'https://github.com/') OR starts_with(repo_url, 'http://github.com/') AS valid_url,
  coalesce(regexp_full_match(last_version, '[a-zA-Z0-9._-]+') AND length(last_version) <= 50, FALSE) AS valid_version,
  cpe || ':' || replace(last_version, '-', ':') AS cpe_name
FROM fx_library""", "fx_library"))
def library_checks(spark, sf_dir):
    """F04, P15, P16, F21 over the library dimension."""
    from churnlens.operators.enrich import cpe_name
    l = td.fx_library(spark, sf_dir)
    return l.select("id", pth.repo_name("repo_url").alias("repo_name"), pth.valid_repo_url("repo_url").alias("valid_url"),
                    pth.valid_version("last_version").alias("valid_version"),
                    cpe_name("cpe", "last_version").alias("cpe_name"))


def _uuid_text():
    h = F.md5(F.col("event_id").cast("string"))
    canon = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                        F.substring(h, 17, 4), F.substring(h, 21, 12))
    k = F.col("event_id") % 5
    return (F.when(k == 0, canon).when(k == 1, F.concat(F.lit("{"), canon, F.lit("}")))
            .when(k == 2, F.concat(F.lit("urn:uuid:"), canon)).when(k == 3, h).otherwise(F.substring(h, 1, 30)))


def _ip_cols():
    k = F.col("event_id")
    xff = F.when(k % 3 == 0, F.format_string(" 10.0.%d.%d , 192.168.0.1", k % 256, F.col("user_id") % 256))
    addr = F.when(k % 2 == 0, F.format_string("172.16.%d.%d:%d", F.col("user_id") % 256, k % 256, 1024 + k % 5000)) \
        .otherwise(F.format_string("[::%d]:%d", F.col("user_id"), 80 + k % 7))
    return xff, addr


@register("request_checks", with_fixtures("""
SELECT event_id, regexp_full_match(uuid_text, '(?:urn:uuid:)?\\{?[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}\\}?') AS valid_uuid,
       CASE WHEN coalesce(xff, '') <> '' THEN trim(split_part(xff, ',', 1)) ELSE regexp_replace(addr, ':[^:]*$', '') END AS client_ip
FROM (SELECT event_id,
        CASE event_id % 5 WHEN 0 THEN h8 || '-' || h4a || '-' || h4b || '-' || h4c || '-' || h12
                          WHEN 1 THEN '{' || h8 || '-' || h4a || '-' || h4b || '-' || h4c || '-' || h12 || '}'
                          WHEN 2 THEN 'urn:uuid:' || h8 || '-' || h4a || '-' || h4b || '-' || h4c || '-' || h12
                          WHEN 3 THEN h ELSE left(h, 30) END AS uuid_text,
        CASE WHEN event_id % 3 = 0 THEN ' 10.0.' || (event_id % 256) || '.' || (user_id % 256) || ' , 192.168.0.1' END AS xff,
        CASE WHEN event_id % 2 = 0 THEN '172.16.' || (user_id % 256) || '.' || (event_id % 256) || ':' || (1024 + event_id % 5000)
             ELSE '[::' || user_id || ']:' || (80 + event_id % 7) END AS addr
      FROM (SELECT event_id, user_id, md5(CAST(event_id AS VARCHAR)) AS h,
                   substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS h8, substr(md5(CAST(event_id AS VARCHAR)), 9, 4) AS h4a,
                   substr(md5(CAST(event_id AS VARCHAR)), 13, 4) AS h4b, substr(md5(CAST(event_id AS VARCHAR)), 17, 4) AS h4c,
                   substr(md5(CAST(event_id AS VARCHAR)), 21, 12) AS h12 FROM events))"""))
def request_checks(spark, sf_dir):
    """P17 (UUID forms) and F34 (client address) over every event."""
    e = td.table(spark, sf_dir, "events")
    xff, addr = _ip_cols()
    return e.select("event_id", pth.valid_uuid(_uuid_text()).alias("valid_uuid"),
                    pth.client_ip(xff, addr).alias("client_ip"))


@register("archive_integrity", with_fixtures("""
SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS archive_sha256, CAST(strlen(text) AS BIGINT) AS archive_size,
       CASE WHEN strlen(text) < 1024 THEN 'too_small' WHEN n_chars IS NOT NULL AND strlen(text) <> n_chars THEN 'size_mismatch'
            ELSE 'ok' END AS status
FROM documents"""))
def archive_integrity(spark, sf_dir):
    """S05 over every document treated as a downloaded archive (declared size = n_chars)."""
    d = td.table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"),
                 F.col("n_chars").alias("declared_size"))
    return snap.archive_integrity(a)


@register("summary_with_focus", with_fixtures(f"""
SELECT s.analysis_id, s.product_name, s.vuln_count, f.focus_type
FROM (SELECT r.analysis_id, pi.product_name, r.vuln_count FROM roll r JOIN pinfo pi ON pi.analysis_id = r.analysis_id) s
LEFT JOIN (SELECT analysis_id, min({{'miss': CASE WHEN lower(vuln_type) = '{FOCUS}' THEN 0 ELSE 1 END, 'r': type_rank, 't': vuln_type}}).t AS focus_type
           FROM (SELECT analysis_id, vuln_type, row_number() OVER (PARTITION BY analysis_id ORDER BY type_count DESC, vuln_type) AS type_rank
                 FROM (SELECT analysis_id, vuln_type, count(*) AS type_count FROM types GROUP BY analysis_id, vuln_type))
           GROUP BY analysis_id) f ON f.analysis_id = s.analysis_id""",
    "fx_analyses", "fx_findings", ctes=[_PARSED, _MENTIONS, _LABELS, _TYPES, _ROLL, ("pinfo", _PINFO_SQL)]))
def summary_with_focus(spark, sf_dir):
    """A21 + P14: each analysis summary with its focus type (requested type, else its top type)."""
    parsed = parsed_findings(spark, sf_dir)
    s = fnd.analysis_summary(_analyses_with_params(spark, sf_dir), parsed)
    focus = rep.focus_type(fnd.vuln_type_counts(parsed), FOCUS)
    return s.select("analysis_id", "product_name", "vuln_count").join(focus, "analysis_id", "left")
