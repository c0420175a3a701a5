"""The dashboard bundle — every metric (A01-A17) as rows (metric, key, value) from one load.

Findings and CVE checks are read once and summed per (analysis, metric, key) in each task;
those sums meet the analyses once, and what each joined row adds to each metric is summed again.
That table of totals is written once to the checkpoint folder; it holds a row per
metric and key, so everything after it (top lists, ratios, means) is small and nothing stays in memory.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions import paths as pth
from churnlens.functions import responses as rs
from churnlens.operators import dashboards as dash
from churnlens.operators.reports import MOVING_WINDOW
from churnlens.session import cut_lineage

#: Metrics of which the largest keys are listed, and how many.
TOP = {"top_cwes": 10, "active_repos": 10, "product_activity": 10, "language_products": 5, "language_library": 5, "language_folder": 5}
#: Metrics that are listed as they are.
PLAIN = ["total_completed", "active_running", "total_vulns", "total_files_analyzed", "vulns_by_product", "total_matches", "analyses_with_checks",
         "confirmed", "uncertain", "monitored_libraries", "auto_scan_enabled", "version_checks", "analyses_per_day", "trend_day", "trend_week",
         "trend_month", "total_configured", "product_analyses", "cached_versions", "size_bytes"]
#: Totals that are there even if nothing adds to them.
ALWAYS = [m for m in PLAIN if m not in ("vulns_by_product", "analyses_per_day", "trend_day", "trend_week", "trend_month")]
NANO = 1_000_000_000


def _part(when: Column, metric: str | Column, key: Column | str = "", value: Column | int = 1) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(lit(metric).alias("metric"), lit(key).alias("key"), lit(value).cast("decimal(20,0)").alias("value")))


def _explode(rows: DataFrame, parts: list[Column], *carry: str, more: Column | None = None) -> DataFrame:
    some = F.array_compact(F.array(*parts))
    return rows.select(*carry, F.explode(some if more is None else F.concat(some, more)).alias("p")).select(*carry, "p.metric", "p.key", "p.value")


def _facts(analyses: DataFrame, findings: DataFrame, cve_matches: DataFrame) -> DataFrame:
    """analysis_id, metric, key, value: what findings and checks add up to in each analysis; every analysis has its two counts."""
    yes = F.lit(True)
    confidence = rs.confidence_class("vulnerability_status")
    language = pth.display_language("filename")
    of_label = F.transform("cwe", lambda c: F.struct(F.lit("top_cwes").alias("metric"), c.alias("key"), F.lit(1).cast("decimal(20,0)").alias("value")))
    f = _explode(findings, [_part(yes, "n_results"), _part(yes, "vulns", value=F.size("cwe")), _part(confidence == "confirmed", "confirmed"),
                            _part(confidence == "uncertain", "uncertain"), _part(language.isNotNull(), "language", language)], "analysis_id", more=of_label)
    c = _explode(cve_matches, [_part(yes, "checks"), _part(F.col("result") == "Yes", "yes")], "analysis_id")
    a = _explode(analyses, [_part(yes, "n_results", value=0), _part(yes, "vulns", value=0)], "analysis_id")
    return f.unionByName(c).unionByName(a).groupBy("analysis_id", "metric", "key").agg(F.sum("value").alias("value"))


def _of_analyses(analyses: DataFrame, facts: DataFrame) -> DataFrame:
    """metric, key, value of everything that is counted over analyses."""
    v, metric, key = F.col("value"), F.col("metric"), F.col("key")
    files, vulns = metric == "n_results", metric == "vulns"
    done = F.col("status") == dash.COMPLETED
    library = done & F.col("source").isin(*dash.LIBRARY_SOURCES)
    took = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    bucket = F.lit(None).cast("string")
    for limit, name in reversed(dash.SCALE_BUCKETS):
        bucket = F.when(v <= limit, F.lit(name)).otherwise(bucket)
    timed = files & done & F.col("finished_at").isNotNull() & (took > 0) & bucket.isNotNull()
    named = F.coalesce(dash.dashboard_product_name(), F.lit("")) != ""
    product = F.col("product").isNotNull()
    parts = [_part(files & done, "total_completed"), _part(files & F.col("status").isin(*dash.ACTIVE_STATUSES), "active_running"),
             _part(files & done, "total_files_analyzed", value=v), _part(files & done, "analyses_per_day", dash.period_key("day")),
             _part(files & library & F.col("repo_name").isNotNull(), "active_repos", F.col("repo_name")),
             _part(files & done & product, "product_activity", F.col("product")), _part(files & done & product, "product_analyses"),
             _part(timed, "duration_us", bucket, took), _part(timed, "duration_n", bucket),
             _part(vulns & done, "total_vulns", value=v), _part(vulns & done & (v > 0), "vuln_analyses"),
             _part(vulns & done & (v > 0) & named, "vulns_by_product", dash.dashboard_product_name(), v),
             *[_part(vulns & library, f"trend_{p}", dash.period_key(p), v) for p in ("day", "week", "month")],
             _part(metric.isin("top_cwes", "confirmed", "uncertain") & done, metric, key, v),
             _part((metric == "language") & done, F.concat(F.lit("language_"), dash.language_category()), key, v),
             _part((metric == "yes") & done, "total_matches", value=v), _part((metric == "yes") & done & (v > 0), "matched"),
             _part((metric == "checks") & done, "analyses_with_checks")]
    # one array per joined row; the key column is written over by the parts
    return _explode(facts.join(analyses, "analysis_id"), parts)


def totals(analyses: DataFrame, findings: DataFrame, cve_matches: DataFrame, library: DataFrame, products: DataFrame,
           access: DataFrame, catalog: DataFrame, window: int = MOVING_WINDOW) -> DataFrame:
    """metric, key, value: all sums that the metrics are made of, written once."""
    yes = F.lit(True)
    last = access.where(F.col("kind") == "download").orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    rows = [_of_analyses(analyses, _facts(analyses, findings, cve_matches)),
            _explode(library, [_part(yes, "monitored_libraries"), _part(F.col("auto_scan"), "auto_scan_enabled"),
                               _part(F.col("last_checked").isNotNull(), "version_checks")]),
            _explode(products, [_part(yes, "total_configured")]),
            _explode(access, [_part(F.col("kind") == "hit", "hits"), _part(F.col("kind") == "miss", "misses")]),
            _explode(last, [_part(yes, "download_ns", value=F.col("value").cast("decimal(38,9)") * NANO), _part(yes, "download_n")]),
            _explode(catalog, [_part(yes, "cached_versions"), _part(yes, "size_bytes", value=F.col("size_bytes"))])]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return cut_lineage(every.groupBy("metric", "key").agg(F.sum("value").alias("value")))


def dashboard_table(sums: DataFrame) -> DataFrame:
    """metric, key, value (double) of the dashboard, from :func:`totals`."""
    value = F.col("value").cast("double").alias("value")
    plain = sums.where(F.col("metric").isin(PLAIN)).select("metric", "key", value)
    best = Window.partitionBy("metric").orderBy(F.desc("value"), "key")
    most = F.create_map(*[F.lit(x) for kv in TOP.items() for x in kv])
    top = (sums.where(F.col("metric").isin(list(TOP))).withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(TOP.values()))
           .where(F.col("n") <= F.element_at(most, F.col("metric"))).select("metric", "key", value))
    mean = (sums.where(F.col("metric").isin("duration_us", "duration_n")).groupBy("key").agg(
                F.sum(F.when(F.col("metric") == "duration_us", F.col("value"))).alias("us"), F.sum(F.when(F.col("metric") == "duration_n", F.col("value"))).alias("n"))
            .select(F.lit("duration_by_scale").alias("metric"), "key", F.floor(F.col("us") / F.col("n") / 1_000_000).cast("double").alias("value")))

    names = [*ALWAYS, "vuln_analyses", "matched", "hits", "misses", "download_n"]
    total = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("value"))), F.lit(0))
    # seconds as a decimal first, so that the mean is rounded once
    seconds = (total("download_ns").cast("decimal(29,0)") * F.lit(Decimal("0.000000001"))).cast("decimal(38,9)").cast("double")
    one = (sums.where(F.col("metric").isin([*names, "download_ns"]))
           .agg(*[total(m).cast("double").alias(m) for m in names], seconds.alias("download_s")))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    seen = F.col("hits") + F.col("misses")
    hit_rate = F.when(seen > 0, F.col("hits") / seen * 100).otherwise(F.lit(0.0))
    saved = F.when((hit_rate > 0) & (F.col("size_bytes") > 0), F.floor(F.col("hits") * (F.col("size_bytes") / F.col("cached_versions")))).otherwise(F.lit(0))
    made = {"avg_vulns_per_analysis": ratio("total_vulns", "total_completed"), "detection_rate": ratio("vuln_analyses", "total_completed") * 100,
            "match_rate": ratio("matched", "analyses_with_checks") * 100, "avg_coverage": ratio("product_analyses", "total_configured"),
            "hit_rate": hit_rate, "avg_download_s": ratio("download_s", "download_n"), "disk_space_saved": saved}
    # totals that nothing added to are zero rows
    zero = {m: F.when(F.col(m) == 0, F.lit(0.0)) for m in ALWAYS}
    single = one.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("").alias("key"), c.cast("double").alias("value"))
                                            for m, c in {**made, **zero}.items()])).alias("p")).select("p.*").where("value is not null")
    listed = plain.where(~((F.col("value") == 0) & F.col("metric").isin(ALWAYS)))
    return listed.unionByName(top).unionByName(mean).unionByName(single)


def dashboard_bundle(analyses: DataFrame, findings: DataFrame, cve_matches: DataFrame, library: DataFrame, products: DataFrame,
                     access: DataFrame, catalog: DataFrame) -> DataFrame:
    """The whole dashboard as metric, key, value; mean ages (A12) need a clock and stay apart (:func:`dashboards.avg_time_by_source`)."""
    return dashboard_table(totals(analyses, findings, cve_matches, library, products, access, catalog))
