"""Dashboard metrics over analyses and findings.

Inputs
  analyses: analysis_id, created_at, finished_at, status, source, product, repo_name
            (``product`` / ``repo_name`` null = parameter absent)
  findings: analysis_id, filename, vulnerability_status, cwe (parsed, see findings.py)

Each metric is its own DataFrame.  All of them start from ``rollup`` (one
row per analysis with its file and vulnerability counts), which is a
partial+final aggregation of findings joined to analyses on the id; a
dashboard bundle caches it once and derives every metric from it.
Top-k metrics aggregate first and rank the aggregated rows, so the window
never sees more rows than distinct labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions import paths as pth
from churnlens.functions import responses as rs
from churnlens.operators.findings import vuln_count_per_analysis

# Status and source families.
COMPLETED = "completed"
ACTIVE_STATUSES = ["running", "in_progress", "analyzing"]
LIBRARY_SOURCES = ["library", "library_auto", "cve_auto"]
SCALE_BUCKETS = [(10, "10_files"), (100, "100_files"), (1000, "1000_files")]


def rollup(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Analyses with n_results and vuln_count (A18); analyses without findings get 0."""
    per = vuln_count_per_analysis(findings)
    return (analyses.join(per, "analysis_id", "left")
            .withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("bigint"))
            .withColumn("vuln_count", F.coalesce("vuln_count", F.lit(0)).cast("bigint")))


def _completed(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == COMPLETED)


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def top_k(df: DataFrame, label: str, count: str, k: int, rank: str = "rank",
          partition: list[str] | None = None) -> DataFrame:
    """K largest counts (ties by label ascending) over aggregated rows.

    Without a partition this is ``orderBy().limit(k)``: each task keeps its
    own top k and only k rows per task are merged, so no task sees all
    labels; the rank is then numbered over those k rows.  With a partition
    (a bounded set of groups such as the three language categories) the
    ranking window runs per group over already-aggregated rows.
    """
    order = [F.desc(count), F.asc(label)]
    if not partition:
        top = df.orderBy(*order).limit(k)
        return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# --------------------------------------------------------------------------- A01, A09

def analysis_kpis(roll: DataFrame) -> DataFrame:
    done = F.col("status") == COMPLETED
    agg = roll.agg(
        F.sum(F.when(done, 1).otherwise(0)).cast("bigint").alias("total_completed"),
        F.sum(F.when(F.col("status").isin(*ACTIVE_STATUSES), 1).otherwise(0)).cast("bigint").alias("active_running"),
        F.sum(F.when(done, F.col("vuln_count")).otherwise(0)).cast("bigint").alias("total_vulns"),
        F.sum(F.when(done & (F.col("vuln_count") > 0), 1).otherwise(0)).cast("bigint").alias("vuln_analyses"),
        F.sum(F.when(done, F.col("n_results")).otherwise(0)).cast("bigint").alias("total_files_analyzed"))
    return agg.select(
        F.coalesce("total_completed", F.lit(0)).alias("total_completed"),
        F.coalesce("active_running", F.lit(0)).alias("active_running"),
        F.coalesce("total_vulns", F.lit(0)).alias("total_vulns"),
        _safe_div(F.col("total_vulns"), F.col("total_completed")).alias("avg_vulns_per_analysis"),
        (_safe_div(F.col("vuln_analyses"), F.col("total_completed")) * 100).alias("detection_rate"),
        F.coalesce("total_files_analyzed", F.lit(0)).alias("total_files_analyzed"))


# --------------------------------------------------------------------------- A02

def dashboard_product_name() -> Column:
    """Q5 (dashboards): product when the parameter is present, else repo_name."""
    return F.when(F.col("product").isNotNull(), F.col("product")).otherwise(F.col("repo_name"))


def vulns_by_product(roll: DataFrame) -> DataFrame:
    return (_completed(roll).withColumn("product_name", dashboard_product_name())
            .where((F.coalesce("product_name", F.lit("")) != "") & (F.col("vuln_count") > 0))
            .groupBy("product_name").agg(F.sum("vuln_count").cast("bigint").alias("vuln_count")))


# --------------------------------------------------------------------------- A03

def top_cwes(analyses: DataFrame, findings: DataFrame, k: int = 10) -> DataFrame:
    """Top-k labels over all results of completed analyses (no relevance filter, no dedupe)."""
    done = analyses.where(F.col("status") == COMPLETED).select("analysis_id")
    counts = (findings.join(done, "analysis_id", "left_semi")
              .select(F.explode("cwe").alias("cwe"))
              .groupBy("cwe").agg(F.count(F.lit(1)).alias("cwe_count")))
    return top_k(counts, "cwe", "cwe_count", k, "cwe_rank")


# --------------------------------------------------------------------------- A04

def cve_match_rate(analyses: DataFrame, cve_matches: DataFrame) -> DataFrame:
    """cve_matches: analysis_id, filename, cve_id, result ('Yes'/'No')."""
    done = analyses.where(F.col("status") == COMPLETED).select("analysis_id")
    per = (cve_matches.join(done, "analysis_id", "left_semi")
           .groupBy("analysis_id")
           .agg(F.sum(F.when(F.col("result") == "Yes", 1).otherwise(0)).alias("yes"),
                F.count(F.lit(1)).alias("checks")))
    agg = per.agg(F.sum("yes").cast("bigint").alias("total_matches"),
                  F.sum(F.when(F.col("checks") > 0, 1).otherwise(0)).cast("bigint").alias("checked"),
                  F.sum(F.when(F.col("yes") > 0, 1).otherwise(0)).cast("bigint").alias("matched"))
    return agg.select(F.coalesce("total_matches", F.lit(0)).alias("total_matches"),
                      F.coalesce("checked", F.lit(0)).alias("analyses_with_checks"),
                      (_safe_div(F.col("matched"), F.col("checked")) * 100).alias("match_rate"))


# --------------------------------------------------------------------------- A05

def duration_seconds(start="created_at", end="finished_at") -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp"))
            - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1e6)


def duration_by_scale(roll: DataFrame) -> DataFrame:
    d = duration_seconds()
    bucket = F.lit(None).cast("string")
    for limit, name in reversed(SCALE_BUCKETS):
        bucket = F.when(F.col("n_results") <= limit, F.lit(name)).otherwise(bucket)
    return (_completed(roll).where(F.col("finished_at").isNotNull() & (d > 0))
            .select(bucket.alias("bucket"), d.alias("d")).where(F.col("bucket").isNotNull())
            .groupBy("bucket").agg(F.avg("d").cast("bigint").alias("avg_duration_s")))


# --------------------------------------------------------------------------- A06

def confidence_levels(analyses: DataFrame, findings: DataFrame, strict: bool = False) -> DataFrame:
    """Counts of confirmed / uncertain results of completed analyses.

    Default keeps Q1: 'AI: No vulnerabilities' contains 'vulnerabilities' and
    counts as confirmed.  ``strict=True`` classifies on the normalised status.
    """
    done = analyses.where(F.col("status") == COMPLETED).select("analysis_id")
    f = findings.join(done, "analysis_id", "left_semi")
    if strict:
        cls = (F.when(F.col("status_normalized") == "yes", "confirmed")
               .when(F.col("status_normalized") == "not_sure", "uncertain"))
    else:
        cls = rs.confidence_class("vulnerability_status")
    agg = f.select(cls.alias("c")).agg(
        F.sum(F.when(F.col("c") == "confirmed", 1).otherwise(0)).cast("bigint").alias("confirmed"),
        F.sum(F.when(F.col("c") == "uncertain", 1).otherwise(0)).cast("bigint").alias("uncertain"))
    return agg.select(F.coalesce("confirmed", F.lit(0)).alias("confirmed"),
                      F.coalesce("uncertain", F.lit(0)).alias("uncertain"))


# --------------------------------------------------------------------------- A07, A08

def library_kpis(library: DataFrame) -> DataFrame:
    return library.agg(F.count(F.lit(1)).alias("monitored_libraries"),
                       F.sum(F.when(F.col("auto_scan"), 1).otherwise(0)).cast("bigint").alias("auto_scan_enabled"),
                       F.count("last_checked").alias("version_checks"),
                       F.lit(0).cast("bigint").alias("new_versions_detected"))


def active_repos(analyses: DataFrame, k: int = 10) -> DataFrame:
    key = F.col("repo_name")
    if "repo_url" in analyses.columns:
        key = F.coalesce(F.col("repo_name"), F.col("repo_url"))
    counts = (_completed(analyses).where(F.col("source").isin(*LIBRARY_SOURCES))
              .select(key.alias("repo")).where(F.col("repo").isNotNull())
              .groupBy("repo").agg(F.count(F.lit(1)).alias("analyses_count")))
    return top_k(counts, "repo", "analyses_count", k, "repo_rank")


# --------------------------------------------------------------------------- A11-A15

def analyses_per_day(analyses: DataFrame) -> DataFrame:
    return (_completed(analyses).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).alias("analyses_count")))


def avg_time_by_source(analyses: DataFrame, as_of: str, mtime: str = "modified_at") -> DataFrame:
    """Mean age (seconds since the document's mtime) per source, at ``as_of``."""
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col(mtime).cast("timestamp"))) / F.lit(1e6)
    src = F.when(F.coalesce("source", F.lit("")) == "", F.lit("unknown")).otherwise(F.col("source"))
    return (_completed(analyses).where(F.col(mtime).isNotNull())
            .groupBy(src.alias("source")).agg(F.avg(age).alias("avg_age_s")))


def period_key(period: str, ts: str = "created_at") -> Column:
    """day 'yyyy-MM-dd', ISO week 'YYYY-Www', month 'yyyy-MM'."""
    t = F.col(ts)
    if period == "day":
        return F.date_format(t, "yyyy-MM-dd")
    if period == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t))
    if period == "month":
        return F.date_format(t, "yyyy-MM")
    raise ValueError(period)


def vuln_trend(roll: DataFrame, period: str) -> DataFrame:
    """Vulnerabilities of completed library-family analyses per period, oldest first.

    The sort runs on aggregated rows (one per period), so it is cheap.
    """
    return (_completed(roll).where(F.col("source").isin(*LIBRARY_SOURCES))
            .groupBy(period_key(period).alias("period"))
            .agg(F.sum("vuln_count").cast("bigint").alias("vuln_count"))
            .orderBy("period"))


# --------------------------------------------------------------------------- A16

def product_activity(analyses: DataFrame, k: int = 10) -> DataFrame:
    counts = (_completed(analyses).where(F.col("product").isNotNull())
              .groupBy(F.col("product").alias("product_name")).agg(F.count(F.lit(1)).alias("analyses_count")))
    return top_k(counts, "product_name", "analyses_count", k, "product_rank")


def product_kpis(analyses: DataFrame, products: DataFrame) -> DataFrame:
    """Configured products, completed product analyses, and their ratio (one row)."""
    marks = (products.select(F.lit(1).alias("c"), F.lit(0).alias("a"))
             .unionByName(_completed(analyses).where(F.col("product").isNotNull())
                          .select(F.lit(0).alias("c"), F.lit(1).alias("a"))))
    agg = marks.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("total_configured"),
                    F.coalesce(F.sum("a"), F.lit(0)).cast("bigint").alias("total_analyses"))
    return agg.select("total_configured", "total_analyses",
                      _safe_div(F.col("total_analyses"), F.col("total_configured")).alias("avg_coverage"))


# --------------------------------------------------------------------------- A17

def language_category() -> Column:
    """Q4/Q6: product key present -> products; library family -> library; else folder."""
    return (F.when(F.col("product").isNotNull(), F.lit("products"))
            .when(F.col("source").isin(*LIBRARY_SOURCES), F.lit("library"))
            .otherwise(F.lit("folder")))


def language_mix(analyses: DataFrame, findings: DataFrame, k: int = 5) -> DataFrame:
    cats = _completed(analyses).select("analysis_id", language_category().alias("category"))
    counts = (findings.select("analysis_id", pth.display_language("filename").alias("language"))
              .where(F.col("language").isNotNull())
              .groupBy("analysis_id", "language").agg(F.count(F.lit(1)).alias("n"))
              .join(cats, "analysis_id")
              .groupBy("category", "language").agg(F.sum("n").cast("bigint").alias("file_count")))
    return top_k(counts, "language", "file_count", k, "language_rank", partition=["category"])
