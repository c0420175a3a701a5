"""Findings model: parse answers, count vulnerabilities and types.

``findings`` is keyed by (analysis_id, filename).  Every operator here is
an aggregation with a partial (map-side) phase, or a projection, so a hot
analysis holding a large share of all findings is combined in many tasks
before its few output rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions import cwe as cwefn
from churnlens.functions import responses as rs
from churnlens.functions.text import go_trim
from churnlens.operators.sequence import index_within


def parse_findings(findings: DataFrame, cwe_names: Column | None = None) -> DataFrame:
    """Add vulnerability_status, status_normalized, vuln_severity and cwe to raw answers."""
    st = rs.response_status("ai_response")
    return (findings
            .withColumn("_st", st)
            .withColumn("vulnerability_status", F.col("_st.text"))
            .withColumn("status_normalized", F.col("_st.normalized"))
            .withColumn("vuln_severity", rs.response_severity("ai_response"))
            .withColumn("cwe", cwefn.extract_labels("ai_response", cwe_names))
            .drop("_st"))


def vulnerability_types(cwe) -> Column:
    """Distinct trimmed labels of one finding, or ['Uncategorized'] when none."""
    c = F.col(cwe) if isinstance(cwe, str) else cwe
    labels = F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")),
                                                   lambda x: go_trim(x)), lambda x: x != ""))
    return F.when(F.size(labels) == 0, F.array(F.lit(rs.UNCATEGORIZED))).otherwise(labels)


def relevant(findings: DataFrame) -> DataFrame:
    """P10 over parsed findings (normalised status with the F18 fallback)."""
    norm = rs.normalized_status("status_normalized", "ai_response", "vulnerability_status")
    return findings.withColumn("status_normalized", F.lower(norm)).where(rs.is_relevant("status_normalized"))


def vuln_count_per_analysis(findings: DataFrame) -> DataFrame:
    """vuln_count = sum of CWE labels over all results, results = number of files."""
    return (findings.groupBy("analysis_id")
            .agg(F.sum(F.size("cwe")).cast("bigint").alias("vuln_count"),
                 F.count(F.lit(1)).alias("n_results")))


def vuln_type_rows(findings: DataFrame) -> DataFrame:
    """Per analysis, count of relevant results per type (unranked)."""
    return (relevant(findings)
            .select("analysis_id", F.explode(vulnerability_types("cwe")).alias("vuln_type"))
            .groupBy("analysis_id", "vuln_type").agg(F.count(F.lit(1)).alias("type_count")))


def vuln_type_counts(findings: DataFrame) -> DataFrame:
    """A19 + O02: per analysis, count of relevant results per type, ranked.

    Ranking uses the skew-safe position index: labels carry free text, so a
    hot analysis can have as many distinct types as findings, and a plain
    per-analysis window would put all of them in one task.
    """
    counts = vuln_type_rows(findings)
    ranked = index_within(counts, ["analysis_id"], [F.desc("type_count"), F.asc("vuln_type")], out="_pos")
    return ranked.withColumn("type_rank", (F.col("_pos") + 1).cast("int")).drop("_pos")


def vuln_type_details(findings: DataFrame, vuln_type: str | None = None) -> DataFrame:
    """One detail row per relevant finding and type (optionally one type)."""
    out = (relevant(findings)
           .select("analysis_id", F.explode(vulnerability_types("cwe")).alias("vuln_type"), "filename",
                   "vulnerability_status", "status_normalized", "vuln_severity"))
    if vuln_type is not None:
        if vuln_type.strip() == "":
            raise ValueError("vulnerability type is required")
        out = out.where(F.col("vuln_type") == vuln_type)
    return out


def detail_batches(details: DataFrame, size: int = 5) -> DataFrame:
    """Details of each (analysis, type) ordered by file name, numbered in batches of ``size``."""
    idx = index_within(details, ["analysis_id", "vuln_type"], [F.asc("filename")], out="detail_index")
    return idx.withColumn("batch", (F.col("detail_index") / size).cast("bigint"))


def analysis_summary(analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """Per analysis, files, vuln_count (A18), relevant types (A19), product and versions."""
    from churnlens.sources.documents import product_info
    per = vuln_count_per_analysis(findings)
    types = (vuln_type_rows(findings).groupBy("analysis_id")
             .agg(F.sum("type_count").cast("bigint").alias("type_total"),
                  F.count(F.lit(1)).alias("n_types")))
    a = analyses
    for c in ("product", "repo_name", "old_version", "new_version", "old_folder", "new_folder"):
        if c not in a.columns:
            a = a.withColumn(c, F.lit(None).cast("string"))
    info = product_info(a)
    return (a.select("analysis_id", "status", "source").join(info, "analysis_id")
            .join(per, "analysis_id", "left").join(types, "analysis_id", "left")
            .select("analysis_id", "status", "source", "product_name", "old_version", "new_version",
                    F.coalesce("n_results", F.lit(0)).cast("bigint").alias("total_files"),
                    F.coalesce("vuln_count", F.lit(0)).cast("bigint").alias("vuln_count"),
                    F.coalesce("type_total", F.lit(0)).cast("bigint").alias("type_total"),
                    F.coalesce("n_types", F.lit(0)).cast("bigint").alias("n_types")))
