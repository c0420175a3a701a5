"""Reports, pagination and the download-cache metrics.

Pagination uses ``orderBy(...).offset(o).limit(n)``: Spark plans it as a
top-(o+n) per partition followed by a final merge, so memory per task is
bounded by the page end, not by the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlens.operators.sequence import index_within

PER_PAGE_DEFAULT, PER_PAGE_MIN, PER_PAGE_MAX = 10, 5, 50
MOVING_WINDOW = 100
#: Rows of a block of a paged table: what a page reads, at least.
BLOCK_ROWS = 10_000


def page_params(page, per_page) -> tuple[int, int]:
    """O06 parameter rules: page >= 1 (default 1); per_page in [5, 50] (default 10)."""
    try:
        p = int(page)
    except (TypeError, ValueError):
        p = 1
    p = p if p >= 1 else 1
    try:
        pp = int(per_page)
    except (TypeError, ValueError):
        pp = PER_PAGE_DEFAULT
    if pp < PER_PAGE_MIN or pp > PER_PAGE_MAX:
        pp = PER_PAGE_DEFAULT
    return p, pp


def newest_first(analyses: DataFrame) -> list[Column]:
    """created_at descending, id as the tie-break."""
    return [F.desc("created_at"), F.asc("analysis_id")]


def page(analyses: DataFrame, page_no=1, per_page=10) -> DataFrame:
    """One page of analyses, newest first; a page past the end is empty."""
    p, pp = page_params(page_no, per_page)
    return analyses.orderBy(*newest_first(analyses)).offset((p - 1) * pp).limit(pp)


def write_paged(analyses: DataFrame, folder: str, block_rows: int = BLOCK_ROWS) -> None:
    """O06 for deep pages: the analyses in listing order, cut into blocks of about ``block_rows``, and a sparse index of the blocks.

    A block is one task's range of the order; the index has a row per block: its number, where it
    starts in the list, and how many rows it holds.
    """
    spark = analyses.sparkSession
    blocks = max(1, -(-analyses.count() // block_rows))
    analyses.limit(0).write.parquet(f"{folder}/columns")
    (analyses.repartitionByRange(blocks, *newest_first(analyses)).withColumn("block", F.spark_partition_id())
     .sortWithinPartitions(*newest_first(analyses)).write.partitionBy("block").parquet(f"{folder}/rows"))
    counts = _paged_rows(spark, folder).groupBy("block").agg(F.count(F.lit(1)).alias("rows"))
    # as many rows as there are blocks
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/index")


def _paged_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows with their block; an empty table has a folder without files."""
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema.add("block", "integer")).parquet(f"{folder}/rows")


def stored_page(spark: SparkSession, folder: str, page_no=1, per_page=10) -> DataFrame:
    """One page of a paged table, at the price of the one or two blocks that hold it, however deep it lies."""
    p, pp = page_params(page_no, per_page)
    first, rows = (p - 1) * pp, _paged_rows(spark, folder)
    held = (spark.read.parquet(f"{folder}/index").where((F.col("start") < first + pp) & (F.col("start") + F.col("rows") > first))
            .select("block", "start").collect())
    if not held:
        return rows.drop("block").limit(0)
    skip = first - min(r.start for r in held)
    return (rows.where(F.col("block").isin([r.block for r in held])).orderBy(*newest_first(rows)).offset(skip).limit(pp).drop("block"))


def page_info(analyses: DataFrame, page_no=1, per_page=10) -> DataFrame:
    """O06 envelope: page, per_page, total, total_pages, has_next, has_prev (one row)."""
    p, pp = page_params(page_no, per_page)
    total = F.count(F.lit(1))
    pages = F.ceil(total / F.lit(pp)).cast("bigint")
    return analyses.agg(F.lit(p).alias("page"), F.lit(pp).alias("per_page"), total.alias("total"),
                        pages.alias("total_pages"), (F.lit(p) < pages).alias("has_next"),
                        (F.lit(p) > 1).alias("has_prev"))


def report_class(product, source) -> Column:
    """P12 (Q4): product if the product parameter is truthy; library for library sources; else folder.

    ``cve_auto`` is a folder report here, while the language statistics
    count it as library.
    """
    truthy = F.coalesce(F.col(product) if isinstance(product, str) else product, F.lit("")) != ""
    src = F.col(source) if isinstance(source, str) else source
    return (F.when(truthy, F.lit("product")).when(src.isin("library", "library_auto"), F.lit("library"))
            .otherwise(F.lit("folder")))


def params_text(*cols: str) -> Column:
    """The printed parameters of a report ('key: value' per present parameter)."""
    return F.concat_ws(" ", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + ": "), F.col(c).cast("string")))
                              for c in cols])


def search(reports: DataFrame, text: str, cols: list[str]) -> DataFrame:
    """Case-insensitive substring search over the printed parameters."""
    if not text:
        return reports
    return reports.where(F.contains(F.lower(params_text(*cols)), F.lit(text.lower())))


def client_relevance(status_text) -> Column:
    """Relevance re-check done on the status text alone."""
    s = F.lower(F.coalesce(F.col(status_text) if isinstance(status_text, str) else status_text, F.lit("")))
    return (F.contains(s, F.lit("yes")) | F.contains(s, F.lit("not sure"))
            | (F.contains(s, F.lit("vulnerabilit")) & ~F.contains(s, F.lit("no vulnerabilit"))))


def focus_type(types: DataFrame, focus: str | None) -> DataFrame:
    """Per analysis, the requested type (case-insensitive) or else the first (top) type.

    ``types`` is the ranked output of the type counts (analysis_id, vuln_type, type_rank).
    """
    f = (focus or "").lower()
    pick = (F.when(F.lower("vuln_type") == F.lit(f), 0).otherwise(1))
    best = F.min(F.struct(pick.alias("miss"), F.col("type_rank").alias("r"), F.col("vuln_type").alias("t")))
    return types.groupBy("analysis_id").agg(best["t"].alias("focus_type"))


def report_rows(summary: DataFrame) -> DataFrame:
    """Per analysis, files, vulnerability count and bulk comparison count."""
    bulk = F.col("bulk_total") if "bulk_total" in summary.columns else F.lit(0)
    return summary.select("analysis_id", "total_files", "vuln_count", F.coalesce(bulk, F.lit(0)).alias("bulk_count"))


# --------------------------------------------------------------------------- A10, W06, S19

def download_moving_avg(access: DataFrame, window: int = MOVING_WINDOW) -> DataFrame:
    """Mean duration of the last ``window`` downloads at every download.

    Computed from a skew-safe running sum over the global download order
    (time, id): mean = (S[i] - S[i-window]) / min(i+1, window).  No task ever
    holds more than one range partition of the log.  The running sum is
    exact (decimal), so the mean does not depend on how rows were split.
    """
    d = access.where(F.col("kind") == "download").select(
        "event_id", "ts", F.col("value").cast("decimal(38,9)").alias("seconds"))
    idx = index_within(d, [], [F.asc("ts"), F.asc("event_id")], out="seq", running_sum="seconds")
    back = idx.select((F.col("seq") + window).alias("seq"), F.col("seq_cum").alias("_prev_cum"))
    j = idx.join(back, "seq", "left")
    n = F.least(F.col("seq") + 1, F.lit(window))
    window_sum = (F.col("seq_cum") - F.coalesce("_prev_cum", F.lit(0))).cast("double")
    return j.select("event_id", "seq", (window_sum / n).alias("moving_avg_s"))


def cache_kpis(access: DataFrame, catalog: DataFrame, window: int = MOVING_WINDOW) -> DataFrame:
    """A10: cached versions, bytes, hit rate %, mean of the last downloads, bytes saved (one row).

    The hit/miss/download counters of the reference become an access-log table.
    """
    cat = catalog.agg(F.count(F.lit(1)).alias("cached_versions"),
                      F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("size_bytes"))
    hits = access.agg(F.sum(F.when(F.col("kind") == "hit", 1).otherwise(0)).cast("bigint").alias("hits"),
                      F.sum(F.when(F.col("kind") == "miss", 1).otherwise(0)).cast("bigint").alias("misses"))
    last = (access.where(F.col("kind") == "download").orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
            .agg(F.coalesce(F.sum(F.col("value").cast("decimal(38,9)")).cast("double") / F.count(F.lit(1)),
                            F.lit(0.0)).alias("avg_download_s")))
    # three one-row aggregates, combined by a union and a final aggregate (no join)
    rows = (cat.select("cached_versions", "size_bytes", F.lit(None).cast("bigint").alias("hits"),
                       F.lit(None).cast("bigint").alias("misses"), F.lit(None).cast("double").alias("avg_download_s"))
            .unionByName(hits.select(F.lit(None).cast("bigint").alias("cached_versions"),
                                     F.lit(None).cast("bigint").alias("size_bytes"), "hits", "misses",
                                     F.lit(None).cast("double").alias("avg_download_s")))
            .unionByName(last.select(F.lit(None).cast("bigint").alias("cached_versions"),
                                     F.lit(None).cast("bigint").alias("size_bytes"),
                                     F.lit(None).cast("bigint").alias("hits"), F.lit(None).cast("bigint").alias("misses"),
                                     "avg_download_s")))
    one = rows.agg(*[F.max(c).alias(c) for c in ["cached_versions", "size_bytes", "hits", "misses", "avg_download_s"]])
    h = F.coalesce("hits", F.lit(0))
    total = h + F.coalesce("misses", F.lit(0))
    rate = F.when(total > 0, h.cast("double") / total * 100).otherwise(F.lit(0.0))
    saved = F.when((rate > 0) & (F.col("size_bytes") > 0),
                   (h * (F.col("size_bytes").cast("double") / F.col("cached_versions"))).cast("bigint")) \
        .otherwise(F.lit(0).cast("bigint"))
    return one.select("cached_versions", "size_bytes", rate.alias("hit_rate"),
                      F.coalesce("avg_download_s", F.lit(0.0)).alias("avg_download_s"), saved.alias("disk_space_saved"))


def expired_snapshots(catalog: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Cached snapshots whose modification time is more than ``days`` before ``as_of``."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))
    return catalog.where(F.col("modified_at").cast("timestamp") < cutoff)
