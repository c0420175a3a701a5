"""Maintained results of streams: dashboard totals, scored findings, trends with late rows.

Plain Parquet has no update in place, so each result is a folder of *partitions by epoch* that add up:

* what a micro-batch says is written to its own ``_epoch`` partition, which a replayed
  epoch overwrites (dynamic partition overwrite);
* what it changes is computed from earlier epochs only, so a replay computes the same
  and a batch that was written half is simply written again;
* readers add up deltas, or take the newest row of a key.

A batch is compared with what is known of *its* keys: rows are kept in ``BUCKETS`` folders by a
hash of the key, and only the buckets that a batch touches are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.operators.dashboards import ACTIVE_STATUSES, COMPLETED, LIBRARY_SOURCES, period_key
from churnlens.streaming.jobs import latest_documents

BUCKETS = 64


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def write_epoch(rows: DataFrame, folder: str, epoch: int, by: tuple[str, ...] = ()) -> None:
    """The rows of one epoch, in place of what an earlier attempt at it has written."""
    (rows.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "_epoch").parquet(folder))


def read_before(spark: SparkSession, folder: str, schema: str, epoch: int | None = None) -> DataFrame:
    """The rows of all epochs, or of those before ``epoch``; none where nothing is written yet."""
    kind = f"{schema}, _epoch long"
    try:
        rows = spark.read.schema(kind).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], kind)
    return rows if epoch is None else rows.where(F.col("_epoch") < epoch)


# --------------------------------------------------------------------------- T01 / S16: dashboard totals

CONTRIBUTION = "array<struct<metric:string,key:string,value:bigint>>"
DOCUMENT_LOG = f"analysis_id long, modified_at timestamp, revision int, parts {CONTRIBUTION}, _bucket int"
DELTAS = "metric string, key string, value long"


def contributions() -> Column:
    """What one revision of a document adds to each total (A01, A07, A11, A13-A15 counts)."""
    done, one = F.col("status") == COMPLETED, F.lit(1).cast("long")
    part = lambda when, metric, key, value=one: F.when(when, F.struct(F.lit(metric).alias("metric"), key.alias("key"), value.alias("value")))
    library = done & F.col("source").isin(*LIBRARY_SOURCES)
    return F.array_compact(F.array(
        part(done, "total_completed", F.lit("")), part(F.col("status").isin(*ACTIVE_STATUSES), "active_running", F.lit("")),
        part(done, "completed_by_source", F.coalesce("source", F.lit(""))),
        *[part(library, f"library_{p}", period_key(p, "modified_at")) for p in ("day", "week", "month")]))


def dashboard_writer(folder: str, parts: Callable[[], Column] = contributions) -> Callable[[DataFrame, int], None]:
    """Keeps the totals of a stream of document revisions (analysis_id, modified_at, revision, and what ``parts`` reads).

    A revision that is newer than what is known of its document takes back what the older one
    gave and adds its own; an older one that comes late changes nothing.  No total is ever computed anew.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = (latest_documents(batch).select("analysis_id", "modified_at", F.col("revision").cast("int").alias("revision"),
                                                 parts().alias("parts")).withColumn("_bucket", bucket_of("analysis_id")))
        write_epoch(newest, f"{folder}/documents", epoch, ("_bucket",))
        known = read_before(spark, f"{folder}/documents", DOCUMENT_LOG)
        now = known.where(F.col("_epoch") == epoch).drop("_epoch")
        touched = [r[0] for r in now.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
        before = latest_documents(known.where((F.col("_epoch") < epoch) & F.col("_bucket").isin(touched)).drop("_epoch", "_bucket"))
        old = before.select("analysis_id", F.struct("modified_at", "revision").alias("was"), F.col("parts").alias("old_parts"))
        newer = F.col("was").isNull() | (F.struct("modified_at", "revision") > F.col("was"))
        back = F.transform(F.coalesce("old_parts", F.array().cast(CONTRIBUTION)),
                           lambda p: F.struct(p["metric"].alias("metric"), p["key"].alias("key"), (-p["value"]).alias("value")))
        delta = (now.join(old, "analysis_id", "left").where(newer).select(F.explode(F.concat("parts", back)).alias("p"))
                 .groupBy("p.metric", "p.key").agg(F.sum("p.value").alias("value")).where("value <> 0"))
        write_epoch(delta, f"{folder}/deltas", epoch)

    return write


def dashboard_totals(spark: SparkSession, folder: str) -> DataFrame:
    """metric, key, value: the totals as of the last complete epoch; reads sums, not documents."""
    return (read_before(spark, f"{folder}/deltas", DELTAS).groupBy("metric", "key").agg(F.sum("value").alias("value")).where("value <> 0"))


# --------------------------------------------------------------------------- T06: scored answers merged into results

def merge_writer(folder: str, keys: list[str], order: list[str], schema: str) -> Callable[[DataFrame, int], None]:
    """An upsert by ``keys``: of a key's rows the one with the largest ``order`` counts, whatever batch brought it."""
    def write(batch: DataFrame, epoch: int) -> None:
        columns = [f.name for f in T.StructType.fromDDL(schema)]
        newest = latest_documents(batch.select(*columns).withColumn("_k", F.struct(*keys)), "_k", order[0], tuple(order[1:]))
        write_epoch(newest.select(*columns).withColumn("_bucket", bucket_of(*keys)), folder, epoch, ("_bucket",))

    return write


def merged(spark: SparkSession, folder: str, keys: list[str], order: list[str], schema: str) -> DataFrame:
    """The merged table: one row per key."""
    columns = [f.name for f in T.StructType.fromDDL(schema)]
    rows = read_before(spark, folder, f"{schema}, _bucket int").select(*columns, F.struct(*keys).alias("_k"))
    return latest_documents(rows, "_k", order[0], tuple(order[1:])).select(*columns)


# --------------------------------------------------------------------------- T05: trends, with late rows kept apart

TREND = "period string, value long"


def trend_writer(folder: str, period: str, schema: str, delay: str = "2 days", ts: str = "created_at", value: str = "vuln_count") -> Callable[[DataFrame, int], None]:
    """Sums per day, ISO week or month; rows older than the watermark go to a side table in place of being lost.

    The watermark of an epoch is the latest event time of the epochs before it less ``delay``.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        marks = read_before(spark, f"{folder}/marks", "latest timestamp", epoch)
        mark = marks.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first()["mark"]
        late = F.lit(False) if mark is None else F.coalesce(F.col(ts) < F.lit(mark), F.lit(False))
        rows = batch.select(*[f.name for f in T.StructType.fromDDL(schema)]).withColumn("_late", late)
        write_epoch(rows.where("_late").drop("_late"), f"{folder}/late", epoch)
        sums = rows.where("not _late").groupBy(period_key(period, ts).alias("period")).agg(F.sum(value).cast("long").alias("value"))
        write_epoch(sums, f"{folder}/sums", epoch)
        write_epoch(batch.agg(F.max(F.col(ts).cast("timestamp")).alias("latest")).where("latest is not null"), f"{folder}/marks", epoch)

    return write


def trend(spark: SparkSession, folder: str) -> DataFrame:
    """period, value over all rows that came in time."""
    return read_before(spark, f"{folder}/sums", TREND).groupBy("period").agg(F.sum("value").alias("value"))


def late_rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return read_before(spark, f"{folder}/late", schema).drop("_epoch")


# --------------------------------------------------------------------------- running

def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs all that a stream has now, batch by batch; an error of a batch is raised."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
