"""Content-addressed snapshot store (S01, S18, and the input of C01-C05).

A store is a folder with two tables:

* ``contents``: content_hash, content — each distinct text once, whatever number of
  repositories, releases and paths hold it; bucketed and sorted by hash.
* ``manifest``: repo, version, path, content_hash, size, n_lines — one narrow row per file of a snapshot.

Comparisons read the manifest only; texts are looked up by hash for changed files,
and since contents are bucketed on it, a join moves the list of wanted hashes, not the texts.

:meth:`Store.add` writes the new texts first and the manifest last, so a snapshot is
visible only when all its texts are there.  Adding is repeatable: snapshots that are
in the manifest and texts that are in the contents are skipped, so a run that lost its
driver half-way is simply run again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.operators.snapshots import scan_files


class Store:
    """A store in a shared folder; the bucketing of its contents is kept in the folder, not in a session."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.table = "contents_" + hashlib.sha256(self.folder.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (content_hash STRING, content STRING) USING parquet "
                  f"CLUSTERED BY (content_hash) SORTED BY (content_hash) INTO {buckets} BUCKETS LOCATION '{self.folder}/contents'")

    @property
    def contents(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def manifest(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def files(self) -> DataFrame:
        """repo, version, path, content_hash, size, n_lines, content of every file."""
        return self.manifest.join(self.contents, "content_hash")

    def new_texts(self, files: DataFrame) -> DataFrame:
        """content_hash and content of each text that is not in the store yet, once, dealt as the buckets are."""
        of_text = F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256)
        known = F.coalesce("content_hash", of_text) if "content_hash" in files.columns else of_text
        # copies are dropped in each task before the texts are dealt by hash
        return (files.select(known.alias("content_hash"), F.coalesce("content", F.lit("")).alias("content"))
                .groupBy("content_hash").agg(F.min("content").alias("content"))
                .join(self.contents.select("content_hash"), "content_hash", "left_anti")
                .repartition(self.buckets, "content_hash"))

    def add(self, files: DataFrame) -> Store:
        """Adds the snapshots of ``files`` (repo, version, path, content, and content_hash and size if known) that are new."""
        new = files.join(self.manifest.select("repo", "version").distinct(), ["repo", "version"], "left_anti")
        listed = scan_files(new, mode="folder").dropDuplicates(["repo", "version", "path"])
        (self.new_texts(new).write.mode("append").format("parquet")
         .bucketBy(self.buckets, "content_hash").sortBy("content_hash").saveAsTable(self.table))
        listed.write.mode("append").parquet(f"{self.folder}/manifest")
        return self


def create_store(spark: SparkSession, folder: str, buckets: int | None = None) -> Store:
    """An empty store in an unused folder; ``buckets`` is the number of tasks that later joins on the contents have.

    By default it is the session's number of shuffle partitions: the texts of :meth:`Store.add`, grouped by hash,
    then lie as the buckets do and are not dealt a second time.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame([], "repo string, version string, path string, content_hash string, size long, n_lines int").write.parquet(f"{folder}/manifest")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/layout")
    return Store(spark, folder, buckets)


def open_store(spark: SparkSession, folder: str) -> Store:
    """A store that another session made."""
    return Store(spark, folder, spark.read.parquet(f"{folder}/layout").first()["buckets"])
