"""Session helpers.

The library never creates its own cluster settings beyond what a job needs
to be correct: the session time zone is pinned to UTC (day/week/month keys
are derived from timestamps) and AQE is left on so the engine can coalesce
partitions and split skewed joins at runtime.  Everything else (shuffle
partitions, file split size, memory) belongs to the cluster configuration.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "churnlens",
                shuffle_partitions: int | None = None, extra_conf: dict | None = None) -> SparkSession:
    """Return (or build) a session with the settings the library relies on."""
    builder = SparkSession.builder.appName(app)
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is.  Only when it is unset and the master is local (tests) a
    fresh scratch folder is created; on a cluster an unset folder is an
    error, since a machine-local folder would not survive executor loss.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a shared folder (needed to materialize tables)")
        path = tempfile.mkdtemp(prefix="churnlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set(CHECKPOINT_CONF, path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that this session made, on whatever file system holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
