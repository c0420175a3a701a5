"""Skew-safe positions inside ordered groups (row index, neighbour, running sum).

``Window.partitionBy(g).orderBy(o)`` sends every row of a group to one task;
one repository or client holding a third of all rows would then run in a
single task.  ``index_within`` gives the same 0-based position without that:

1. range-partition the rows on (group, order) — the sampler splits a hot
   group over many partitions;
2. number rows inside each (partition, group) block — a block never holds
   more than one partition's worth of rows;
3. count (and optionally sum) each block: a table with one row per block,
   i.e. O(partitions + groups) rows, whose per-group prefix over partition
   ids gives each block's offset;
4. join the offsets back on (partition, group).

Steps 2 and 3 must see the same partitions, and the bounds of a range
partitioning are sampled anew each time it is planned.  So the numbered rows
are written once, to the session's checkpoint folder, and both the block
counts and the final join read that table.

Neighbours (lag/lead) are then an equi-join on (group, position ± k), which
is skew-free because positions are unique within a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import cut_lineage

_PID = "__blk"


def _num_partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def index_within(df: DataFrame, by: list[str], order: list[Column], out: str = "seq",
                 running_sum: str | None = None, partitions: int | None = None,
                 carry: list[str] | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row within its ``by`` group in ``order``.

    ``order`` must be a total order inside each group (add a unique column
    as the last key).  With ``running_sum``, also add ``<out>_cum``: the sum
    of that column over rows at positions <= this one.  With ``carry``, add
    ``prev_<c>`` / ``next_<c>``: the column's value on the previous / next
    row of the group (null at the ends) — computed inside each block and
    across block borders through the small offsets table, without a
    self-join.
    """
    carry = carry or []
    n = _num_partitions(df, partitions)
    ranged = df.repartitionByRange(n, *[F.col(b) for b in by], *order).withColumn(_PID, F.spark_partition_id())
    block = [_PID, *by]
    w = Window.partitionBy(*block).orderBy(*order)
    local = ranged.withColumn("__lrn", F.row_number().over(w) - 1)
    for c in carry:
        local = (local.withColumn(f"__lprev_{c}", F.lag(c).over(w))
                 .withColumn(f"__lnext_{c}", F.lead(c).over(w)))
    aggs = [F.count(F.lit(1)).alias("__n")]
    if running_sum:
        local = local.withColumn("__lsum", F.sum(running_sum).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        aggs.append(F.sum(running_sum).alias("__s"))
    for c in carry:
        aggs += [F.min_by(c, "__lrn").alias(f"__first_{c}"), F.max_by(c, "__lrn").alias(f"__last_{c}")]
    local = cut_lineage(local)
    grp = Window.partitionBy(*by).orderBy(_PID)
    before = grp.rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.groupBy(*block).agg(*aggs).withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    cols = [*block, "__off", "__n"]
    if running_sum:
        offsets = offsets.withColumn("__soff", F.coalesce(F.sum("__s").over(before), F.lit(0)))
        cols.append("__soff")
    for c in carry:
        offsets = (offsets.withColumn(f"__bprev_{c}", F.lag(f"__last_{c}").over(grp))
                   .withColumn(f"__bnext_{c}", F.lead(f"__first_{c}").over(grp)))
        cols += [f"__bprev_{c}", f"__bnext_{c}"]
    joined = local.join(offsets.select(*cols), on=block, how="inner")
    res = joined.withColumn(out, (F.col("__off") + F.col("__lrn")).cast("bigint"))
    if running_sum:
        res = res.withColumn(f"{out}_cum", F.col("__soff") + F.col("__lsum"))
    drop = [_PID, "__lrn", "__off", "__n", "__lsum", "__soff"]
    for c in carry:
        res = (res.withColumn(f"prev_{c}", F.when(F.col("__lrn") == 0, F.col(f"__bprev_{c}"))
                              .otherwise(F.col(f"__lprev_{c}")))
               .withColumn(f"next_{c}", F.when(F.col("__lrn") == F.col("__n") - 1, F.col(f"__bnext_{c}"))
                           .otherwise(F.col(f"__lnext_{c}"))))
        drop += [f"__lprev_{c}", f"__lnext_{c}", f"__bprev_{c}", f"__bnext_{c}"]
    return res.drop(*drop)


def neighbour(indexed: DataFrame, by: list[str], seq: str, cols: list[str], offset: int,
              prefix: str) -> DataFrame:
    """Attach columns of the row ``offset`` positions away in the same group (left join)."""
    other = indexed.select(*by, (F.col(seq) - offset).alias(seq), *[F.col(c).alias(prefix + c) for c in cols])
    return indexed.join(other, on=[*by, seq], how="left")
