"""Maintained stream results against a recomputation: batches in any order, replays, late rows."""

import datetime as dt
import random

from churnlens.streaming import maintained as kept
from churnlens.streaming.jobs import latest_documents

BASE = dt.datetime(2024, 1, 30)
LOG = "analysis_id long, status string, source string, modified_at timestamp, revision int"


def revisions(n=120, seed=2):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = BASE + dt.timedelta(hours=rnd.randint(0, 300))
        for r in range(rnd.randint(1, 4)):
            rows.append((i, rnd.choice(["running", "completed", "failed"]), rnd.choice(["library", "folder", "cve_auto", None]), at, r))
            at += dt.timedelta(hours=rnd.choice([0, 1, 40]))
    rnd.shuffle(rows)
    return rows


def totals_of(df):
    from pyspark.sql import functions as F
    parts = latest_documents(df).select(F.explode(kept.contributions()).alias("p")).select("p.*")
    return {tuple(r) for r in parts.groupBy("metric", "key").agg(F.sum("value").alias("value")).collect()}


def test_totals_equal_a_recomputation_after_every_batch(spark, scratch):
    rows, write, seen = revisions(), kept.dashboard_writer(f"{scratch}/d"), []
    for epoch in range(4):
        part = rows[epoch::4]
        seen += part
        write(spark.createDataFrame(part, LOG), epoch)
        if epoch % 2:  # replays change nothing
            write(spark.createDataFrame(part, LOG), epoch)
        got = {tuple(r) for r in kept.dashboard_totals(spark, f"{scratch}/d").collect()}
        assert got == totals_of(spark.createDataFrame(seen, LOG)), epoch


def test_a_batch_that_stopped_half_way_is_written_again(spark, scratch):
    rows = revisions()
    write = kept.dashboard_writer(f"{scratch}/d")
    write(spark.createDataFrame(rows[:100], LOG), 0)
    real, calls = kept.write_epoch, []

    def breaks(*a, **b):
        calls.append(a[1])
        if a[1].endswith("deltas"):
            raise OSError("lost")
        real(*a, **b)
    try:
        kept.write_epoch = breaks
        try:
            write(spark.createDataFrame(rows[100:], LOG), 1)
        except OSError:
            pass
    finally:
        kept.write_epoch = real
    write(spark.createDataFrame(rows[100:], LOG), 1)
    assert {tuple(r) for r in kept.dashboard_totals(spark, f"{scratch}/d").collect()} == totals_of(spark.createDataFrame(rows, LOG))


def test_upsert_keeps_the_newest_row_of_a_key(spark, scratch):
    schema = "repo string, path string, answer string, scored_at timestamp"
    rows = [("r", f"p{k % 7}", f"a{k}", BASE + dt.timedelta(minutes=(k * 37) % 50)) for k in range(60)]
    write = kept.merge_writer(f"{scratch}/m", ["repo", "path"], ["scored_at", "answer"], schema)
    for epoch, part in enumerate((rows[:20], rows[20:50], rows[50:])):
        write(spark.createDataFrame(part, schema), epoch)
        write(spark.createDataFrame(part, schema), epoch)
    got = {(r.path, r.answer) for r in kept.merged(spark, f"{scratch}/m", ["repo", "path"], ["scored_at", "answer"], schema).collect()}
    best = {}
    for _, p, a, t in rows:
        best[p] = max(best.get(p, (t, a)), (t, a))
    assert got == {(p, a) for p, (_, a) in best.items()}


def test_late_rows_go_to_the_side_table(spark, scratch):
    schema = "created_at timestamp, vuln_count long"
    day = lambda d: BASE + dt.timedelta(days=d)
    batches = [[(day(0), 1), (day(5), 2)], [(day(1), 4), (day(4), 8), (None, 3)], [(day(2), 16), (day(9), 32)], [(day(6), 64), (day(8), 128)]]
    write = kept.trend_writer(f"{scratch}/t", "day", schema, "2 days")
    for epoch, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), epoch)
        write(spark.createDataFrame(rows, schema), epoch)
    late = sorted(r.vuln_count for r in kept.late_rows(spark, f"{scratch}/t", schema).collect())
    sums = {r.period: r.value for r in kept.trend(spark, f"{scratch}/t").collect()}
    assert late == [4, 16, 64] and sums == {None: 3, **{day(d).strftime("%Y-%m-%d"): v for d, v in ((0, 1), (5, 2), (4, 8), (9, 32), (8, 128))}}


def test_empty_batches_and_unwritten_folders(spark, scratch):
    assert kept.dashboard_totals(spark, f"{scratch}/none").collect() == []
    write = kept.dashboard_writer(f"{scratch}/d")
    write(spark.createDataFrame([], LOG), 0)
    write(spark.createDataFrame(revisions(5), LOG), 1)
    assert {tuple(r) for r in kept.dashboard_totals(spark, f"{scratch}/d").collect()} == totals_of(spark.createDataFrame(revisions(5), LOG))
