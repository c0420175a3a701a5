"""The content-addressed store, and compares over it."""

import random

import pytest
from pyspark.sql import functions as F

from churnlens.operators import snapshots as snap
from churnlens.plans import compare
from churnlens.sources import store
from test_plans import exchange_outputs, plan
from test_snapshots import FILES, apply_unified, frames

SCHEMA = "repo string, version string, path string, content string"


def test_one_text_is_stored_once(spark, scratch):
    files, _ = frames(spark)
    s = store.create_store(spark, f"{scratch}/s", buckets=4).add(files)
    assert s.contents.count() == len({c for *_, c in FILES})
    assert {tuple(r) for r in s.files().select("repo", "version", "path", "content").collect()} == set(FILES)
    # adding again changes nothing; a new release adds its new texts only
    s.add(files)
    s.add(spark.createDataFrame([("r", "v3", "a.php", "one\ntwo\nthree\n"), ("r", "v3", "b.php", "new text"), ("r2", "v1", "n", None)], SCHEMA))
    s = store.open_store(spark, f"{scratch}/s")
    assert s.manifest.count() == len(FILES) + 3 and s.contents.count() == len({c for *_, c in FILES} | {"new text"})
    assert s.contents.groupBy("content_hash").count().where("count > 1").isEmpty()


def test_a_run_that_stopped_after_the_texts_is_run_again(spark, scratch):
    """The texts are there, the manifest has none of the snapshots: adding again writes the manifest only."""
    files, _ = frames(spark)
    s = store.create_store(spark, f"{scratch}/s", buckets=4)
    empty = f"{scratch}/empty"
    s.manifest.write.parquet(empty)
    s.add(files)
    stored = s.contents.count()
    spark.read.parquet(empty).write.mode("overwrite").parquet(f"{scratch}/s/manifest")
    s = store.open_store(spark, f"{scratch}/s")
    assert s.manifest.isEmpty() and s.contents.count() == stored
    s.add(files)
    assert s.manifest.count() == len(FILES) and s.contents.count() == stored


def test_joins_do_not_move_stored_texts(spark, scratch):
    files, _ = frames(spark)
    s = store.create_store(spark, f"{scratch}/s", buckets=4).add(files)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spark.range(5).select(F.sha2(F.col("id").cast("string"), 256).alias("content_hash"))
        moved = exchange_outputs(plan(wanted.join(s.contents, "content_hash")))
        assert moved and not any("content#" in c for c in moved)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("mode", ["product", "folder"])
def test_store_and_tree_give_the_same_rows(spark, scratch, mode):
    files, pairs = frames(spark)
    s = store.create_store(spark, f"{scratch}/s", buckets=4).add(files)
    of = lambda f: sorted(map(tuple, compare.compare_snapshots(f, pairs, mode=mode, keywords="t, 2").collect()))
    assert of(s) == of(files) and of(s)


def test_patches_give_the_new_text(spark, scratch):
    rnd = random.Random(4)
    base = {f"f{k}.py": [rnd.choice("abcdef") for _ in range(40)] for k in range(12)}
    rows = []
    for v in range(4):
        for p, lines in base.items():
            if rnd.random() < 0.9:
                rows.append(("r", str(v), p, "\n".join(lines) + rnd.choice(["", "\n"])))
            lines[rnd.randrange(len(lines))] = f"edit {v}"
    files = spark.createDataFrame(rows, SCHEMA)
    s = store.create_store(spark, f"{scratch}/s", buckets=4).add(files)
    tags = files.select("repo", F.col("version").alias("tag")).distinct()
    text = {(v, p): t for _, v, p, t in rows}
    keyed, summary = compare.bulk_compare(s, tags, 3)
    got = keyed.collect()
    for r in got:
        old, new = text.get((r.old_version, r.path)), text.get((r.new_version, r.path))
        assert r.result_key == f"[{r.new_version}→{r.old_version}] {r.path}"
        assert r.change_type == ("added" if old is None else "deleted" if new is None else "modified")
        if r.change_type == "modified":
            assert apply_unified(old, r.diff) == new
    wanted = {(o, n, p) for o, n in (("0", "1"), ("1", "2"), ("2", "3")) for p in base if text.get((o, p)) != text.get((n, p))}
    assert {(r.old_version, r.new_version, r.path) for r in got} == wanted
    counts = {(r.old_version, r.new_version): (r.status, r.file_count) for r in summary.collect()}
    assert counts == {k: ("completed", sum(w[:2] == k for w in wanted)) for k in {w[:2] for w in wanted}}


def test_a_release_with_half_of_all_files_is_dealt_over_its_paths(spark):
    rows = [("big", v, f"d{k % 7}/f{k}.c", f"{v if k % 3 else ''}{k}") for k in range(600) for v in ("1", "2")]
    rows += [(f"r{k}", v, f"f{j}.c", f"{v}{j}") for k in range(20) for j in range(30) for v in ("1", "2")]
    files = spark.createDataFrame(rows, SCHEMA)
    pairs = files.select("repo").distinct().select(F.col("repo").alias("pair_id"), "repo", F.lit("1").alias("old_version"), F.lit("2").alias("new_version"))
    changes = snap.align(files, pairs)
    assert changes.where("pair_id = 'big'").count() == 400 and changes.count() == 1000
    p = plan(changes)
    assert p.count("FullOuter") == 0 and "slice" in p
    # the files that meet the pairs are dealt by (repo, version, slice): no key has more than a few of them
    sliced = files.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(snap.PATH_SLICES))).groupBy("repo", "version", "slice").count()
    assert sliced.agg(F.max("count")).first()[0] < 600 / snap.PATH_SLICES * 2.5


def test_pairs_with_a_missing_snapshot_or_equal_sides(spark):
    files, pairs = frames(spark)
    more = pairs.unionByName(spark.createDataFrame([("same", "r", "v1", "v1"), ("none", "x", "v1", "v2")], pairs.schema))
    assert {r.pair_id for r in snap.align(files, more).collect()} == {"p"}
    status = {r.pair_id: r.status for r in snap.bulk_summary(more, files, snap.align(files, more)).collect()}
    assert status == {"p": "completed", "q": "error", "same": "completed", "none": "error"}


def test_texts_are_dealt_once_when_stored(spark, scratch):
    """By default a store has as many buckets as a shuffle has partitions: the grouped texts lie as the buckets do."""
    import glob

    s = store.create_store(spark, f"{scratch}/s")
    files = spark.createDataFrame([("r", "v1", f"{n}.php", f"text {n % 40}") for n in range(90)], SCHEMA)
    moved = [{c.split("#")[0].strip() for c in columns.split(",")} for columns in exchange_outputs(plan(s.new_texts(files)))]
    assert sum("content_hash" in names for names in moved) == 1
    s.add(files)
    assert s.contents.count() == 40 and len(glob.glob(f"{scratch}/s/contents/part-*")) == s.buckets
    assert store.open_store(spark, f"{scratch}/s").buckets == s.buckets == int(spark.conf.get("spark.sql.shuffle.partitions"))
