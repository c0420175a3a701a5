"""Operator 6: round trip, determinism, rolling, commit."""

import glob
import gzip
import os

from churnlens.llm import warc
from edge import by_row

ROWS = [(3, "u", "aa"), (1, "v", "aa"), (1, "v", "aa"), (2, None, None), (None, "x", ""), (5, "z\r\n", "ü"), (1, "w", "b"), (9, "l", "long " * 40_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, html string, payload string, kind string")


def files_of(folder):
    return {os.path.basename(p): open(p, "rb").read() for p in glob.glob(folder.removeprefix("file:") + "/*.warc.gz")}


def test_round_trip(spark):
    folder = warc.scratch_folder(spark)
    warc.write_archives(pages(spark), folder, shards=3)
    got = warc.read_archives(spark, folder).collect()
    payload = {i: {(t or "").encode() for j, _, t in ROWS if j == i} for i, _, _ in ROWS}
    assert by_row((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == by_row([
        (1, "response", None, 2), (1, "revisit", 1, 2), (1, "response", None, 1), (2, "response", None, 0), (3, "revisit", 1, 2),
        (None, "revisit", 2, 0), (5, "response", None, 2), (9, "response", None, 200_000)])
    for r in got:
        assert r.payload_digest in {warc.digest(p) for p in payload[r.page_id]}
        assert (r.payload is None) == (r.record_type == "revisit") and (r.payload is None or bytes(r.payload) in payload[r.page_id])


def test_same_bytes_from_any_partitioning_and_small_files(spark):
    kinds = []
    for n in (1, 4):
        folder = warc.scratch_folder(spark)
        manifest = warc.write_archives(pages(spark).repartition(n), folder, shards=2, roll_bytes=600).collect()
        kinds.append((sorted(manifest), files_of(folder)))
        assert sum(m.records for m in manifest) == len(ROWS) and {m.file for m in manifest} == set(kinds[-1][1])
    assert kinds[0] == kinds[1] and len(kinds[0][1]) > 3


def test_shards_by_binary_search_and_one_task_each(spark):
    from bisect import bisect_right

    from pyspark.sql import functions as F
    ids = [None, -5, 0, 1, 7, 8, 9, 99, 100, 101, 1 << 40]
    for bounds in ([], [0], [0, 8], [1, 8, 100], list(range(0, 100, 7)), list(range(4096))):
        got = spark.createDataFrame([(i,) for i in ids], "page_id long").select("page_id", warc._shard_of(F.col("page_id"), bounds).alias("s")).collect()
        assert [r.s for r in got] == [0 if r.page_id is None else bisect_right(bounds, r.page_id) for r in got]
    folder = warc.scratch_folder(spark)
    rows = [(i * i, "u", f"text {i}") for i in range(400)]
    manifest = warc.write_archives(pages(spark, rows), folder, shards=8).collect()
    assert len(manifest) == 8 and max(m.records for m in manifest) < 3 * 400 / 8
    one, eight = (warc._shard_of(F.col("page_id"), list(range(n))) for n in (1000, 8000))
    assert str(eight._jc.toString()).count("CASE") == str(one._jc.toString()).count("CASE")


def test_standard_readers_and_unlisted_files(spark):
    folder = warc.scratch_folder(spark)
    warc.write_archives(pages(spark), folder, shards=1)
    (name, data), = files_of(folder).items()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(ROWS)
    with open(f"{folder.removeprefix('file:')}/zz.warc.gz", "wb") as f:  # left by a failed attempt
        f.write(data)
    assert warc.read_archives(spark, folder).count() == len(ROWS)


def test_small_payloads_are_responses(spark):
    folder = warc.scratch_folder(spark)
    warc.write_archives(pages(spark), folder, revisit_from=3)
    assert {r.record_type for r in warc.read_archives(spark, folder).collect()} == {"response"}


def test_empty_table(spark):
    folder = warc.scratch_folder(spark)
    assert warc.write_archives(pages(spark).limit(0), folder).collect() == []
    assert warc.read_archives(spark, folder).collect() == []
