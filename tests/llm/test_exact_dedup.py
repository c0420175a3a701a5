"""Operator 7 against a grouping in Python."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from churnlens.llm import exact_dedup, simhash
from edge import by_row, edge_docs, edge_rows


def sha(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_groups_of_equal_texts(spark):
    groups = defaultdict(list)
    for i, t in edge_rows():
        groups[sha(t)].append(i)
    expected = []
    for i, t in edge_rows():
        ids = groups[sha(t)]
        keep = min((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), len(ids) == 1 or keep == i, sha(t)))
    assert by_row(exact_dedup.exact_dedup(edge_docs(spark)).collect()) == by_row(expected)


def test_one_row_of_each_group_stays_with_its_columns(spark):
    docs = edge_docs(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(sha(r.text) for r in kept.collect()) == sorted({sha(t) for _, t in edge_rows()})


def test_columns_with_any_name_stay(spark):
    names = ["__id", "__sha", "__key", "key", "row", "sha", "pair", "again", "salt", "norm", "rows", "doc.id"]
    docs = edge_docs(spark)
    for n in names:
        docs = docs.withColumn(n, F.lit(n))
    for kept in (exact_dedup.drop_copies(docs), simhash.drop_near_copies(docs)):
        assert kept.schema == docs.schema
        assert all(r[n] == n for r in kept.collect() for n in names)


def test_the_bit_table_is_right_for_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 17)  # four bitmaps
    rows = [(i, "t" * (1 + i % 4000)) for i in range(6000)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.keep_id, r.group_size, r.kept) for r in got.collect()} == {(i % 4000, 2 if i % 4000 < 2000 else 1, i < 4000) for i in range(6000)}
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(4000))


def test_colliding_prefixes_and_bits_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", 7)
    monkeypatch.setattr(exact_dedup, "PREFIX", 2)
    rows = [(i, f"ab{i % 50:03d}") for i in range(120)]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i % 50, 3 if i % 50 < 20 else 2) for i in range(120)}


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_dedup(edge_docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(edge_docs(spark).limit(0)).collect() == []
    assert exact_dedup.drop_copies(edge_docs(spark).limit(0)).collect() == []
