"""Operator 13: recall and scores against brute force, copies, rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import ann
from conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, h string, first string, leaf string, shard string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, k, every):
    """query_id -> [(vec_id, score)] over all rows that can be searched."""
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            near = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, true):
    return sum(len({j for j, _ in got[i]} & {j for j, _ in t}) for i, t in true.items()) / sum(map(len, true.values()))


def clustered(n, seed=3, dim=12):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(15, dim)) * 3
    return [(i, (centres[rnd.integers(15)] + rnd.normal(size=dim)) * rnd.uniform(0.5, 2)) for i in range(n)]


def test_recall_and_scores_on_vectors_of_all_lengths(spark):
    rows = clustered(900)
    got, true = found(ann.nearest(table_of(spark, rows), F.col("vec_id") % 20 == 0, leaf_rows=20)), brute(rows, 20, 20)
    assert got.keys() == true.keys() and all(len(g) == 20 for g in got.values())
    assert recall(got, true) >= 0.9
    of = dict(rows)
    for i, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for j, s in near:
            assert s == pytest.approx(float(np.dot(np.float32(of[i]).astype(float), np.float32(of[j]).astype(float))), abs=1e-9)


def test_all_leaves_give_the_exact_answer(spark):
    """Ties, copies beyond k + 1, repeated rows and blocks of both kinds, with every leaf visited."""
    rows = [(i, v.round(1)) for i, v in clustered(200, dim=3)]
    rows += [(1000 + i, [1.0, -2.0, 0.5]) for i in range(120)] + [(2000 + i, [0.0, 2.0, 2.0]) for i in range(30)]
    rows += rows[:5] + [(1000, [1.0, -2.0, 0.5])]
    got = found(ann.nearest(table_of(spark, rows), F.col("vec_id") % 10 == 0, k=7, leaf_rows=8, target=1.1, shard_rows=16, query_rows=4))
    true = brute(rows, 7, 10)
    assert got.keys() == true.keys()
    for i, near in true.items():
        assert [j for j, _ in got[i]] == [j for j, _ in near], i
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in near])


def test_rows_that_take_no_part(spark):
    rows = [(0, [1, 0]), (20, [0, 1]), (40, None), (60, [0, 0]), (80, [None, 1]), (100, [float("nan"), 1]), (120, [float("inf"), 1]),
            (None, [5, 5]), (3, [2, 2]), (4, []), (5, [1, 2, 3])]
    got = found(ann.nearest(table_of(spark, rows), F.col("vec_id") % 20 == 0))
    assert got == {0: [(3, 2.0), (20, 0.0)], 20: [(3, 2.0), (0, 0.0)]}


def test_empty_tables_and_tables_without_queries(spark):
    q = F.col("vec_id") % 20 == 0
    assert ann.nearest(table_of(spark, []), q).collect() == []
    assert ann.nearest(table_of(spark, [(1, [1, 2]), (2, [2, 1])]), q).collect() == []
    assert ann.nearest(table_of(spark, [(0, [1, 2])]), q).collect() == []


def test_query_over_the_whole_table(spark):
    vectors = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    got, true = found(ann.nearest(vectors, F.col("vec_id") % 20 == 0)), brute(rows, 20, 20)
    assert got.keys() == true.keys() and recall(got, true) >= 0.9


def test_queue_visits_leaves_by_nearest_bin_and_all_of_them_in_the_end():
    x = np.array([v for _, v in clustered(400)])
    tree = ann.Tree(x, 20)
    q = x[:30]
    orders = list(tree.visits(q, tree.leaves))
    assert all(sorted(o) == list(range(tree.leaves)) for o in orders)
    assert [o[:5] for o in orders] == list(tree.visits(q, 5))
    assert set(tree.leaf(x)) <= set(range(tree.leaves))
