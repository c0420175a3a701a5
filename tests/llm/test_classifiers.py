"""Operators 10 and 4: identities, segments, held-out accuracy, edge cases."""

import random
import time

import numpy as np
import pytest
from churnlens.llm import quality_fm, toxicity
from churnlens.llm.common import held_out
from edge import edge_docs

SF = "/root/testdata/sf0.1"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    size = (1 << quality_fm.WORD_BITS) + quality_fm.N_STAT
    m = quality_fm.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 3)), np.zeros(quality_fm.N_STAT), np.ones(quality_fm.N_STAT))
    parts = quality_fm._vectors(["One two two three!", "", "Four four.\nFive"])
    place, x, row = m._whole(*parts)
    for n, z in enumerate(m.logits(*parts)):
        p, v = place[row == n], x[row == n]
        pairs = sum(m.v[p[i]] @ m.v[p[j]] * v[i] * v[j] for i in range(len(p)) for j in range(i))
        assert z == pytest.approx(m.w0 + m.w[p] @ v + pairs)


def plain_segments(scores):
    """Maximal scoring subsequences by their recursive definition: the best run, then left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 0 and (best is None or total > best[2] + 1e-9):
                best = (a, b, total)
    if best is None:
        return []
    a, b, s = best
    return [*plain_segments(scores[:a]), best, *[(x + b + 1, y + b + 1, z) for x, y, z in plain_segments(scores[b + 1:])]]


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_the_maximal_ones(seed):
    rnd = random.Random(seed)
    scores = [rnd.choice([-1, -rnd.random() - 0.1, -3, rnd.randint(1, 5) + rnd.random()]) for _ in range(rnd.randint(0, 40))]
    got = toxicity.maximal_segments(np.array(scores))
    assert [(a, b, pytest.approx(s)) for a, b, s in got] == [tuple(r) for r in plain_segments(scores)]


@pytest.mark.parametrize("step", [-1.5, -0.5, 0.5])
def test_segment_search_is_linear(step):
    """Each positive word starts lower than all before it, or each higher, 200,000 of them."""
    scores = np.tile([1.0, step - 1.0], 200_000)
    began = time.perf_counter()
    found = toxicity.maximal_segments(scores)
    assert time.perf_counter() - began < 3 and len(found) == (200_000 if step <= 0 else 1)


def test_a_worker_never_takes_the_words_of_another_model():
    words = ["bad", "good", "other"]
    for k in range(1, 30):
        score = float(k)
        model = toxicity.Model({toxicity.places("bad")[0]: score, toxicity.places("good")[0]: -score})
        assert model.word_scores(words).tolist() == [score, -score, -toxicity.DRIFT]
        del model


@pytest.mark.parametrize(("module", "label", "threshold", "least"), [(quality_fm, "quality", 0.3, 0.98), (toxicity, "toxic", 0.5, 0.94)])
def test_held_out_accuracy(spark, module, label, threshold, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, labels, threshold).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= threshold) for r in rows)
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least


def test_labels_of_the_held_out_fold_and_other_columns_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("label", F.lit(1))
    a, b = (sorted(map(tuple, quality_fm.classify(d, x).collect())) for d, x in ((docs, labels), (other, flipped)))
    assert a == b


@pytest.mark.parametrize("module", [quality_fm, toxicity])
def test_edge_cases(spark, module):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(11, 1, 1), (11, 1, 1), (14, 0, 0), (15, 0, 0), (17, None, None), (None, 1, 1), (999, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        rows = module.classify(docs, labels).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(docs.limit(0), labels).collect() == []
    kept = quality_fm.keep_good(docs, none)
    assert kept.schema == docs.schema and kept.count() == docs.count()


def test_toxic_passages_are_spans(spark):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choices("bcdfghjklmaeiou", k=7)) for _ in range(3000)]
    docs = []
    for i in range(1, 400):
        words = rnd.choices(vocabulary, k=30)
        docs.append((i, " ".join([*words[:12], "awful,", "nasty", *words[12:]] if i % 4 == 1 else words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 1)) for i, _ in docs], "doc_id long, toxic int")
    spans = toxicity.toxic_segments(frame, toxicity.train(frame, labels)).collect()
    assert {r.doc_id for r in spans} == {i for i, _ in docs if i % 4 == 1}
    assert all(r.first_word <= 12 and r.last_word >= 13 and 0 < r.p_value < 1 for r in spans)


def test_a_word_of_all_documents_has_finite_odds(spark):
    docs = spark.createDataFrame([(i, f"all have this {'bad' if i % 2 else 'good'}") for i in range(1, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    assert toxicity.classify(docs, labels).count() == 39
