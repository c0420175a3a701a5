"""Operator 1 against a search for whole items and against all BM25 scores."""

import random

import numpy as np
from churnlens.llm import decontaminate
from edge import edge_docs

SF = "/root/testdata/sf0.01"


def words(text):
    return decontaminate.WORDS((text or "").lower())


def test_finds_whole_items_and_nothing_else(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate.find_leaks(docs, items).collect()
    own = [(r.item_id, " " + " ".join(words(r.text)) + " ") for r in items.collect()]
    expected = {(r.doc_id, i) for r in docs.collect() for i, t in own if t in " " + " ".join(words(r.text)) + " "}
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected) > 10
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items, block_items=7).collect()} == expected
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in expected}


def test_wand_returns_every_item_above_the_threshold():
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(80)]
    draw = lambda n: rnd.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=n)
    index = decontaminate.Index([(i, " ".join(draw(rnd.randint(1, 30)))) for i in range(300)])
    for _ in range(100):
        terms = sorted({index.code[w] for w in draw(25) if w in index.code})
        scores = np.zeros(300)
        for t in terms:
            scores[index.items[t]] += index.impacts[t]
        for threshold in (0.05, 0.2, 0.5, 0.8):
            got = dict(index.search(terms, threshold))
            assert set(got) == set(np.flatnonzero(scores >= threshold - 1e-9)) and all(abs(scores[i] - s) < 1e-9 for i, s in got.items())


def test_no_window_that_could_match_is_left_out():
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(120)]
    draw = lambda n: rnd.choices(vocabulary, [1 / (k + 1) for k in range(120)], k=n)
    index = decontaminate.Index([(i, " ".join(draw(rnd.randint(3, 20)))) for i in range(50)])
    texts = [draw(rnd.randint(0, 120)) for _ in range(40)]
    for ws, windows in zip(texts, index.candidates(texts), strict=True):
        kept = {start for start, _, _ in windows}
        for start in range(0, len(ws), index.longest):
            terms = sorted({index.code[w] for w in ws[start:start + 2 * index.longest] if w in index.code})
            assert start in kept or not index.search(terms, decontaminate.THRESHOLD)


def test_question_and_answer_are_both_needed(spark):
    item = " ".join(f"q{k}" for k in range(20)) + " " + " ".join(f"a{k}" for k in range(20))
    half = " ".join(f"q{k}" for k in range(20))
    shuffled = item.split()
    random.Random(1).shuffle(shuffled)
    docs = spark.createDataFrame([(1, f"before {item.upper()} after"), (2, half + " other"), (3, " ".join(shuffled)), (4, None), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (None, ""), (8, None), (9, "unrelated words only")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == {(1, 7), (None, 7)}


def test_one_edited_word_in_an_item_of_median_length(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = sorted(((r.item_id, words(r.text)) for r in items.collect()), key=lambda x: (len(x[1]), x[0]))
    item, ws = own[len(own) // 2]
    total, docs = len(decontaminate.shingles(ws)), []
    for k in range(len(ws)):
        edited = [*ws[:k], "changedword", *ws[k + 1:]]
        docs.append((k, "a b " + " ".join(edited) + " c", len(decontaminate.shingles(ws) & decontaminate.shingles(edited)) >= 0.8 * total))
    got = {r.doc_id for r in decontaminate.find_leaks(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), items).collect() if r.item_id == item}
    assert got == {k for k, _, leak in docs if leak} and len(got) > len(ws) // 2


def test_blocks_are_bounded_and_change_no_score(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{k}" for k in range(150)]
    items = [(i, " ".join(rnd.choices(vocabulary, [1 / (k + 1) for k in range(150)], k=rnd.randint(20, 45)))) for i in range(40)]
    docs = []
    for i, t in items:
        ws = t.split()
        ws[rnd.randrange(len(ws))] = "changedword"
        docs += [(i, "before " + " ".join(ws) + " after"), (100 + i, t)]
    items += [(200, items[0][1])] * 30 + [(None, None), (300, "")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [len(x.ids) <= 7 for x in decontaminate.indexes(items, 7)] == [True] * 11
    whole, blocks = ([(*r[:2], round(r.score, 9), *r[3:]) for r in decontaminate.find_leaks(docs, items, block_items=n).collect()] for n in (100, 7))
    assert sorted(whole) == sorted(blocks) and len(whole) > 100


def test_edge_cases(spark):
    docs = edge_docs(spark)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.find_leaks(docs, items).collect() == []
    assert decontaminate.find_leaks(docs.limit(0), items).collect() == []
    assert decontaminate.find_leaks(docs, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(docs, items).count() == docs.count()
