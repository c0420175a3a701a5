"""Operators 2 and 5 against brute force over all runs."""

import random

import numpy as np
import pytest
from churnlens.llm import line_dedup, suffix_dedup
from edge import by_row, edge_docs, edge_rows


def spans_of(flags):
    return sum(1 for k, f in enumerate(flags) if f and (k == 0 or not flags[k - 1]))


def plain_lines(rows, run=line_dedup.RUN):
    """Rows that repeat id and text are one document."""
    rows = [((i is not None, i or 0), t or "") for i, t in rows]
    seen = {}
    for i, t in sorted(set(rows)):
        seq = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        for j in range(len(seq) - run + 1):
            seen.setdefault(tuple(seq[j:j + run]), []).append((i, t, j))
    out = []
    for i, t in rows:
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = [False] * len(at)
        for j in range(len(at) - run + 1):
            places = seen[tuple(lines[k] for k in at[j:j + run])]
            if any((p[0], p[2]) < (i, j) for p in places if p[0] != i or p[1] == t) or any(p[0] == i and p[1] != t for p in places):
                if any((p[0], p[2]) < (i, j) for p in places if p[0] != i or p[1] == t):
                    gone[j:j + run] = [True] * run
        out.append((i[1] if i[0] else None, len(lines), sum(gone), spans_of(gone),
                    "\n".join(x for k, x in enumerate(lines) if k not in {a for a, g in zip(at, gone, strict=True) if g})))
    return out


def line_rows():
    rnd = random.Random(8)
    lines = [f"line {k}" for k in range(14)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(0, 9)))) for i in range(1, 150)]
    return [*rows, (None, rows[3][1] + "\nx"), (200, None), (201, "\n".join(["same"] * 9)), (7, rows[6][1])]


def test_line_dedup(spark):
    rows = line_rows()
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert by_row(got) == by_row(plain_lines(rows)) and sum(r.n_removed for r in got) > 50


def test_every_repeated_run_has_a_fingerprint(spark):
    docs = spark.createDataFrame([(i, t) for i, t in line_rows() if i is not None and i != 7], "doc_id long, text string")
    prints = line_dedup.fingerprints(line_dedup._lines(docs, "doc_id", "text")).collect()
    places = {(r.doc_id, r.j) for r in prints}
    for r in docs.collect():
        seq = [x for x in (r.text or "").split("\n") if x.strip()]
        for j in range(len(seq) - line_dedup.RUN + 1):
            assert any((r.doc_id, j + k) in places for k in range(line_dedup.WINDOW))


def plain_short_and_long_runs(rows, min_words):
    """Texts after the cut of all repeated runs of ``RUN`` lines, of ``min_words`` words or of a whole document; ids are unique."""
    seqs = {i: [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for i, t in rows}
    seen, out = set(), []
    for i, t in sorted(rows):
        seq, gone = seqs[i], set()
        for j in range(len(seq)):
            for k in (1, 2, line_dedup.RUN):
                run = tuple(seq[j:j + k])
                if len(run) == k and run in seen and (k == line_dedup.RUN or k == len(seq) or sum(len(x.split()) for x in run) >= min_words):
                    gone |= set(range(j, j + k))
            seen |= {tuple(seq[j:j + k]) for k in range(1, line_dedup.RUN + 1)}
        at = [n for n, x in enumerate(t.split("\n")) if x.strip(" \t\n\v\f\r")]
        out.append((i, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in {at[g] for g in gone})))
    return out


def test_short_runs_of_many_words_and_whole_documents(spark):
    rnd = random.Random(4)
    lines = [f"line {k} " + "word\t " * rnd.choice([0, 0, 2, 5]) for k in range(30)] + ["", "  "]
    rows = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(0, 6)))) for i in range(1, 200)]
    long = " ".join(f"w{k}" for k in range(60))
    rows += [(300, long), (301, "head\n" + long + "\ntail"), (302, long), (303, "short one"), (304, "short one"), (305, "other\nshort one\nend")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(frame, min_words=7).collect()}
    assert got == dict(plain_short_and_long_runs(rows, 7))
    assert (got[300], got[301], got[302], got[303], got[304], got[305]) == (long, "head\ntail", "", "short one", "", "other\nshort one\nend")
    by_words = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(frame, min_words=line_dedup.MIN_WORDS).collect()}
    assert (by_words[301], by_words[302]) == (1, 1)
    repeated = [(None, long), (None, long + "x"), (7, long), (7, long), (7, "x\n" + long)]
    assert sum(r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(repeated, "doc_id long, text string"), min_words=50).collect()) == 3


def plain_bytes(rows, n=suffix_dedup.LENGTH):
    rows = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, b in rows:
        for p in range(len(b) - n + 1):
            first[b[p:p + n]] = min(first.get(b[p:p + n], key(i)), key(i))
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p:p + n]] < key(i):
                gone[p:p + n] = [True] * n
        out.append((i, len(b), sum(gone), spans_of(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def byte_rows():
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choices("abcdef é日", k=n))
    passages = [text(rnd.randint(40, 200)) for _ in range(8)]
    parts = [lambda: text(rnd.randint(0, 60)), lambda: rnd.choice(passages), lambda: rnd.choice(passages)[:rnd.randint(0, 80)],
             lambda: rnd.choice(passages)[rnd.randint(0, 50):], lambda: "hend " * rnd.randint(0, 60)]
    rows = [(i if i % 17 else None, "".join(rnd.choice(parts)() for _ in range(rnd.randint(0, 6))) if i % 23 else None) for i in range(200)]
    return [*rows, (5, passages[0]), (5, passages[0]), (7, "")]


@pytest.mark.parametrize(("common", "piece"), [(1024, 1 << 18), (2, 70), (1024, 1)])
def test_suffix_dedup(spark, common, piece):
    """common=2: most names go the way of frequent ones; small pieces: runs lie across their borders."""
    rows = byte_rows() if piece > 1 else byte_rows()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(docs, block_bytes=6_000, common=common, piece=piece).collect()
    got = [(*r[:4], bytes(r.kept)) for r in got]
    assert by_row(got) == by_row(plain_bytes(rows)) and sum(r[2] for r in got) > 2_000


def test_whole_copies_and_one_long_document(spark):
    rnd = random.Random(8)
    long = "".join(rnd.choices("abcdefgh ", k=300_000))
    rows = [(9, long), (4, long[1_000:1_300] + "x" * 40 + long[-80:]), (12, long), (11, long), (None, long), (9, long), (2, "short"), (3, "short")]
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=100_000).collect()}
    assert (got[9].n_removed, got[9].n_spans) == (300 + 80, 2) and got[4].n_removed == 0
    for i in (11, 12, None):
        assert (got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (300_000, 1, b"")
    assert bytes(got[3].kept) == b"short"


def test_equal_names_of_unequal_runs_are_told_apart(monkeypatch):
    """Names cut to three bits: nearly all runs collide, and the answer is the same."""
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 2, 900).astype(np.uint8)
    data[500:700] = data[100:300]
    at, owner = np.arange(len(data) - 49), rnd.integers(0, 9, len(data) - 49)
    true = [min(o for q, o in zip(at, owner, strict=True) if (data[q:q + 50] == data[p:p + 50]).all()) for p in at]
    assert suffix_dedup._smallest_owner(data, at, owner).tolist() == true
    full = suffix_dedup.names
    monkeypatch.setattr(suffix_dedup, "names", lambda d, n: full(d, n) & np.uint64(7))
    assert suffix_dedup._smallest_owner(data, at, owner).tolist() == true


def test_edge_cases(spark):
    docs = edge_docs(spark)
    got = [(*r[:4], bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, block_bytes=2_000).collect()]
    assert by_row(got) == by_row(plain_bytes(edge_rows()))
    assert line_dedup.line_dedup(docs).count() == docs.count()
    assert suffix_dedup.suffix_dedup(docs.limit(0)).collect() == [] and line_dedup.line_dedup(docs.limit(0)).collect() == []


def test_texts_cross_one_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    done = suffix_dedup.suffix_dedup(docs)
    done.collect()
    final = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") == 2 and final.count("FileScan") == 1
