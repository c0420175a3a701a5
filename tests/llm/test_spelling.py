"""Operator 11 against all pairs of words in Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from churnlens.llm import spelling
from edge import edge_docs, edge_rows


def words_of(rows, every=97):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            count[run] += 1
    return count


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(count, least=5, times=3):
    vocab = {w: n for w, n in count.items() if len(w) >= least and n >= times}
    of = {w: [v for v in vocab if near(w, v)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(of[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best is not None and vocab[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])
    return {(w, n, len(of[w]), form[w], vocab.get(form[w]), root(w)) for w, n in vocab.items()}


def noisy_rows(seed=5, n=150):
    rnd = random.Random(seed)
    words = ["interest", "interests", "intérest", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "Straße", "strasse", "zeitgeist", "ÀÉÎÕÜß", "banana", "bananas"]

    def spoil(w):
        at, c = rnd.randrange(len(w) + 1), rnd.choice("abeizé")
        return rnd.choice([w, w, w[:at] + c + w[at:], w[:at] + w[at + 1:], w[:at] + c + w[at + 1:]]) or w
    return [(rnd.choice([None, *range(40)]), " ".join(spoil(rnd.choice(words)) for _ in range(60)) + rnd.choice(["", "×x", " 12ab3"])) for _ in range(n)]


@pytest.mark.parametrize("every", [97, 3])
def test_variants_equal_brute_force(spark, every):
    rows = noisy_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_variants(docs, typo_every=every).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(words_of(rows, every))


def test_edge_rows(spark):
    got = spelling.spelling_variants(edge_docs(spark), min_length=3, min_count=1)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert set(map(tuple, got.collect())) == brute(words_of(edge_rows()), 3, 1)


@pytest.mark.parametrize("group", [2, 3, 32, 10 ** 9])
def test_large_groups_are_cut_until_pairs_are_exact(spark, group):
    rnd = random.Random(1)
    words = {"inter" + "".join(rnd.choices("abcd", k=rnd.randint(0, 4))) for _ in range(250)} | {"x" * n for n in range(8)} | {"", "a", "b", "ab", "ba"}
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("ab",)], "word string")
    got = spelling.near_pairs(df, group=group).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(sorted(p)) for p in got} == {(a, b) for a in words for b in words if a < b and near(a, b)}


def test_a_very_long_word(spark):
    long = "ab" * 20_000
    df = spark.createDataFrame([(long,), (long[:-1],), (long[:9_000] + "c" + long[9_001:],), ("c" + long,)], "word string")
    assert len(spelling.near_pairs(df, group=2).collect()) == 3


def test_empty_table(spark):
    assert spelling.spelling_variants(edge_docs(spark).limit(0)).collect() == []
