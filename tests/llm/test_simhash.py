"""Operator 8: fingerprints and components against brute force."""

import random
import re

from churnlens.llm import simhash
from edge import by_row, edge_docs, edge_rows
from xxhash import xxh64_intdigest


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """items: (id, fingerprint) -> smallest id by position."""
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(items)):
        groups.setdefault(find(i), []).append(items[i][0])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(items))]


def test_documents(spark):
    items = [(i, plain_fingerprint(t)) for i, t in edge_rows()]
    expected = [(i, f"{fp:016x}", c) for (i, fp), c in zip(items, plain_components(items), strict=True)]
    docs = edge_docs(spark)
    assert by_row(simhash.simhash_dedup(docs).collect()) == by_row(expected)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in expected}


def test_one_row_of_each_component_stays(spark):
    docs = edge_docs(spark)
    rows = [tuple(r) for r in docs.collect()]
    groups = {}
    for r, c in zip(rows, plain_components([(n, plain_fingerprint(r[1])) for n, r in enumerate(rows)]), strict=True):
        groups.setdefault(c, []).append(r)
    kept = [tuple(r) for r in simhash.drop_near_copies(docs).collect()]
    assert len(kept) == len(groups)
    for group in groups.values():
        here = [r for r in kept if r in group]
        assert len(here) == 1 and here[0][0] == min((r[0] for r in group if r[0] is not None), default=None)
    nulls = spark.createDataFrame([(None, "some words of one text"), (None, "quite another one here"), (None, "some words of one text"), (1, None), (1, "")],
                                  "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in simhash.drop_near_copies(nulls).collect()) == [
        (0, "quite another one here"), (0, "some words of one text"), (1, "")]


def test_chains_of_links_and_dense_groups(spark):
    rnd = random.Random(3)
    fps = set()
    for _ in range(40):
        fp = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):  # a chain whose ends are far apart
            fps.add(fp)
            for _ in range(rnd.randint(1, 3)):
                fp ^= 1 << rnd.randrange(64)
    centre = rnd.getrandbits(64)  # a large group around one fingerprint
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a, 20)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    expected = plain_components([(f, f & ((1 << 64) - 1)) for f in signed])
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    label = {r.fp: r.label for r in simhash.components(simhash.links(simhash.pigeonring_candidates(frame))).collect()}
    assert [label.get(f, f) for f in signed] == expected


def test_pigeonring_prunes(spark):
    rnd = random.Random(5)
    far = [(rnd.getrandbits(63),) for _ in range(2000)]
    assert simhash.pigeonring_candidates(spark.createDataFrame(far, "fp long")).count() < 20


def test_empty_table(spark):
    assert simhash.simhash_dedup(edge_docs(spark).limit(0)).collect() == []
    assert simhash.drop_near_copies(edge_docs(spark).limit(0)).collect() == []
