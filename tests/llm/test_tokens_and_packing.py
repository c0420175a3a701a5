"""Operators 9 and 3 against the tokenizer library and against all possible cuts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from churnlens.llm import packing, token_counts
from edge import by_row, edge_docs, edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "the", " ", "  ", "\n", "\t", "'re", "'s", "'", "r", "é", "日", "🙂", "1", "23", ".", ", ", ". ", "!!", "?,",
          "<|endoftext|>", "<|startoftext|>", "<|end", "\x1c", "\x85", " x", "ing", "Hello", "Σ", "İ", " ́"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12))
def test_every_prefix_has_its_exact_count(parts):
    text, tok = "".join(parts), Tokenizer.from_file(BYTE) if not hasattr(test_every_prefix_has_its_exact_count, "tok") else test_every_prefix_has_its_exact_count.tok
    test_every_prefix_has_its_exact_count.tok = tok
    steps = token_counts._counter(BYTE)([text])[0]
    for i in range(len(text) + 1):
        n = len(text[:i].encode())
        assert token_counts.prefix_count(steps, n) == len(tok.encode(text[:i], add_special_tokens=False).ids)


def test_token_counts(spark):
    tok = Tokenizer.from_file(BYTE)
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in edge_rows()}
    got = token_counts.answer_budget(token_counts.token_prefixes(edge_docs(spark), BYTE), 1024)
    assert by_row((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == by_row(
        (i, len((t or "").encode()), n[t], n[t] > 1024) for i, t in edge_rows())
    assert token_counts.token_prefixes(edge_docs(spark).limit(0), BYTE).collect() == []


def test_longest_prefix_is_the_longest(spark):
    text = "Hello there, it's a    test\n\nof the longest prefix"
    steps, tok = token_counts._counter(BYTE)([text])[0], Tokenizer.from_file(BYTE)
    for budget in range(12):
        fits = [i for i in range(len(text) + 1) if len(tok.encode(text[:i], add_special_tokens=False).ids) <= budget]
        assert token_counts.longest_prefix(steps, budget) == max(fits)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    texts, tok = ["".join(t) for t in texts], Tokenizer.from_file(WORD) if not hasattr(test_ids_are_the_librarys, "tok") else test_ids_are_the_librarys.tok
    test_ids_are_the_librarys.tok = tok
    ids, tokens, places, cost = packing._encoder(WORD, 1)(texts)
    own = [tok.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == [i for x in own for i in x] and tokens.tolist() == [len(x) for x in own]
    assert (np.diff(places, prepend=0) > 0).all() and set(np.cumsum(tokens).tolist()) == set(places[cost == 0].tolist())


def cheapest(pos, cost, window, least):
    """All ways to cut, by plain recursion over places."""
    pos, best = [0, *pos], [0]
    for j in range(1, len(pos)):
        options = []
        for i in range(j):
            n = pos[j] - pos[i]
            if n <= window:
                free = n & (n - 1) == 0 and n >= least
                options.append(best[i] + (0 if free else window - n))
        best.append(min(options) + cost[j - 1])
    return best[-1]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rnd = random.Random(seed)
    pos = np.cumsum([rnd.randint(1, 9) for _ in range(rnd.randint(1, 60))]).tolist()
    cost = [rnd.choice([0, 2, 5]) for _ in pos]
    cuts = packing.choose_cuts(pos, cost, 32, least=4)
    total, before = 0, 0
    for c in cuts:
        n = pos[c] - before
        assert 0 < n <= 32
        total += cost[c] + (0 if n & (n - 1) == 0 and n >= 4 else 32 - n)
        before = pos[c]
    assert before == pos[-1] and total == cheapest(pos, cost, 32, 4)


def check_pieces(rows, texts, window):
    tok = Tokenizer.from_file(WORD)
    own = defaultdict(list)
    for i, t in texts:
        own[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(own)
    for i, got in pieces.items():
        assert sum(r.length for r in got) == sum(map(len, own[i]))
        for r in got:
            assert any(len(x) == r.doc_tokens and r.start + r.length <= len(x) and
                       zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in own[i])
    padded = 0
    for got in sequences.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded / sum(r.length for r in rows)


def test_packing(spark, monkeypatch):
    docs = edge_docs(spark).repartition(2)
    check_pieces(packing.pack(docs, WORD).collect(), edge_rows(), 2048)
    monkeypatch.setattr(packing, "BLOCK", 500)  # many blocks, the last window of each goes on in the next
    check_pieces(packing.pack(docs, WORD, window=256).collect(), edge_rows(), 256)
    assert packing.pack(docs.limit(0), WORD).collect() == []


def test_little_padding_on_real_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = packing.pack(docs, WORD).collect()
    assert check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048) < 0.02
