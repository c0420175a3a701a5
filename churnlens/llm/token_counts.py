"""Token counts at every prefix of a text (operator 9).

:func:`token_prefixes` encodes each text once and stores, for every byte of it,
how many tokens the prefix that ends there has.  All later questions (length,
over a limit or not, where to cut for a budget, what a span costs) read that
table: :func:`answer_budget`, :func:`prefix_count`, :func:`longest_prefix`.

The counts come from a dynamic programme over prefixes.  In byte-pair
encoding the last token of a prefix is the only vocabulary entry that ends
there and stands next to the last token of what is left without being merged
with it.  So ``count[i] = count[i - len(t)] + 1`` for that entry ``t``, and no
prefix is encoded anew.  Compatible pairs and the counts inside a word are
cached in the worker, so text costs a dictionary look-up per word.

Null texts count as empty: 0 bytes, 0 tokens.  Rows with equal ids or null ids
each get their own row.  Columns other than the two that are named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import byte_alphabet, id_text, in_bytes, latin_class, rows_of, str_list, to_batch, worker_cache

#: Words whose counts one worker keeps; the table is emptied when it is full.
CACHED_WORDS = 500_000
#: The word pattern of the vocabulary, and its contractions of three characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^\s{letter}{digit}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'re", "'ve", "'ll")
PREFIX_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("prefix_steps", pa.large_binary())])


def _counter(tokenizer_path: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> of each one signed byte per UTF-8 byte: by how much the token count changes there."""
    import re

    from tokenizers import Tokenizer

    cache = worker_cache("token_prefixes:" + tokenizer_path)
    if "count" in cache:
        return cache["count"]
    tok = Tokenizer.from_file(tokenizer_path)
    vocab = set(tok.get_vocab(with_added_tokens=False))
    longest = max(map(len, vocab))
    specials = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, specials))) if specials else None
    pre_tokenize, model, alphabet = tok.pre_tokenizer.pre_tokenize_str, tok.model, byte_alphabet()
    # Latin letters, digits, signs and no run of white space: every version of the word pattern agrees on such text
    odd = re.compile("[^\\n -~\xa1-\u024f]|[\\n ][\\n ]|<\\|").search
    letter, digit = latin_class("L"), latin_class("N")
    pattern = re.compile(WORD_PATTERN.format(letter=letter, digit=digit)).findall
    words: dict[str, bytes] = {}  # word -> steps
    stands: dict[tuple[str, str], bool] = {}

    def apart(a: str, b: str) -> bool:
        """Whether the tokens a, b stay as they are side by side (a = '': whether b is a token on its own)."""
        if len(stands) > CACHED_WORDS:
            stands.clear()
        found = stands[a, b] = [t.value for t in model.tokenize(a + b)] == ([a, b] if a else [b])
        return found

    def prefixes(s: str, last: list[str], count: list[int]) -> None:
        """Extend last tokens and token counts from the prefixes they have (0 at least) to all prefixes of s."""
        for i in range(len(count), len(s) + 1):
            for j in range(max(0, i - longest), i):
                t = s[j:i]
                if t in vocab:
                    before = last[j]
                    ok = stands.get((before, t))
                    if apart(before, t) if ok is None else ok:
                        last.append(t)
                        count.append(count[j] + 1)
                        break

    def counts_of(s: str) -> list[int]:
        count = [0]
        prefixes(s, [""], count)
        return count[1:]

    def learn(new: set[str]) -> None:
        """Steps of words of the pattern; in their order each goes on from the prefix it shares with the one before."""
        if len(words) + len(new) > CACHED_WORDS:
            words.clear()
        last, count, before = [""], [0], ""
        for s, w in sorted([(in_bytes(w, alphabet), w) for w in new]):
            m = 0
            for a, b in zip(s, before, strict=False):
                if a != b:
                    break
                m += 1
            del last[m + 1:], count[m + 1:]
            prefixes(s, last, count)
            if s in CONTRACTIONS:  # cut after two characters this is no contraction
                words[w] = steps_of([1, 2, count[3]])
            else:
                words[w] = steps_of(count[1:])
            before = s

    def steps_of(counts: list[int]) -> bytes:
        return bytes([(c - p) & 255 for c, p in zip(counts, [0, *counts], strict=False)])

    def any_text(text: str) -> bytes:
        """Steps of any text without special strings."""
        out: list[int] = []
        base, before = 0, None
        for s, (a, b) in pre_tokenize(text):
            counts = counts_of(s)
            out += [base + c for c in counts]
            if before is not None and text[a].isspace():
                # a prefix that ends with this white space has the whole run as one pre-token
                n = len(text[a].encode())
                out[n - 1 - len(counts)] = before[1] + counts_of(before[0] + s[:n])[-1]
            if s in CONTRACTIONS:
                out[-2] = base + 2
            before = (s, base) if text[a:b].isspace() else None
            base += counts[-1]
        return steps_of(out)

    def with_specials(text: str) -> bytes:
        out, at = [], 0
        for found in special.finditer(text):
            # up to its last byte a special string is ordinary text; then it is one token
            lead, name = text[at:found.start()], found.group()
            steps = any_text(lead + name[:-1])
            n = len(lead.encode())
            counts = np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)
            here, then = (int(counts[n - 1]) if n else 0), int(counts[-1]) if len(counts) else 0
            out += [steps, np.array([here + 1 - then], np.int8).tobytes()]
            at = found.end()
        return b"".join([*out, any_text(text[at:])])

    def count(texts: list[str]) -> list[bytes]:
        parts = [None if odd(t) else pattern(t) for t in texts]
        got = [p and list(map(words.get, p)) for p in parts]
        new = {w for g, p in zip(got, parts, strict=True) if g and None in g for w, k in zip(p, g, strict=True) if k is None}
        if new:
            full = len(words) + len(new) > CACHED_WORDS
            learn(new)
            for i, (g, p) in enumerate(zip(got, parts, strict=True)):
                if g and None in g:
                    if full:  # the table was emptied; what this text had is in g
                        got[i] = [words[w] if k is None else k for k, w in zip(g, p, strict=True)]
                    else:
                        got[i] = list(map(words.__getitem__, p))
        return [with_specials(t) if p is None and special and special.search(t) else any_text(t) if p is None else b"".join(g)
                for t, p, g in zip(texts, parts, got, strict=True)]

    cache["count"] = count
    return count


def token_prefixes(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, prefix_steps (binary, a signed byte per UTF-8 byte).

    The running sum of ``prefix_steps`` is the token count of each prefix.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer_path)
        for b in rows_of(batches, 1000):
            steps = count(str_list(b))
            yield to_batch({"doc_id": b.column(0), "n_bytes": [len(s) for s in steps], "prefix_steps": steps}, PREFIX_SCHEMA)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, prefix_steps binary")


def prefix_count(steps: bytes, n_bytes: int | None = None) -> int:
    """Tokens of the prefix of ``n_bytes`` bytes (None: of the whole text)."""
    return int(np.frombuffer(steps, np.int8)[:n_bytes].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """Bytes of the longest prefix with at most ``budget`` tokens (0 is always one)."""
    counts = np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def answer_budget(prefixes: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes (longest prefix within the budget), from stored prefixes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_()), ("cut_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = b.column(2).to_pylist()
            n = [prefix_count(s) for s in steps]
            cut = [len(s) if k <= budget else longest_prefix(s, budget) for s, k in zip(steps, n, strict=True)]
            yield to_batch({"doc_id": b.column(0), "n_bytes": b.column(1), "n_tokens": n,
                            "over_limit": [k > budget for k in n], "cut_bytes": cut}, schema)

    return (prefixes.select("doc_id", "n_bytes", F.col("prefix_steps"))
            .mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long"))
