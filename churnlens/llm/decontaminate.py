"""Benchmark decontamination by BM25 with block-max WAND (operator 1).

The test items are an inverted index: term -> postings (item, impact), ordered by
item and cut into blocks that carry their largest impact.  A term's impact on an item is its BM25
weight there as a share of the item's BM25 score against itself, so a passage that
holds the whole item scores 1 whatever the item's length, and one threshold fits all.

Every training passage is a query: windows of twice the longest item's words, that many
words apart, so that each place where an item can stand lies whole in a window.  For a
window, the impacts of its rarer terms are summed by item, for all windows of a batch at
once; where no item can reach the threshold even with all its common terms, the window ends there.  The rest go through
block-max WAND, which returns every item that scores at least ``THRESHOLD``.

Retrieved items are verified: of the item's ``SHINGLE``-word shingles at least ``OVERLAP``
must stand in the passage.  Its words are also cut in two, the question (first half) and the
answer (the rest); of the shingles of either at least ``PART_OVERLAP`` must stand there, so that
both show.  Items and halves of fewer words are one shingle.

The benchmark is indexed in blocks of at most ``BLOCK_ITEMS`` items, dealt in the order of the rows, the only
thing sent to tasks; a larger benchmark takes more passes over the documents.  Number, lengths and document
frequencies of the items are those of the whole benchmark, so scores do not depend on the blocks.  Documents are never shuffled.

Null and empty texts hold no passage, items without words are no items.  Rows that repeat an
id are searched one by one; items that repeat one are found one by one.  Null ids are carried along.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, rows_of, str_list, to_batch
from churnlens.session import checkpoint_dir

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.25
BLOCK_ITEMS = 20_000
POSTINGS_BLOCK = 64
WORDS = re.compile(r"\w+").findall


def shingles(words: list[str], size: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Postings of a block of items, with block maxima, and the items' questions and answers."""

    def __init__(self, items: list[tuple[int | None, str | None]], overall: tuple[int, int, int, dict[str, int]] | None = None):
        """``overall``: number of items with words, their words, the longest one's and, by word, the items that hold it; of these items if not given."""
        texts = [(i, WORDS((t or "").lower())) for i, t in items]
        texts = [(i, ws) for i, ws in texts if ws]
        self.ids = [i for i, _ in texts]
        number, total, self.longest, frequency = overall or (
            len(texts), sum(len(ws) for _, ws in texts), max((len(ws) for _, ws in texts), default=1), Counter(w for _, ws in texts for w in set(ws)))
        mean = total / max(1, number)
        postings: dict[str, list[tuple[int, float]]] = {}
        for n, (_, ws) in enumerate(texts):
            weights = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (number - frequency[w] + 0.5) / (frequency[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean))
            own = sum(weights.values())
            for w, x in weights.items():
                postings.setdefault(w, []).append((n, x / own))
        self.code = {w: c for c, w in enumerate(postings)}
        self.items = [[n for n, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.most = np.array([max(p) for p in self.impacts] or [0.0])
        self.block_most = [[max(p[k:k + POSTINGS_BLOCK]) for k in range(0, len(p), POSTINGS_BLOCK)] for p in self.impacts]
        # flat postings; common terms are left out of the bound that decides which windows are searched, as long as no item has more than a third of the threshold in them
        self.size = np.array([len(p) for p in self.items], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat_items = np.array([n for p in self.items for n in p], np.int64)
        self.flat_impacts = np.array([x for p in self.impacts for x in p])
        self.rare, self.common = np.ones(len(self.items), bool), np.zeros(len(texts))
        for c in np.argsort(-self.size, kind="stable").tolist():
            grown = self.common[self.items[c]] + self.impacts[c]
            if grown.max() > THRESHOLD / 3:
                break
            self.common[self.items[c]] = grown
            self.rare[c] = False
        self.parts = [(shingles(ws), shingles(ws[:(len(ws) + 1) // 2]), shingles(ws[(len(ws) + 1) // 2:])) for _, ws in texts]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score at least ``threshold`` for the distinct terms, by block-max WAND."""
        lists = [[self.items[t][0], 0, t] for t in terms]  # item under the cursor, cursor, term
        found, end = [], len(self.ids)
        slack = threshold - 1e-9
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.most[t]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # shallow move: the blocks that would hold the pivot item
            bound, stop = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else end
            for x in lists[:pivot + 1]:
                p, c, t = self.items[x[2]], x[1], x[2]
                block = c // POSTINGS_BLOCK
                while (block + 1) * POSTINGS_BLOCK <= len(p) and p[min((block + 1) * POSTINGS_BLOCK, len(p)) - 1] < item:
                    block += 1
                if block * POSTINGS_BLOCK < len(p):
                    bound += self.block_most[t][block]
                    last = p[min((block + 1) * POSTINGS_BLOCK, len(p)) - 1]
                    stop = min(stop, last + 1)
            if bound < slack:
                to = max(stop, item + 1)  # no item before `to` can reach the threshold
            elif lists[0][0] == item:
                score = sum(self.impacts[t][c] for i, c, t in lists[:pivot + 1] if i == item)
                if score >= slack:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            alive = []
            for k, x in enumerate(lists):
                if k <= pivot and x[0] < to:
                    p, c = self.items[x[2]], x[1]
                    while c < len(p) and p[c] < to:
                        c += 1
                    if c == len(p):
                        continue
                    x[0], x[1] = p[c], c
                alive.append(x)
            lists = alive
        return found

    def candidates(self, texts: list[list[str]]) -> list[list[tuple[int, int, list[int]]]]:
        """By text, (start, stop, distinct terms) of the windows in which some item may reach the threshold.

        All windows of all texts at once: the impacts of their rare terms are summed by
        item; an item can reach the threshold only if that sum and all its common terms do.
        """
        out: list[list[tuple[int, int, list[int]]]] = [[] for _ in texts]
        lengths = np.array([len(ws) for ws in texts])
        codes = np.fromiter((self.code.get(w, -1) for ws in texts for w in ws), np.int64, int(lengths.sum()))
        at = np.flatnonzero(codes >= 0)
        if not len(at):
            return out
        step, codes, first = self.longest, codes[at], np.cumsum(lengths) - lengths
        text = np.searchsorted(first, at, side="right") - 1
        place = at - first[text]
        windows = lengths // step + 1
        base = np.cumsum(windows) - windows
        # where the same term stood before in the text; in a window it counts once
        order = np.argsort(text * len(self.most) + codes, kind="stable")
        same = np.append(False, (codes[order][1:] == codes[order][:-1]) & (text[order][1:] == text[order][:-1]))
        before = np.full(len(at), -1)
        before[order[same]] = place[order[np.flatnonzero(same) - 1]]
        # a word lies in the window that starts at its step and in the one before
        own = place // step
        here, earlier = before < own * step, (own > 0) & (before < (own - 1) * step)
        window = np.concatenate((base[text[here]] + own[here], base[text[earlier]] + own[earlier] - 1))
        term = np.concatenate((codes[here], codes[earlier]))
        rare = self.rare[term]
        size = self.size[term[rare]]
        total = int(size.sum())
        posting = np.repeat(self.start[term[rare]] - (np.cumsum(size) - size), size) + np.arange(total)
        key = np.repeat(window[rare], size) * len(self.ids) + self.flat_items[posting]
        order = np.argsort(key, kind="stable")
        key, x = key[order], self.flat_impacts[posting][order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if total else np.zeros(0, np.int64)
        reach = np.add.reduceat(x, begin) + self.common[key[begin] % len(self.ids)] if total else np.zeros(0)
        hit = set((key[begin][reach >= THRESHOLD - 1e-9] // len(self.ids)).tolist())
        if (self.common >= THRESHOLD - 1e-9).any():  # an item of common terms only: no window can be left out
            hit = set(window.tolist())
        for w in sorted(hit):
            t = int(np.searchsorted(base, w, side="right")) - 1
            start = (w - int(base[t])) * step
            stop = min(int(lengths[t]), start + 2 * step)
            a, b = np.searchsorted(at, (int(first[t]) + start, int(first[t]) + stop))
            out[t].append((start, stop, np.unique(codes[a:b]).tolist()))
        return out

    def leaks(self, texts: list[str]) -> list[dict[int, tuple[float, float, float, int]]]:
        """By text, item -> score, overlap of question and of answer, first word of the window: the best verified window of each item."""
        split = [WORDS(t.lower()) for t in texts]
        return [self._verified(ws, windows) for ws, windows in zip(split, self.candidates(split), strict=True)]

    def _verified(self, words: list[str], windows: list[tuple[int, int, list[int]]]) -> dict[int, tuple[float, float, float, int]]:
        best: dict[int, tuple[float, float, float, int]] = {}
        for start, stop, terms in windows:
            got = self.search(terms, THRESHOLD)
            here = shingles(words[start:stop]) if got else set()
            for item, score in got:
                whole, q, a = (sum(s in here if len(s) == SHINGLE else _stands(s, words, start, stop) for s in part) / max(1, len(part)) if part else 1.0
                               for part in self.parts[item])
                if whole >= OVERLAP and min(q, a) >= PART_OVERLAP and (item not in best or best[item][0] < score):
                    best[item] = (score, q, a, start)
        return best


def _stands(short: tuple[str, ...], words: list[str], start: int, stop: int) -> bool:
    """Whether a run shorter than a shingle stands in the window."""
    return any(tuple(words[i:i + len(short)]) == short for i in range(start, stop - len(short) + 1))


def _item_words(items: DataFrame) -> DataFrame:
    """One row per item with words (word null, n the number of its words) and one per distinct word in it (n is 1)."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            split = [ws for ws in (WORDS(t.lower()) for t in str_list(b)) if ws]
            own = [w for ws in split for w in set(ws)]
            yield to_batch({"word": [None] * len(split) + own, "n": [len(ws) for ws in split] + [1] * len(own)}, schema)

    return items.mapInArrow(run, "word string, n long")


def indexes(benchmark: DataFrame, block_items: int = BLOCK_ITEMS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark as indexes of at most ``block_items`` items each; one at least."""
    def by_id(r: tuple[int | None, str | None]) -> tuple[bool, int, str]:
        return r[0] is None, r[0] or 0, r[1] or ""

    items = id_text(benchmark, id_col, text_col)
    if items.count() <= block_items:
        yield Index(sorted(((r.doc_id, r.text) for r in items.collect()), key=by_id))
        return
    spark = benchmark.sparkSession
    checkpoint_dir(spark)
    totals = (_item_words(items).groupBy("word").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest"))
              .checkpoint())
    sizes = totals.where("word IS NULL").collect()
    number, words, longest = sizes[0][1:] if sizes else (0, 0, 1)
    rows = ((r.doc_id, r.text) for r in items.toLocalIterator())
    while block := list(islice(rows, block_items)):
        own = sorted({w for _, t in block for w in WORDS((t or "").lower())})
        asked = spark.createDataFrame([(w,) for w in own], "word string")
        frequency = {r.word: r["items"] for r in totals.join(asked, "word", "left_semi").collect()}
        yield Index(sorted(block, key=by_id), (number, words, longest, frequency))


def find_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified leaks: doc_id, item_id, score, question_overlap, answer_overlap, first_word."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()),
                        ("answer_overlap", pa.float64()), ("first_word", pa.int64())])
    rows, parts = id_text(docs, id_col, text_col), []
    for index in indexes(benchmark, block_items):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in rows_of(batches):
                out = [(i, index.ids[n], *r) for i, leaks in zip(b.column(0).to_pylist(), index.leaks(str_list(b)), strict=True)
                       for n, r in sorted(leaks.items())]
                yield to_batch({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema)

        parts.append(rows.mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS, text_col: str = "text") -> DataFrame:
    """The documents without a verified leak, with all their columns; nothing is shuffled."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in indexes(benchmark, block_items):
        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in rows_of(batches):
                yield b.filter(pa.array([not leaks for leaks in index.leaks(str_list(b, at))], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
