"""Quality classifier: a factorisation machine over hashed words and structure (operator 10).

A document is a sparse vector: its words, hashed into ``2 ** WORD_BITS`` places with
log counts of unit length in all, and statistics of its form (``STATISTICS``) with
its length as metadata.  Its score is the logistic function of::

    w0 + sum_i w[i] x[i] + 1/2 sum_f ( (sum_i v[i,f] x[i])^2 - sum_i v[i,f]^2 x[i]^2 )

The second sum is every pairwise interaction <v[i], v[j]> x[i] x[j], taken in
time linear in the document's words by the sum-of-squares identity.

The machine is fitted on ``SAMPLE`` labelled rows (those with the smallest hash of
their id, of the folds that may be learned from): tasks turn them into vectors and only the vectors reach
the driver.  Every text is then scored whole, in the scan that reads it.  Inputs are the
text alone; ids, labels, lang and source are not among them.

Null texts count as empty and get a score like any other.  Labels that are null or
belong to no document are not used; of rows that repeat a labelled id one is learned from, the label being 1 if any is.
Without labelled rows every score is 0.5.  Columns of other names are passed on by
:func:`keep_good` and not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, id_text, rows_of, str_list, to_batch, worker_cache

#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 8000
WORD_BITS = 14
RANK = 8
EPOCHS, RATE, DECAY, SEED = 12, 0.03, 1e-5, 7
CACHED_WORDS = 500_000
#: Names of the statistics, in the order of their places after the words.
STATISTICS = ("log_chars", "word_length", "upper", "digits", "signs", "distinct_words", "same_as_before", "longest_share",
              "sentence_words", "lines", "signs_at_word_ends", "distinct_pairs")
N_STAT = len(STATISTICS)
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SIGNS = re.compile(r"[^\w\s]")
DIGITS = re.compile(r"\d")


def describe(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word places, their values (unit length), statistics of form."""
    cache = worker_cache("quality_words")
    if len(cache) > CACHED_WORDS:
        cache.clear()
    words = text.split()
    n = len(words)
    counts = Counter(words)
    places = []
    for w in counts:
        p = cache.get(w)
        if p is None:
            p = cache[w] = zlib.crc32(w.encode()) >> (32 - WORD_BITS)
        places.append(p)
    values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    norm = float(np.sqrt((values * values).sum())) or 1.0
    chars = max(len(text), 1)
    ended = sum(c for w, c in counts.items() if not w[-1].isalnum())
    stats = [float(np.log1p(len(text))), (chars - n) / max(n, 1), len(UPPER.findall(text)) / chars, len(DIGITS.findall(text)) / chars,
             len(SIGNS.findall(text)) / chars, len(counts) / max(n, 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n, 1),
             max(counts.values(), default=0) / max(n, 1), n / max(1, text.count(".") + text.count("!") + text.count("?")),
             float(np.log1p(text.count("\n"))), ended / max(n, 1), len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1)]
    return np.array(places, np.int32), values / norm, stats


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word places and values of all texts in one row, words of each text, statistics by text."""
    got = [describe(t) for t in texts]
    return (np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]),
            np.array([len(g[0]) for g in got]), np.array([g[2] for g in got], np.float32))


class Machine:
    """w0, w, v and the scale of the statistics."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, spread: np.ndarray):
        self.w0, self.w, self.v, self.mean, self.spread = w0, w, v, mean, spread

    def _whole(self, places, values, sizes, stats):
        """Words and statistics as one sparse matrix: place, value, row of every entry."""
        scaled = np.clip((stats - self.mean) / self.spread, -4, 4) * 0.5
        rows = np.repeat(np.arange(len(sizes)), sizes)
        place = np.concatenate((places, np.tile(np.arange(N_STAT) + (1 << WORD_BITS), len(sizes))))
        return place, np.concatenate((values, scaled.ravel())).astype(np.float64), np.concatenate((rows, np.repeat(np.arange(len(sizes)), N_STAT)))

    def logits(self, places, values, sizes, stats) -> np.ndarray:
        place, x, row = self._whole(places, values, sizes, stats)
        n = len(sizes)
        z = self.w0 + np.bincount(row, self.w[place] * x, n)
        for f in range(self.v.shape[1]):
            t = self.v[place, f] * x
            z += 0.5 * (np.bincount(row, t, n) ** 2 - np.bincount(row, t * t, n))
        return z

    def scores(self, places, values, sizes, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(places, values, sizes, stats), -40, 40)))


def fit(places: np.ndarray, values: np.ndarray, sizes: np.ndarray, stats: np.ndarray, label: np.ndarray) -> Machine:
    """Adam on the logistic loss, in batches; the same rows give the same machine."""
    rng = np.random.default_rng(SEED)
    size = (1 << WORD_BITS) + N_STAT
    if len(label) == 0:
        return Machine(0.0, np.zeros(size), np.zeros((size, 0)), np.zeros(N_STAT), np.ones(N_STAT))
    start = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
    m = Machine(start, np.zeros(size), rng.normal(0, 0.05, (size, RANK)), stats.mean(0), stats.std(0) + 1e-6)
    if label.min() == label.max():
        m.v[:] = 0
        return m
    ends = np.cumsum(sizes)
    params = [np.array([m.w0]), m.w, m.v]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), 256):
            batch = order[at:at + 256]
            entries = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in batch])
            m.w0 = float(params[0][0])
            part = (places[entries], values[entries], sizes[batch], stats[batch])
            err = (m.scores(*part) - label[batch]) / len(batch)
            place, x, row = m._whole(*part)
            ex = err[row] * x
            gw = np.bincount(place, ex, size)
            gv = np.empty_like(m.v)
            for f in range(RANK):
                t = m.v[place, f] * x
                gv[:, f] = np.bincount(place, ex * (np.bincount(row, t, len(batch))[row] - t), size)
            step += 1
            for p, g, a, b in zip(params, (np.array([err.sum()]), gw, gv), first, second, strict=True):
                g += DECAY * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    m.w0 = float(params[0][0])
    return m


def learned_rows(labels: DataFrame, label: str, sample: int) -> DataFrame:
    """__id, label of at most ``sample`` rows that may be learned from, chosen by a hash of the id."""
    rows = (labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("label"))
            .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & ~held_out("__id")))
    return rows.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(sample)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Machine:
    """The machine fitted on a bounded sample; only numbers of at most ``sample`` documents reach the driver."""
    schema = pa.schema([("__id", pa.int64()), ("label", pa.int32()), ("places", pa.binary()), ("vals", pa.binary()), ("stats", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            got = [describe(t) for t in str_list(b)]
            yield to_batch({"__id": b.column(0), "label": b.column(2), "places": [g[0].tobytes() for g in got],
                            "vals": [g[1].tobytes() for g in got], "stats": [np.array(g[2], np.float32).tobytes() for g in got]}, schema)

    chosen = F.broadcast(learned_rows(labels, label, sample))
    rows = (id_text(docs).join(chosen, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
            .mapInArrow(run, "__id long, label int, places binary, vals binary, stats binary")
            .groupBy("__id").agg(F.min(F.struct("stats", "label", "places", "vals")).alias("r")).select("__id", "r.*").toArrow())
    rows = rows.sort_by("__id")
    cut = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
    places, vals, stats = cut("places", np.int32), cut("vals", np.float32), cut("stats", np.float32)
    whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return fit(whole(places, np.int32), whole(vals, np.float32), np.array([len(p) for p in places], np.int64),
               np.array(stats, np.float32).reshape(-1, N_STAT), np.array(rows["label"].to_pylist(), np.float64))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            yield to_batch({"doc_id": b.column(0), "score": machine.scores(*_vectors(str_list(b)))}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is at least ``threshold``)."""
    scored = score(docs, train(docs, labels, label, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, label: str = "quality", sample: int = SAMPLE,
              text_col: str = "text") -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns; nothing is shuffled."""
    machine = train(docs, labels, label, sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            good = machine.scores(*_vectors(str_list(b, at))) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
