"""Toxic passages by maximum-scoring segment search (operator 4).

Learning.  In at most ``SAMPLE`` labelled documents each word counts once per
document, and documents that look like copies of one another share one
count, so that a copied text does not teach its whole vocabulary.  A word's log odds of
toxic against clean documents, and those of its beginnings of a few letters, have an informative Dirichlet prior: ``PRIOR`` of all
documents, spread over words as they occur.  A word's score is what its log odds surely are (``SURE`` standard
deviations towards zero): if the lower end, less the log odds of a document being clean, is positive, that;
if the upper end is below ``-DRIFT``, that; all other words, and those never seen, cost ``DRIFT``.  A word
has the best score of itself and its beginnings.

Search.  One pass over a document's scores finds all maximal segments in
linear time (those that can't be made better by growing or shrinking and do not overlap): each
segment keeps a link to the nearest one before it that starts lower, and searches follow links.

Calibration.  The best segment of n clean words exceeds S with probability
``1 - exp(-K n exp(-lambda S))``.  ``lambda`` solves ``E exp(lambda * score) = 1`` over the
words of clean documents, and ``K`` is fitted to their best segments.  A segment is
significant if it is expected less than once in its document; a document's evidence is the sum of
``-ln(expected)`` over its significant segments, and its score the logistic function of
``ln(1 + evidence)``, fitted on the learned documents.

Null texts count as empty and have the score of a document without evidence.
Without labels, or with one class only, no word has a score and all documents get
the share of toxic ones (smoothed; 0 without labels).  Repeated and null ids are scored row by
row.  Inputs of a score are the words alone; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import held_out, id_text, rows_of, str_list, to_batch, worker_cache
from churnlens.llm.quality_fm import learned_rows
from churnlens.session import checkpoint_dir

#: Labelled documents that word scores are learned from, at most.
SAMPLE = 12_000
PRIOR, SURE, DRIFT = 0.02, 2.0, 0.25
#: Added to the documents without a word, so that a word of all documents has finite odds.
HALF = 0.5
CACHED_WORDS = 500_000
#: Lengths of the beginnings that a word is known by.
STEMS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+").findall


def places(word: str) -> list[int]:
    """Hashes of what a word is known by: itself and its beginnings, since many endings share a stem."""
    return [zlib.crc32(word.encode()), *[zlib.crc32(word[:k].encode() + b"*") for k in STEMS if len(word) >= k]]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first word, last word, score) of all maximal segments of a document's word scores."""
    sums = np.cumsum(scores)
    at = np.flatnonzero(scores > 0)
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum with it, link
    for first, total in zip(at.tolist(), sums[at].tolist(), strict=True):
        last, low = first, total - float(scores[first])
        while True:
            # the nearest earlier segment that starts lower; those between a segment and its link start no lower than it
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
        found.append((first, last, low, total, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


class Model:
    """Word scores by hash, and the constants of the calibration."""

    def __init__(self, scores: dict[int, float], rate: float = 1.0, log_k: float = 0.0, slope: float = 0.0, base: float = -40.0):
        self.scores, self.rate, self.log_k, self.slope, self.base = scores, rate, log_k, slope, base
        self.key = hashlib.sha256(repr(sorted(scores.items())).encode()).hexdigest()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The score of each word; a worker keeps the words of one model, known by what it holds."""
        home = worker_cache("toxic_words")
        if home.get("model") != self.key or len(home["words"]) > CACHED_WORDS:
            home.update(model=self.key, words={})
        cache = home["words"]
        got = list(map(cache.get, words))
        if None in got:
            for i, g in enumerate(got):
                if g is None:
                    known = [self.scores[p] for p in places(words[i]) if p in self.scores]
                    got[i] = cache[words[i]] = max(known, default=-DRIFT)
        return np.array(got, np.float64)

    def significant(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """(first word, last word, score, -ln of the expected number) of the significant segments."""
        log_n = float(np.log(max(len(words), 1)))
        rows = [(a, b, s, self.rate * s - self.log_k - log_n) for a, b, s in maximal_segments(self.word_scores(words))]
        return [r for r in rows if r[3] > 0]

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.base + self.slope * np.log1p(evidence), -40, 40))))


def _word_scores(docs: DataFrame, chosen: DataFrame) -> tuple[dict[int, float], DataFrame]:
    """Word scores by hash; the learned documents as rows (label, words), written once: at most ``SAMPLE``."""
    schema = pa.schema([("label", pa.int32()), ("copy_key", pa.int64()), ("places", pa.list_(pa.int64())), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            words = [WORDS(t.lower()) for t in str_list(b)]
            known = [sorted({p for w in set(ws) for p in places(w)}) for ws in words]
            # copies share their smallest hashes, whatever a few other words are
            keys = [zlib.crc32(repr(p[:3]).encode()) for p in known]
            yield to_batch({"label": b.column(2), "copy_key": keys, "places": known, "words": words}, schema)

    rows = (id_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
            .mapInArrow(run, "label int, copy_key long, places array<long>, words array<string>").checkpoint())
    weights = rows.groupBy("copy_key").agg(F.count(F.lit(1)).alias("copies"))
    weighted = rows.select("label", "copy_key", "places").join(weights, "copy_key").withColumn("weight", 1 / F.col("copies"))
    sums = weighted.groupBy().agg(F.sum(F.col("weight") * F.col("label")).alias("toxic"), F.sum("weight").alias("all")).first()
    toxic, every = float(sums["toxic"] or 0), float(sums["all"] or 0)
    if toxic == 0 or toxic == every:
        return {}, rows
    clean, prior = every - toxic, PRIOR * every
    y = F.col("toxic") + F.lit(prior / every) * F.col("all")
    x = F.col("all") - F.col("toxic") + F.lit(prior / every) * F.col("all")
    odds = F.log(y / (toxic + prior - y + HALF)) - F.log(x / (clean + prior - x + HALF))
    counts = (weighted.select("label", "weight", F.explode("places").alias("place"))
              .groupBy("place").agg(F.sum(F.col("weight") * F.col("label")).alias("toxic"), F.sum("weight").alias("all"))
              .select("place", odds.alias("odds"), (SURE * F.sqrt(1 / y + 1 / x)).alias("doubt")))
    low, high = F.col("odds") - F.col("doubt") - float(np.log(clean / toxic)), F.col("odds") + F.col("doubt")
    scores = (counts.select("place", F.when(low > 0, low).when(high < -DRIFT, high).alias("score")).where("score is not null").toArrow())
    return dict(zip(scores["place"].to_pylist(), scores["score"].to_pylist(), strict=True)), rows


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Word scores and calibration, from a bounded sample; word counts are summed by Spark."""
    checkpoint_dir(docs.sparkSession)
    scores, rows = _word_scores(docs, learned_rows(labels, label, sample))
    model = Model(scores)

    def segments_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.int32()), ("n", pa.int64()), ("segments", pa.list_(pa.float64()))])
        for b in rows_of(batches):
            words = b.column(1).to_pylist()
            yield to_batch({"label": b.column(0), "n": [len(ws) for ws in words],
                            "segments": [[s for _, _, s in maximal_segments(model.word_scores(ws))] for ws in words]}, schema)

    def scores_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("score", pa.float64()), ("n", pa.int64())])
        for b in batches:
            value, n = np.unique(np.concatenate([np.zeros(0), *map(model.word_scores, b.column(0).to_pylist())]), return_counts=True)
            yield to_batch({"score": value, "n": n}, schema)

    seen = rows.select("label", "words").mapInArrow(segments_of, "label int, n long, segments array<double>").toArrow()
    y, n = np.array(seen["label"].to_pylist(), np.float64), np.array(seen["n"].to_pylist(), np.float64)
    if len(y) == 0:
        return Model({})
    if not scores:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model({}, base=float(np.log(share / (1 - share))))
    segments = seen["segments"].to_pylist()
    clean = np.flatnonzero(y == 0)
    # how often each score occurs in clean documents: no more rows than the model has scores
    spread = rows.where("label = 0").select("words").mapInArrow(scores_of, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).toArrow()
    value, often = np.array(spread["score"].to_pylist(), np.float64), np.array(spread["n"].to_pylist(), np.float64)
    if not (value > 0).any():  # no toxic word ever occurs in a clean document: count the mean one once
        value, often = np.append(value, np.mean([s for s in scores.values() if s > 0] or [1.0])), np.append(often, 1.0)
    if not (value < 0).any():
        value, often = np.append(value, -DRIFT), np.append(often, 1.0)
    # lambda: bisection on E exp(lambda * score) - 1, whose positive root it is
    low, high = 1e-6, 1.0
    grows = lambda r: (np.exp(r * value) * often).sum() / often.sum() - 1
    while grows(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grows(mid) < 0 else (low, mid)
    rate = min(high, 8.0)
    # K: documents without a segment say exp(-K n) too; maximum likelihood for 1 - exp(-K n exp(-rate S))
    reach = sum(float(n[i]) * np.exp(-rate * max(segments[i], default=0.0)) for i in clean) + 1.0
    log_k = float(np.log((sum(bool(segments[i]) for i in clean) + 1.0) / reach))
    evidence = np.array([sum(max(0.0, rate * s - log_k - np.log(max(m, 1.0))) for s in segs) for segs, m in zip(segments, n, strict=True)])
    base, slope = _logistic(np.log1p(evidence), y)
    return Model(scores, rate, log_k, slope, base)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of a logistic fit with weak priors, by Newton steps."""
    a = np.array([np.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.1])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * a
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a = a - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    return float(a[0]), max(float(a[1]), 0.0)


def toxic_segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every significant passage: doc_id, first_word, last_word, score, p_value."""
    schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), str_list(b), strict=True) for r in model.significant(WORDS(t.lower()))]
            yield to_batch({"doc_id": [r[0] for r in rows], "first_word": [r[1] for r in rows], "last_word": [r[2] for r in rows],
                            "score": [r[3] for r in rows], "p_value": [float(-np.expm1(-np.exp(-r[4]))) for r in rows]}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, first_word long, last_word long, score double, p_value double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_segments (significant passages) of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_segments", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            found = [model.significant(WORDS(t.lower())) for t in str_list(b)]
            yield to_batch({"doc_id": b.column(0), "score": [model.score(sum(r[3] for r in rows)) for rows in found],
                            "n_segments": [len(rows) for rows in found]}, schema)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, n_segments long")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is at least ``threshold``), n_segments."""
    scored = score(docs, train(docs, labels, label, sample))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "n_segments")
