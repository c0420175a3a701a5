"""Repeated runs of lines, found by winnowing (operator 2).

The lines of a document that hold more than white space are its sequence; blank
ones are kept and do not count.  A line goes if it lies in a run of ``RUN = WINDOW + GRAM - 1``
lines that also starts earlier: in a document with a smaller id, or further up in
the same one.

1. Winnowing: hash every run of ``GRAM`` lines; of every ``WINDOW`` hashes in a row the
   smallest (the last of equal ones) is a fingerprint.  Two equal runs of ``RUN`` lines have
   the same fingerprint at the same place, so none is missed.
2. Positions are joined on the fingerprint: those it shares with no other position drop out.
3. Matches are extended both ways, to the runs of ``RUN`` lines around each remaining
   fingerprint; these are compared as a whole (128 bits of hash over the lines), and those next to one
   another make up longer matches.
4. Of equal runs the first in (id, line) order stays; lines of later ones are deleted.

With ``min_words``, shorter runs go too: one or two lines that hold that many words
together, or that are all lines of their document, and also start earlier.  They are named whole,
without fingerprints, and the first of equal ones stays as in step 4.  A short line or pair
inside a longer document is no repeat.

All rows but those of step 4 are (hash, id, line number); fingerprints and runs are
counted map-side first and looked up again by an equi-join, so a line that a third of
all documents share costs each task one row.  The texts move once, by id, to be cut.

Null texts count as empty (one blank line).  Null ids come before all others.  Rows that
repeat an id are told apart by their text; rows that repeat both are one
document and are cut alike.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import SPACE_RUN, id_text

GRAM, WINDOW = 2, 2
RUN = WINDOW + GRAM - 1
#: Words of a run shorter than ``RUN`` lines, where such runs are asked for.
MIN_WORDS = 50
WHITE = " \t\n\v\f\r"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version (hash of the text), lines, at (numbers of the lines that are not blank)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (id_text(docs, id_col, text_col)
            .select("doc_id", F.xxhash64(text).alias("version"), F.split(text, "\n", -1).alias("lines"))
            .withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.col("lines")[i].rlike(NOT_BLANK))))


def _line(j: Column) -> Column:
    """Line number j of the sequence."""
    return F.col("lines")[F.col("at")[j]]


def fingerprints(lines: DataFrame) -> DataFrame:
    """One row per fingerprint: doc_id, version, j (place in the sequence), print."""
    grams = F.when(F.size("at") >= GRAM, F.transform(F.sequence(F.lit(0), F.size("at") - GRAM),
                                                    lambda j: F.xxhash64(*[_line(j + k) for k in range(GRAM)])))
    # no filter on documents: it would be pushed down and split the text again for every line
    hashed = lines.withColumn("grams", grams)

    def least(start: Column) -> Column:
        """Place of the smallest hash of a window, the last of equal ones."""
        inside = F.array(*[F.struct(F.col("grams")[start + k].alias("print"), (-(start + k)).alias("minus")) for k in range(WINDOW)])
        return -F.array_min(inside)["minus"]

    chosen = F.when(F.size("at") >= RUN, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("grams") - WINDOW), least)))
    return (hashed.select("doc_id", "version", "lines", "at", "grams", F.explode(chosen).alias("j"))
            .withColumn("print", F.col("grams")[F.col("j")]).drop("grams"))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, start: runs of ``RUN`` lines (start: place in the sequence) that also start earlier."""
    prints = fingerprints(_lines(docs, id_col, text_col))
    # the runs that hold all lines of the fingerprint, told by two hashes over their lines
    starts = F.filter(F.sequence(F.col("j") - (RUN - GRAM), F.col("j")), lambda s: (s >= 0) & (s <= F.size("at") - RUN))
    around = F.transform(starts, lambda s: F.struct(
        s.alias("start"), *[F.xxhash64(F.lit(seed), *[_line(s + k) for k in range(RUN)]).alias(f"name{seed}") for seed in (1, 2)]))
    prints = prints.select("doc_id", "version", "print", around.alias("runs"))
    shared = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("print")
    runs = (prints.join(shared, "print", "left_semi").select("doc_id", "version", F.explode("runs").alias("r"))
            .select("doc_id", "version", "r.*").distinct())
    place = F.struct("doc_id", "version", "start")
    first = (runs.groupBy("name1", "name2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("name1", "name2", "first"))
    return runs.join(first, ["name1", "name2"]).where(place > F.col("first")).select("doc_id", "version", "start")


def repeated_short_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, version, start, length: runs under ``RUN`` lines, of ``min_words`` words or a whole document, that also start earlier."""
    # each line once, as two hashes and a number of words; no filter on the arrays, it would be pushed down and make them again for every line
    text = F.coalesce(F.col("text"), F.lit(""))
    inside = F.filter(F.split(text, "\n", -1), lambda x: F.ltrim(x, F.lit(WHITE)) != "")
    told = F.transform(inside, lambda x: F.struct(
        F.xxhash64(F.lit(1), x).alias("name1"), F.xxhash64(F.lit(2), x).alias("name2"),
        F.size(F.array_remove(F.split(x, SPACE_RUN), "")).alias("words")))
    lines = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64(text).alias("version"), told.alias("seq"))

    def of(length: int) -> Column:
        """All runs of ``length`` lines; ``due`` ones go if they are repeats."""
        run = lambda s: [F.col("seq")[s + k] for k in range(length)]
        starts = F.when(F.size("seq") >= length, F.sequence(F.lit(0), F.size("seq") - length)).otherwise(F.array().cast("array<int>"))
        if length > 1:  # where each line is long enough, the lines are told one by one
            starts = F.filter(starts, lambda s: F.least(*[x["words"] for x in run(s)]) < min_words)
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.lit(length).alias("length"),
            ((sum(x["words"] for x in run(s)) >= min_words) | (F.size("seq") == length)).alias("due"),
            *[F.xxhash64(*[x[name] for x in run(s)]).alias(name) for name in ("name1", "name2")]))

    runs = (lines.select("doc_id", "version", F.explode(F.concat(*[of(length) for length in range(1, RUN)])).alias("r"))
            .select("doc_id", "version", "r.*"))
    place, name = F.struct("doc_id", "version", "start"), ["length", "name1", "name2"]
    first = (runs.groupBy(*name).agg(F.min(place).alias("first"), F.max("due").alias("any_due"), F.count(F.lit(1)).alias("n"))
             .where("n > 1 AND any_due").select(*name, "first"))
    return runs.where("due").join(first, name).where(place > F.col("first")).select("doc_id", "version", "start", "length")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, n_spans (deleted runs of lines), kept_text.

    Without ``min_words`` only runs of ``RUN`` lines go.
    """
    runs = repeated_runs(docs, id_col, text_col)
    cut, inside = F.col("start"), lambda s: F.sequence(s, s + RUN - 1)
    if min_words is not None:
        runs = runs.withColumn("length", F.lit(RUN)).unionByName(repeated_short_runs(docs, min_words, id_col, text_col))
        cut, inside = F.struct("start", "length"), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)
    cuts = (runs.groupBy("doc_id", "version").agg(F.collect_set(cut).alias("starts"))
            .select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), "starts"))
    lines = _lines(docs, id_col, text_col).drop("at")
    rows = lines.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("version") == F.col("cut_version")), "left")
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.col("lines")[i].rlike(NOT_BLANK)))
    gone = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(inside(s), lambda j: F.col("at")[j]))))
    rows = rows.withColumn("gone", F.coalesce(F.sort_array(gone), F.array().cast("array<int>")))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    # a deleted run ends where the next line of the sequence stays
    stays = F.array_except("at", F.col("gone"))
    before = F.transform(F.array_sort(F.col("gone")), lambda i: F.struct(i.alias("line"), F.lit(1).alias("gone")))
    order = F.array_sort(F.concat(before, F.transform(stays, lambda i: F.struct(i.alias("line"), F.lit(0).alias("gone")))))
    flags = F.concat_ws("", F.transform(order, lambda x: x["gone"].cast("string")))
    spans = F.size(F.filter(F.split(flags, "0"), lambda run: run != ""))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
                       spans.cast("long").alias("n_spans"),
                       F.concat_ws("\n", F.transform(kept, lambda i: F.col("lines")[i])).alias("kept_text"))
