"""How quality filters interact, over every order in which they can run (operator 12).

A document's failures are one mask with a bit per filter:

* A: under ``MIN_WORDS`` words, B: fewer than ``DISTINCT_PERCENT`` distinct words in 100,
* C: more than ``CAPITAL_PERCENT`` of its code points are ``[A-Z]``, D: it holds one of ``#$%&*|``,
* E: its text is identical to that of a document with a smaller id, in the whole table.

Words are maximal runs without U+0020 and U+0009 to U+000D, case-sensitive.

What a filter order does to a document depends on its mask alone.  So documents are
counted into cells (part, mask, good, toxic) first, map-side, and only cells
meet the orders: each cell folds over the array of all orders (``transform`` over the
orders, ``aggregate`` over an order's steps), which gives one weighted struct per
order and step; the structs of a part's cells are then summed element by element.
The array is a constant of the plan: ``k!`` orders of ``k`` filters, 120 for five.

Filter E needs no join of documents with their copies.  Rows with one text have one
mask, so per text it is enough to count the rows of each (part, labels) and to know how
many of them have the smallest id: all others fail.  A text that a third of all rows share is
counted map-side, and at most one row per (part, labels) of it meets in a task.

Null texts are empty, null parts are the empty string.  A null id is neither smaller nor
larger than another, so such a row never fails E and makes no other row fail it; it has no labels.
Rows that repeat an id count each on its own; where the smallest id of a text repeats, none
of its rows fails E.  Labels that repeat an id count as good or toxic if one row says so.
An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = "[#$%&*|]"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Filters that look at one text, then the one that looks for earlier copies.
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C, D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    # the word list is bound once; both counts read it
    of_words = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    bits = [of_words["n"] < MIN_WORDS, of_words["distinct"] * 100 < of_words["n"] * DISTINCT_PERCENT,
            capitals * 100 > F.length(text) * CAPITAL_PERCENT, text.rlike(SYMBOLS)]
    mask = F.lit(0)
    for i, b in enumerate(bits):
        mask = mask + F.when(b, 1 << i).otherwise(0)
    return mask


def mask_cells(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, good, toxic, n: documents by what they fail, their labels and their part."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", text_mask(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("sha"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
             .groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    no = F.lit(False)
    rows = rows.join(marks, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})

    kind = ["sha", "part", "mask", "good", "toxic"]
    per_id = rows.groupBy("doc_id", *kind).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    per_text = per_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(has_id, F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"))
    smallest = F.min("least.doc_id").over(Window.partitionBy("sha"))
    first = F.when(F.col("least.doc_id") == smallest, F.col("least.n")).otherwise(0)
    per_text = per_text.withColumn("later", F.col("with_id") - first)
    later = F.col("later")
    both = F.array(F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), later.alias("n")),
                   F.struct("mask", (F.col("n") - later).alias("n")))
    return (per_text.select("part", "good", "toxic", F.explode(both).alias("c")).where("c.n > 0")
            .groupBy("part", "c.mask", "good", "toxic").agg(F.sum("c.n").alias("n")))


def _orders(k: int) -> Column:
    return F.array(*[F.array(*map(F.lit, o)) for o in permutations(range(k))])


def _fold(k: int) -> Column:
    """One struct per order and step, of a cell's mask, n, good and toxic."""
    mask, n, good, toxic = F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")
    zero = F.lit(0).cast("long")

    def step(acc: Column, f: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), f)
        hit, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(acc["seen"]) != 0
        here = hit & ~gone
        seen = acc["seen"].bitwiseOR(bit)
        weigh = {"kept": mask.bitwiseAND(seen) == 0, "removed": here, "redundant": hit & gone, "unique_fails": mask == bit,
                 "good_lost": here & good, "toxic_lost": here & toxic}
        out = F.struct(f.alias("filter"), *[F.when(weigh[c], n).otherwise(zero).alias(c) for c in COUNTS])
        return F.struct(seen.alias("seen"), F.concat(acc["steps"], F.array(out)).alias("steps"))

    kind = "array<struct<filter:int," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>"
    start = F.struct(F.lit(0).alias("seen"), F.array().cast(kind).alias("steps"))
    return F.flatten(F.transform(_orders(k), lambda order: F.aggregate(order, start, step, lambda acc: acc["steps"])))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter order and step; ``cells`` as from :func:`mask_cells`, a bit per letter of ``filters``."""
    k = len(filters)
    names = F.array(*[F.lit("".join(o)) for o in permutations(filters)])
    structs = cells.select("part", F.posexplode(_fold(k)).alias("pos", "s"))
    sums = structs.groupBy("part", "pos", "s.filter").agg(*[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    # a part has k! x k rows here, whatever it holds
    of_filter = Window.partitionBy("part", "filter")
    return sums.select("part", F.element_at(names, F.floor(F.col("pos") / k).cast("int") + 1).alias("filter_order"),
                       (F.col("pos") % k + 1).cast("int").alias("step"), *COUNTS, F.sum("removed").over(of_filter).alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The five filters over ``docs``, in all 120 orders: part, filter_order, step, counts and shapley (the filter's removals over all orders)."""
    return audit(mask_cells(docs, labels, part_col))
