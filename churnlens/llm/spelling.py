"""Spelling variants of a corpus's words by asymmetric q-chunks (operator 11).

Words are near if one inserted, deleted or replaced code point leads from one to the other.
Of a near pair one word (the shorter, either if they are equally long) contributes *two
disjoint chunks*, its halves; the other contributes its *positional grams*.  One edit
touches one half at most, so the other half stands in the other word as a gram, at the same position or,
behind an edit that made the word longer, shifted by one: an equi-join on
(length, half, shift, gram) finds every near pair, and a check of the distance removes the rest.

Halves are frequent (``inter...``, ``...ation``), and the pairs of a frequent half grow with the
square of its words.  So no group of over ``GROUP`` rows is ever paired.  Its
words go another round: the half that may hold the edit is itself cut into two chunks, of which one edit again
preserves one, and the join key is what is preserved so far.  Rounds go on until the part
that may differ is one code point (replaced) or none (inserted); a group is then
at most one word per letter of the alphabet, and all its pairs are near.  Every
round looks at all words of the groups that were too large; none is dropped.

Keys are 64-bit hashes of what must agree; words that meet by collision fail the check.
Large groups are found by counting keys map-side, and their words are picked by a salted join,
so that a key which a third of all words share is spread over tasks.

A word's *form* is its near word of largest count if that is at least twice its own
(ties: smallest in code-point order); its *root* is what following forms ends at.  Counts
double with every step, so doubling jumps reach all roots in a few rounds.

Null texts have no words; a null id counts as the empty text in the typo rule of
:func:`typo_words`.  Rows that repeat an id or a text count each on its own.  An empty table has no words.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text
from churnlens.session import checkpoint_dir

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPO_EVERY = 97
MIN_LENGTH, MIN_COUNT = 5, 3
#: A group of at most so many rows is paired; larger ones are cut further.
GROUP = 32
SALTS = 16


def typo_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = TYPO_EVERY) -> DataFrame:
    """word: every run of letters, ASCII lower-cased; where ``typo_every`` divides h, without the code point at h modulo its length.

    h is the crc32 of ``<id>:<run>``.
    """
    runs = id_text(docs, id_col, text_col).select(
        "doc_id", F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(h % typo_every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words of at least ``min_length`` code points that occur at least ``min_count`` times."""
    return (words.where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_count))


def _keyed(windows: DataFrame) -> DataFrame:
    """Adds ``key``: length of the shorter word, shift, window, and the two chunks that must agree."""
    behind = F.when(F.col("role") == 1, F.col("shift")).otherwise(0)
    before, after = F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.col("b") + behind + 1, F.length("word"))
    return windows.withColumn("key", F.xxhash64(F.length("word") - behind, "shift", "a", "b", before, after))


def _halves() -> Column:
    """What a window (a, b) is cut into.

    Replaced code points are at a to b - 1, down to one; code points are inserted before one of a to b,
    so those windows share their border and go down to a = b.
    """
    a, b = F.col("a"), F.col("b")
    middle = F.floor((a + b) / 2).cast("int")
    windows = lambda *ends: F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ends])
    return (F.when(b - a >= 2, windows((a, middle), (middle, b)))
            .when(F.col("shift") == 1, windows((a, a), (b, b))).otherwise(windows((a, b))))


def _cut(windows: DataFrame) -> DataFrame:
    return windows.select("word", "role", "shift", F.explode(_halves()).alias("w")).select("word", "role", "shift", "w.a", "w.b")


def near_pairs(words: DataFrame, word_col: str = "word", group: int = GROUP) -> DataFrame:
    """short, long: every pair of distinct words at distance one, once; the first is shorter, or smaller where they are equally long."""
    checkpoint_dir(words.sparkSession)
    base = words.select(F.col(word_col).alias("word")).where("word is not null").distinct()
    zero = F.lit(0)
    roles = F.array(F.struct(zero.alias("role"), zero.alias("shift"), zero.alias("a"), F.length("word").alias("b")),
                    F.struct(zero.alias("role"), F.lit(1).alias("shift"), zero.alias("a"), F.length("word").alias("b")),
                    F.struct(F.lit(1).alias("role"), F.lit(1).alias("shift"), zero.alias("a"), (F.length("word") - 1).alias("b")))
    open_ = base.select("word", F.explode(roles).alias("r")).select("word", "r.*").where("b >= 0")
    found = None
    while True:
        rows = _keyed(_cut(open_)).checkpoint()
        counts = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("role").alias("least"), F.max("role").alias("most"),
                                          F.max("shift").alias("shift"), F.max(F.col("b") - F.col("a")).alias("open"))
                  .where("if(shift = 0, rows > 1, least < most)"))
        # a replaced code point is pinned down once its window is one wide, an inserted one at none
        done = (F.col("rows") <= group) | (F.col("open") <= 1 - F.col("shift"))
        pairs = _pairs(rows, counts.where(done).select("key")).checkpoint()
        found = pairs if found is None else found.unionByName(pairs)
        large = counts.where(~done).select("key").checkpoint()
        if large.isEmpty():
            return found.distinct()
        open_ = _picked(rows, large).select("word", "role", "shift", "a", "b")


def _picked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with one of ``keys``, each key dealt over ``SALTS`` tasks."""
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi").drop("salt")


def _pairs(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Near pairs among rows of one key; the groups are bounded."""
    kept = rows.join(keys, "key", "left_semi")
    short = kept.where("role = 0").select("key", "shift", F.col("word").alias("short"))
    long = kept.where("role = 1 or shift = 0").select("key", F.col("word").alias("long"))
    return (short.join(long, "key").where((F.col("shift") == 1) | (F.col("short") < F.col("long")))
            .where(F.levenshtein("short", "long", 1) == 1).select("short", "long"))


def forms(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: each word with its near words counted and its form, if it has one."""
    a, b = vocab.select(F.col("word").alias("short"), F.col("n").alias("short_n")), vocab.select(F.col("word").alias("long"), F.col("n").alias("long_n"))
    both = pairs.join(a, "short").join(b, "long")
    ways = F.array(F.struct(F.col("short").alias("word"), F.col("long").alias("near"), F.col("long_n").alias("near_n")),
                   F.struct(F.col("long").alias("word"), F.col("short").alias("near"), F.col("short_n").alias("near_n")))
    near = (both.select(F.explode(ways).alias("w")).select("w.*").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")))
    has = -F.col("best.order") >= 2 * F.col("n")
    return vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.order")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word, root for every word that has a form: the last one that forms lead to."""
    checkpoint_dir(formed.sparkSession)
    at = formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")).checkpoint()
    while not at.where("moved").isEmpty():
        up = at.select(F.col("word").alias("via"), F.col("root").alias("up"))
        at = (at.join(up, at["root"] == up["via"], "left")
              .select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")).checkpoint())
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """word, n, n_near, form, form_n, root of the corpus's words."""
    checkpoint_dir(docs.sparkSession)
    vocab = vocabulary(typo_words(docs, typo_every=typo_every), min_length, min_count).checkpoint()
    formed = forms(vocab, near_pairs(vocab)).checkpoint()
    return (formed.join(roots(formed), "word", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")))
