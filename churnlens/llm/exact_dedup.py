"""Exact copies by progressive refinement, in DataFrame operations only (operator 7).

Texts are equal when they are identical after each run of white space
(U+0020, U+0009 to U+000D) became one space.  Each round looks only at rows that
the rounds before could not tell apart:

1. length of the normalised text, 2. hash of its first ``PREFIX`` characters:
   both are read off in one pass, which moves no text and counts pairs of
   integers; a pair that occurs once is done;
3. SHA-256 of the whole text, only for rows whose pair occurs twice.

Which pairs survive is told to the second pass over the text as a table of
``2 ** FILTER_BITS`` bits, set by the pair's hash and put together as bitmaps of 32,768 bits; its size is
fixed, so it can be sent to every task whatever the input's size.  A pair that shares a bit with another
one is hashed in full without need, and round 3 tells them apart.  After it only
(hash, id) rows are shuffled, counted map-side first, so that a group of copies of
any size is one row per task.  Copies meet their group's row under ``SALTS`` keys a group.

Null texts count as empty and equal each other.  Of equal texts the row with the
smallest id stays; null ids stay only if their group has no other id.  Rows that repeat an
id count each on its own, and all of them with the staying id have ``kept``;
:func:`drop_copies` leaves one of those.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import SPACE_RUN, id_text
from churnlens.session import checkpoint_dir

PREFIX = 64
FILTER_BITS = 22
#: Bits of one bitmap of Spark's bitmap functions.
BITMAP = 32768
SALTS = 8


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def _pair(norm: Column) -> Column:
    """Length and prefix hash of a normalised text."""
    return F.struct(F.octet_length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("prefix"))


def _bit(pair: Column) -> Column:
    return F.pmod(F.xxhash64(pair["n"], pair["prefix"]), F.lit(1 << FILTER_BITS))


def _filter_bits(pairs: DataFrame) -> DataFrame:
    """The pairs as one row: an array of 2 ** FILTER_BITS / BITMAP bitmaps, empty where no bit is set."""
    bit = _bit(F.col("pair"))
    maps = pairs.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / BITMAP).alias("at")).agg(
        F.bitmap_construct_agg((F.col("bit") % BITMAP)).alias("bits"))
    places = F.sequence(F.lit(0), F.lit(max(1, (1 << FILTER_BITS) // BITMAP) - 1))
    return (maps.agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("m"))
            .select(F.transform(places, lambda at: F.coalesce(F.col("m")[at.cast("long")], F.lit(b""))).alias("bits")))


def _survives(pairs: DataFrame, pair: Column) -> Column:
    """Whether a row's bit is set, that is, whether another row may have its length and prefix hash.

    The bit table is made once and written, for all passes that read it.
    """
    bits = _filter_bits(pairs).checkpoint().scalar()
    bit = _bit(pair)
    byte = F.substring(F.element_at(bits, F.floor(bit / BITMAP).cast("int") + 1), F.floor((bit % BITMAP) / 8).cast("int") + 1, F.lit(1))
    # an empty bitmap gives no byte, and no bit
    return F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (bit % 8).cast("int")) == 1, F.lit(False))


def _refined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """doc_id and norm of every row, and the column (of norm) that says which rows rounds 1 and 2 leave for round 3."""
    checkpoint_dir(docs.sparkSession)
    rows = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    repeated = rows.select(_pair(F.col("norm")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("pair")
    return rows, _survives(repeated, _pair(F.col("norm")))


def _groups(hashed: DataFrame) -> DataFrame:
    """sha, keep_id, group_size of the hashes that two rows or more have."""
    return (hashed.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count("sha").alias("group_size")).where("group_size > 1"))


def _with_group(hashed: DataFrame, how: str) -> DataFrame:
    """The rows with their group's columns; a group's rows are dealt over ``SALTS`` keys."""
    groups = _groups(hashed.where("again")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(groups, ["sha", "salt"], how)


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: text_sha256, keep_id, group_size."""
    rows, again = _refined(docs, id_col, text_col)
    # null where round 3 isn't needed
    hashed = rows.select("doc_id", F.when(again, F.sha2("norm", 256)).alias("sha"))
    return _groups(hashed).withColumnRenamed("sha", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Every text's hash is asked for here, so (id, hash) rows are written once and the groups are found on those.
    """
    rows, again = _refined(docs, id_col, text_col)
    hashed = rows.select("doc_id", F.sha2("norm", 256).alias("sha"), again.alias("again")).checkpoint()
    return (_with_group(hashed, "left")
            .select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("group_size").isNull() | F.col("keep_id").eqNullSafe(F.col("doc_id"))).alias("kept"), F.col("sha").alias("text_sha256")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever those are called.

    Only texts that length and prefix hash leave open are hashed.  Copies are found on (id, hash) rows,
    written once; the texts move once, by id, so that a large group of copies is spread.
    Of rows that repeat id and text one stays.
    """
    rows, again = _refined(docs, id_col, text_col)
    sha = F.when(again, F.sha2("norm", 256)).alias("sha")
    hashed = rows.select("doc_id", sha).checkpoint().where("sha is not null").withColumn("again", F.lit(True))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    gone = (_with_group(hashed, "inner").where(~F.col("keep_id").eqNullSafe(F.col("doc_id"))).select(key, "sha"))
    own = (docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col).cast("string")).alias("norm"))
           .select("row", key, _pair(F.col("norm")).alias("pair"), sha))
    # rows without a hash differ from all others in length or prefix
    return own.join(gone, ["key", "sha"], "left_anti").dropDuplicates(["key", "sha", "pair"]).select("row.*")
