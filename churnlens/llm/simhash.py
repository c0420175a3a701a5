"""SimHash near-copies with pigeonring filtering (operator 8).

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the
XXH64 hashes (seed 42) of the text's ``WORDS``-word shingles, repeats included.
Two fingerprints are linked if at most ``MAX_BITS`` bits differ; a component is
everything that links reach.

Pigeonring: cut the 64 bits into a ring of ``MAX_BITS + 1`` segments.  If two
fingerprints differ in at most ``MAX_BITS`` bits, there is a segment to start from such
that, for every k, the chain of k segments from there differs in at most
``k * MAX_BITS / (MAX_BITS + 1)`` bits (rounded down): 0, then at most 1, then at most 2.
A fingerprint is a candidate only while some chain from some start has a partner:

* chain of 2, roughly: another fingerprint has the same segment and the same one of the
  next one's halves, since at most one bit of that may differ;
* chain of 2: another one has the same segment and the next one but for one bit
  at most (one key for each bit that may be left out);
* full ring: the Hamming check over all 64 bits.  Fingerprints within ``MAX_BITS = 2``
  bits have a common neighbour at distance 1 of both (or are such neighbours
  themselves), and whatever shares a neighbour is within 2 bits.  So each candidate is listed
  under itself and its 64 neighbours; at most 65 fingerprints meet under one key.

No round makes pairs: each counts keys map-side first and looks its rows up again,
so copies, near copies and frequent segments cost rows in proportion to their
number.  Links go from each fingerprint to the smallest one under each key, which
keeps the components; none has more than 65 x 64 of them.  Components are found by
passing the smallest label along links and following labels of labels, with
reliable checkpoints, until nothing changes.

Null texts, and texts without words, have fingerprint 0 and are linked like any
other.  Null ids never name a component unless it has no other id.  Rows that repeat an id are
rows of their own.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, rows_of, str_list, to_batch
from churnlens.session import checkpoint_dir

WORDS = 3
MAX_BITS = 2
SEED = 42
#: Start and length of the ring's segments.
RING = ((0, 21), (21, 21), (42, 22))
ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
OTHER_SPACE = str.maketrans({chr(c): " " for c in range(9, 14)})


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle: runs of ``words`` words joined by one space; fewer words make one shingle."""
    from xxhash import xxh64_intdigest
    parts = [w for w in text.translate(ASCII_LOWER).translate(OTHER_SPACE).encode().split(b" ") if w]
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined, at, ends = b" ".join(parts), [0], []
    p = 0
    for w in parts:
        p += len(w)
        ends.append(p)
        p += 1
        at.append(p)
    return np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(at, ends[words - 1:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # long texts in parts
        bits = np.unpackbits(hashes[i:i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(hashes)))


def _row_key(id_col: str, text_col: str) -> Column:
    """Names rows of equal id and text; a null text counts as empty."""
    return F.sha2(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and, if ``keyed``, the row's key."""
    rows, schema = id_text(docs, id_col, text_col), pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    if keyed:
        rows, schema = rows.withColumn("key", _row_key("doc_id", "text")), schema.append(pa.field("key", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            fps = np.array([fingerprint(shingle_hashes(t, words)) for t in str_list(b)], np.uint64)
            yield to_batch({"doc_id": b.column(0), "fp": fps.view(np.int64), "key": b.column(2) if keyed else None}, schema)

    return rows.mapInArrow(run, "doc_id long, fp long" + ", key string" * keyed)


def _segment(fp: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << length) - 1))


def _partnered(rows: DataFrame, key: list[str]) -> DataFrame:
    """The (fp, start) of rows whose key another fingerprint has too."""
    shared = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)
    return rows.join(shared, key, "left_semi")


def pigeonring_candidates(fps: DataFrame) -> DataFrame:
    """The distinct fingerprints (column fp) that have a partner for a chain of two segments."""
    fp = F.col("fp")

    def rough(i: int) -> list[Column]:
        """A segment with each half of the next one."""
        start, length = RING[(i + 1) % len(RING)]
        halves = ((start, length // 2), (start + length // 2, length - length // 2))
        return [F.struct(F.lit(i).alias("start"), F.lit(h).alias("half"), _segment(fp, *RING[i]).alias("seg"), _segment(fp, *part).alias("next"))
                for h, part in enumerate(halves)]

    one = fps.select("fp", F.explode(F.array(*[k for i in range(len(RING)) for k in rough(i)])).alias("k")).select("fp", "k.*")
    one = _partnered(one, ["start", "half", "seg", "next"]).select("fp", "start", "seg").distinct()

    def left_out(i: int) -> Column:
        """The next segment with each of its bits left out in turn."""
        start, length = RING[(i + 1) % len(RING)]
        return F.array(*[F.struct(F.lit(b).alias("bit"), _segment(fp, start, length).bitwiseAND(F.lit(((1 << length) - 1) & ~(1 << b))).alias("next"))
                         for b in range(length)])

    variants = F.when(F.col("start") == 0, left_out(0)).when(F.col("start") == 1, left_out(1)).otherwise(left_out(2))
    two = one.select("fp", "start", "seg", F.explode(variants).alias("k")).select("fp", "start", "seg", "k.bit", "k.next")
    return _partnered(two, ["start", "seg", "bit", "next"]).select("fp").distinct()


def links(candidates: DataFrame) -> DataFrame:
    """a, b (a < b): candidates within two bits, as stars around the smallest one under each neighbour."""
    fp = F.col("fp")
    near = F.array(fp, *[fp.bitwiseXOR(F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b)) for b in range(64)])
    keys = candidates.select("fp", F.explode(near).alias("near"))
    stars = keys.groupBy("near").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return (stars.select("a", F.explode("all").alias("b")).where("a < b")
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).distinct())


def components(edges: DataFrame) -> DataFrame:
    """fp, label: the smallest fingerprint that links reach, for every fingerprint with a link."""
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    label = both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        # the smallest label among neighbours, then the label of that label
        seen = (both.join(label, both["b"] == label["fp"]).groupBy("a").agg(F.min("label").alias("other")))
        passed = (label.join(seen, label["fp"] == seen["a"], "left")
                  .select("fp", F.least("label", F.coalesce("other", "label")).alias("new"), F.col("label").alias("old")))
        up = label.select(F.col("fp").alias("via"), F.col("label").alias("up"))
        after = (passed.join(up, F.col("new") == F.col("via"), "left")
                 .select("fp", F.least("new", F.coalesce("up", "new")).alias("label"), "old").checkpoint())
        label = after.select("fp", "label")
        if after.where("label <> old").isEmpty():
            return label


def _labelled(distinct: DataFrame) -> DataFrame:
    """The rows (one per fp, checkpointed) with the label of their component."""
    label = components(links(pigeonring_candidates(distinct.select("fp")).checkpoint()))
    return distinct.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def _check_bits(max_bits: int) -> None:
    if max_bits != MAX_BITS:
        raise ValueError(f"the ring and the neighbour keys are made for {MAX_BITS} bits")


def near_groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest id that links reach)."""
    _check_bits(max_bits)
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, words, id_col, text_col).checkpoint()
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).checkpoint()
    named = _labelled(distinct)
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(smallest, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_groups(docs, words, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, of rows that repeat it one text.

    The row is chosen on (id, fingerprint, key) rows, first by fingerprint and then by component.
    """
    _check_bits(max_bits)
    checkpoint_dir(docs.sparkSession)
    rows = fingerprints(docs, words, id_col, text_col, keyed=True).checkpoint()
    order = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key")
    first = _labelled(rows.groupBy("fp").agg(F.min(order).alias("first")).checkpoint())
    stay = first.groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    # the row as one struct, so that its columns can have any name
    own = docs.select(F.struct("*").alias("row"), _row_key(id_col, text_col).alias("key"))
    return own.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
