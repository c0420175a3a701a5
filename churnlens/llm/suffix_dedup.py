"""Repeated passages by distributed prefix doubling (operator 5).

A byte goes if it lies in a run of ``LENGTH`` bytes that also starts in a document with a
smaller id.  Suffixes are compared by names of their first 1, 2, 4, 8, ... bytes:
the name of 2n bytes at p is made from the names of n bytes at p and at p + n.  Names
are 64-bit fingerprints, so a pair has the same name in every task without being
ranked over the network, and Spark only has to tell which names are still shared.

0. Whole copies are settled first, on (id, SHA-256) rows.  All runs of a text also start in the first
   document that has it; so copies with a larger id go whole, and only the first one takes part in what follows.
1. Up to ``FIRST`` bytes, names are made inside a document.  Every run of ``LENGTH`` bytes is put
   under the smallest of the names that start in it.  Equal runs are put under the same
   name, and neighbours mostly share theirs, so a document has one name to send for
   some ten positions.
2. Round one: names are dealt over the buckets of their hash and sorted there; those that two
   documents have are still open, all others are unique and drop out.
3. Round two: the runs under open names go on to their full length.  They are dealt by
   name again (the bytes of neighbouring runs as one span), named at ``LENGTH`` bytes by
   further doubling, and ranked: each learns whether a smaller id has it.  Runs of one name are compared
   byte by byte before anything goes, so a collision of names costs time, never text.  That is past the
   threshold, so no more rounds follow.
4. Covered bytes are cut out.

Documents are worked on in blocks of about ``BLOCK_BYTES``, and long ones piece by piece, so that names take a fixed
room beside the text itself.  A block sends each name, and each
span with its smallest id, once, however many of its documents have it.  A name that more
than ``COMMON`` blocks have is dealt by the runs themselves instead of by name, so that what surrounds a
frequent passage is spread over buckets; the results are the same.  Texts cross one shuffle, which
all three passes over them read.

Null texts count as empty; null ids count as larger than all others.  Rows that repeat an id do not match
one another.  Texts shorter than ``LENGTH`` bytes lose nothing.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import id_text, to_batch
from churnlens.session import checkpoint_dir

LENGTH, FIRST = 50, 32
BLOCK_BYTES = 2_000_000
#: Runs of a text that are named at a time.
PIECE = 1 << 18
#: Blocks whose names share a bucket, about.
BUCKET_BLOCKS = 8
COMMON = 1024
#: Longest series of runs that is sent as one span.
SERIES = 32
NO_ID = (1 << 63) - 1
MIX, STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
NAME_BYTES = 6


def names(data: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` bytes, by doubling; the last step pairs two overlapping halves."""
    if len(data) < length:
        return np.zeros(0, np.uint64)
    h, n, m = (data.astype(np.uint64) + np.uint64(1)) * MIX, 1, int(STEP)
    while n < length:
        d = min(n, length - n)
        right = h[d:]
        h = h[:-d] * np.uint64(m) + (right ^ (right >> np.uint64(29)))
        n, m = n + d, (m * int(STEP) | 1) & ((1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ (h >> np.uint64(29))


def under(data: np.ndarray) -> np.ndarray:
    """For every run of ``LENGTH`` bytes the smallest name of ``FIRST`` bytes in it, cut to ``NAME_BYTES`` bytes."""
    h, n, width = names(data, FIRST), 1, LENGTH - FIRST + 1
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64)
    while n < width:
        d = min(n, width - n)
        h, n = np.minimum(h[:-d], h[d:]), n + d
    # the top bits of a minimum are mostly 0: mix once more, so that buckets are even
    return (h * STEP) >> np.uint64(64 - 8 * NAME_BYTES)


def _packed(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    a = np.zeros((len(blob) // NAME_BYTES, 8), np.uint8)
    a[:, :NAME_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, NAME_BYTES)
    return a.view("<u8").ravel()


def _bucket(name: np.ndarray, buckets: int) -> np.ndarray:
    return ((name >> np.uint64(8 * NAME_BYTES - 24)) * np.uint64(buckets)) >> np.uint64(24)


def _pieces(data: bytes, piece: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, bytes) of the pieces of a text; each run of ``LENGTH`` bytes starts in one of them."""
    a = np.frombuffer(data, np.uint8)
    for lo in range(0, len(a) - LENGTH + 1, piece):
        yield lo, a[lo:lo + piece + LENGTH - 1]


def _rows(texts: pa.Table, replies: pa.Table) -> list[tuple[int, bytes, bool]]:
    """(id, bytes, whether it is a later copy) of a block, in an order that does not depend on how the rows came."""
    copies = set(_of_kind(replies, "copy"))
    ids, data, sha = (texts.column(c).to_pylist() for c in ("doc_id", "text", "sha"))
    named = ((NO_ID if i is None else i, (t or "").encode(), h) for i, t, h in zip(ids, data, sha, strict=True))
    return sorted((i, t, i.to_bytes(8, "big", signed=True) + h in copies) for i, t, h in named)


def _of_kind(replies: pa.Table, kind: str) -> list[bytes]:
    return [d for k, d in zip(replies.column("kind").to_pylist(), replies.column("data").to_pylist(), strict=True) if k == kind]


REPLY = pa.schema([("block", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])
REPLY_SQL = "block long, kind string, data binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([to_batch({f.name: [r[c] for r in rows] for c, f in enumerate(schema)}, schema)])


def _open_candidates(buckets: int, piece: int):
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("more", pa.binary())])

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        found, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, data, copy in _rows(texts, replies):
            parts = [np.unique(under(a)) for _, a in _pieces(data, piece)] if not copy else []
            if parts:
                u = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
                found.append(u)
                ids.append(np.full(len(u), i, np.int64))
        name, owner = np.concatenate(found), np.concatenate(ids)
        order = np.lexsort((owner, name))
        name, owner = name[order], owner[order]
        begin = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else np.zeros(0, np.int64)
        last = np.append(begin[1:], len(name)) - 1
        more = owner[begin] != owner[last] if len(name) else np.zeros(0, bool)
        name = name[begin]
        at = _bucket(name, buckets)
        edges = np.searchsorted(at, np.arange(buckets + 1))
        block, out = texts.column("block")[0].as_py(), []
        for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            part = slice(edges[k], edges[k + 1])
            out.append((k, block, _packed(name[part][~more[part]]), _packed(name[part][more[part]])))
        return _table(out, schema)

    return run


def _shared_names(common: int):
    def run(table: pa.Table) -> pa.Table:
        """Names of a bucket that two documents have, for each block that has them; apart those of many blocks."""
        one, more = [_unpacked(x) for x in table.column("one").to_pylist()], [_unpacked(x) for x in table.column("more").to_pylist()]
        value, count = np.unique(np.concatenate([*one, *more]), return_counts=True)
        shared = value[(count > 1) | np.isin(value, np.concatenate(more))]
        frequent = value[count > common]
        out = []
        for block, a, b in zip(table.column("block").to_pylist(), one, more, strict=True):
            own = np.sort(np.concatenate((a, b)))
            own = own[np.isin(own, shared, assume_unique=True)]
            often = np.isin(own, frequent, assume_unique=True)
            out += [(block, kind, _packed(x)) for kind, x in (("shared", own[~often]), ("frequent", own[often])) if len(x)]
        return _table(out, REPLY)

    return run


def _open_spans(buckets: int, piece: int):
    """Spans of a block's runs under open names, dealt by name (frequent ones: run by run, by the run)."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("spans", pa.binary()), ("runs", pa.binary()),
                        ("ids", pa.binary()), ("refs", pa.binary()), ("n_refs", pa.binary())])

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        known = [np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unpacked(x) for x in _of_kind(replies, k)]])) for k in ("shared", "frequent")]
        if texts.num_rows == 0 or not (len(known[0]) or len(known[1])):
            return schema.empty_table()
        spans: dict[tuple[int, bytes], list] = {}  # (bucket, bytes) -> [smallest id, references]
        for row, (i, data, copy) in enumerate(_rows(texts, replies)):
            for lo, a in _pieces(data, piece) if not copy else ():
                u = under(a)
                begin = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
                stop, name = np.append(begin[1:], len(u)), u[begin]
                for often, values in zip((False, True), known, strict=True):
                    if not len(values):
                        continue
                    # the names are sorted: a search each, instead of sorting them again for every document
                    hit = values[np.minimum(np.searchsorted(values, name), len(values) - 1)] == name
                    if not hit.any():
                        continue
                    if often:
                        starts = np.concatenate([np.arange(x, y) for x, y in zip(begin[hit], stop[hit], strict=True)])
                        sizes = np.ones(len(starts), np.int64)
                        at = (names(a, LENGTH)[starts] >> np.uint64(16)) % np.uint64(buckets)
                    else:
                        cut = [(x, min(SERIES, y - x), n) for s, y, n in zip(begin[hit].tolist(), stop[hit].tolist(), name[hit], strict=True)
                               for x in range(s, y, SERIES)]
                        starts, sizes = np.array([c[0] for c in cut]), np.array([c[1] for c in cut])
                        at = _bucket(np.array([c[2] for c in cut], np.uint64), buckets)
                    for k, s, n in zip(at.tolist(), (starts + lo).tolist(), sizes.tolist(), strict=True):
                        span = spans.get(key := (k, data[s:s + n + LENGTH - 1]))
                        if span is None:
                            spans[key] = [i, [(row, s, 1)]]
                        else:  # ids ascend: the first has the smallest; the mark tells the rows with that id
                            span[1].append((row, s, int(i == span[0])))
        block, out = texts.column("block")[0].as_py(), {}
        for (k, data), (i, refs) in spans.items():
            out.setdefault(k, []).append((data, i, refs))
        return _table([(k, block, b"".join([x[0] for x in got]), np.array([len(x[0]) - LENGTH + 1 for x in got], np.uint8).tobytes(),
                        np.array([x[1] for x in got], "<i8").tobytes(), np.array([r for x in got for r in x[2]], "<u4").tobytes(),
                        np.array([len(x[2]) for x in got], "<u4").tobytes()) for k, got in sorted(out.items())], schema)

    return run


def _smallest_owner(data: np.ndarray, at: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For every run (at its place in ``data``) the smallest owner of an equal run."""
    name = names(data, LENGTH)[at]
    order = np.lexsort((owner, name))
    begin = np.append(True, name[order][1:] != name[order][:-1])
    group = np.cumsum(begin) - 1
    first = order[begin][group]
    smallest = np.empty(len(name), np.int64)
    smallest[order] = owner[first]
    # equal names: the bytes must be equal too
    windows, clash = np.lib.stride_tricks.sliding_window_view(data, LENGTH), []
    rest = np.flatnonzero(~begin)
    for lo in range(0, len(rest), 1 << 16):
        part = rest[lo:lo + (1 << 16)]
        differ = (windows[at[order[part]]] != windows[at[first[part]]]).any(1)
        clash.append(group[part[differ]])
    for g in np.unique(np.concatenate(clash)) if clash else ():
        least: dict[bytes, int] = {}
        members = order[group == g]
        for m in members.tolist():  # by owner, smallest first
            smallest[m] = least.setdefault(windows[at[m]].tobytes(), int(owner[m]))
    return smallest


def _rank_runs(table: pa.Table) -> pa.Table:
    """For each reference into a block, which of its runs a smaller id has: a bit per run."""
    data = np.frombuffer(b"".join(table.column("spans").to_pylist()), np.uint8)
    runs = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table.column("runs").to_pylist()]
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in table.column("ids").to_pylist()])
    n = np.concatenate(runs)
    start = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
    first = np.cumsum(n) - n
    within = np.arange(int(n.sum())) - np.repeat(first, n)
    owner = np.repeat(ids, n)
    smallest = _smallest_owner(data, np.repeat(start, n) + within, owner)
    mask = np.bincount(np.repeat(np.arange(len(n)), n), (smallest < owner) * (1 << within).astype(np.float64), len(n)).astype(np.uint64)
    out, at = [], 0
    for block, r, refs, n_refs in zip(table.column("block").to_pylist(), runs, table.column("refs").to_pylist(), table.column("n_refs").to_pylist(), strict=True):
        refs = np.frombuffer(refs, "<u4").reshape(-1, 3)
        span = np.repeat(np.arange(len(r)), np.frombuffer(n_refs, "<u4")) + at
        # rows with a larger id than the block's smallest one repeat the whole span
        bits = np.where(refs[:, 2] == 1, mask[span], (np.uint64(1) << n[span].astype(np.uint64)) - np.uint64(1))
        hit = bits > 0
        if hit.any():
            out.append((block, "hits", np.column_stack((refs[hit, 0], refs[hit, 1], bits[hit].astype(np.uint32))).astype("<u4").tobytes()))
        at += len(r)
    return _table(out, REPLY)


def _cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
    """The rows of a block without the covered bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    hits = np.concatenate([np.zeros((0, 3), np.uint32), *[np.frombuffer(x, "<u4").reshape(-1, 3) for x in _of_kind(replies, "hits")]])
    hits = hits[np.argsort(hits[:, 0], kind="stable")]
    rows = _rows(texts, replies) if texts.num_rows else []
    edges = np.searchsorted(hits[:, 0], np.arange(len(rows) + 1))
    out = []
    for row, (i, data, copy) in enumerate(rows):
        mine = hits[edges[row]:edges[row + 1]].astype(np.int64)
        begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if copy and len(data) >= LENGTH:
            begins, ends = np.array([0]), np.array([len(data)])
        elif len(mine):
            bit = (mine[:, 2][:, None] >> np.arange(SERIES)) & 1
            starts = np.unique((mine[:, 1][:, None] + np.arange(SERIES))[bit == 1])
            # runs that overlap or touch are one removed stretch
            new = np.append(True, starts[1:] > starts[:-1] + LENGTH)
            begins, ends = starts[new], starts[np.append(new[1:], True)] + LENGTH
        kept = b"".join([data[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)])
        out.append((None if i == NO_ID else i, len(data), int((ends - begins).sum()), len(begins), kept))
    return _table(out, schema)


def _later_copies(rows: DataFrame) -> DataFrame:
    """block and key of the rows whose whole text a smaller id has; only ids and hashes are read from the shuffle."""
    narrow = rows.select("block", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "sha")
    first = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("sha", "first")
    key = F.concat(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.col("sha"))
    return narrow.join(first, "sha").where("id > first").select("block", F.lit("copy").alias("kind"), key.alias("data"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                 common: int = COMMON, piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes)."""
    checkpoint_dir(docs.sparkSession)
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    buckets = max(8, -(-blocks // BUCKET_BLOCKS))
    texts = (rows.withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
             .select(F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks)).alias("block"), "doc_id", "text", "sha"))
    copies = _later_copies(texts).checkpoint()
    by_block = texts.groupBy("block")
    named = by_block.cogroup(copies.groupBy("block")).applyInArrow(_open_candidates(buckets, piece), "bucket long, block long, one binary, more binary")
    shared = named.groupBy("bucket").applyInArrow(_shared_names(common), REPLY_SQL)
    spans = by_block.cogroup(shared.unionByName(copies).groupBy("block")).applyInArrow(
        _open_spans(buckets, piece), "bucket long, block long, spans binary, runs binary, ids binary, refs binary, n_refs binary")
    hits = spans.groupBy("bucket").applyInArrow(_rank_runs, REPLY_SQL)
    return by_block.cogroup(hits.unionByName(copies).groupBy("block")).applyInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
