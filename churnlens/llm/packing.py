"""Order-preserving packing of documents into fixed windows (operator 3).

Documents follow one another in the order of the input; each becomes its
token ids and one closing id.  Windows of at most ``window`` ids are cut from
that stream.  A cut costs nothing after a document, a little after a sentence
and more elsewhere; a window costs its padding.  A window whose length is a
power of two is not padded.  The cheapest cuts come from a dynamic programme
over the allowed places::

    best[j] = cut(j) + min( best[i] + window - (pos[j] - pos[i])   for pos[j] - pos[i] <= window,
                            best[i]                                for pos[j] - pos[i] a power of two )

The first line is a minimum of ``best[i] + pos[i]`` over a sliding range, kept in a
monotone queue, so a place costs constant time.  Places are the ends of
documents and sentences; sentences longer than ``LONG`` ids also allow word ends,
and words longer than that every ``LONG`` ids, so that a window can always end.
Of places inside one document that lie within ``STEP`` ids of one another one is kept.

Each task packs the rows of its own input partition, in blocks of about
``BLOCK`` ids; the last window of a block is opened again by the next one, so a
partition wastes at most one window.  Text never crosses a shuffle.

Null and empty texts give one piece with the closing id only.  Repeated and null
ids are packed row by row like any other.  Other columns are not read.
"""

from __future__ import annotations

import contextlib
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm.common import byte_alphabet, id_text, in_bytes, latin_class, rows_of, str_list, to_batch, worker_cache

#: Cost of a cut, in ids of padding.
AFTER_DOCUMENT, AFTER_SENTENCE, INSIDE = 0, 8, 64
LONG = 128
STEP = 16
BLOCK = 1 << 19
CACHED_WORDS = 800_000
WORD, SENTENCE, DOCUMENT = 0, 1, 2
#: Fixed value: the word pattern of the vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _encoder(tokenizer_path: str, closing_id: int) -> Callable[[list[str]], tuple[np.ndarray, ...]]:
    """texts -> (all ids, ids of each text, places to cut, cost of each), places counted in ids from the first text's start."""
    import re

    from tokenizers import Tokenizer

    cache = worker_cache("packing:" + tokenizer_path)
    if "encode" in cache:
        return cache["encode"]
    tok = Tokenizer.from_file(tokenizer_path)
    tokenize, alphabet = tok.model.tokenize, byte_alphabet()
    # Latin letters, digits and signs only: normalised by lower case alone, and without special strings
    odd = re.compile("[^\\n -~\xa1-\u024f]|<\\|").search
    pattern = re.compile(WORD_PATTERN.format(letter=latin_class("L"), digit=latin_class("N"))).findall
    # a full stop or comma that other signs stand before belongs to one word with them
    signs = re.compile(r"[^\w\s][.,]|_[.,]").search
    codes: dict[str, int] = {}
    flat = array("I")  # ids of all words, one after another
    size, kind = array("q"), array("b")  # per word: ids, and what ends with it

    def learn(w: str, ids: list[int]) -> int:
        flat.extend(ids)
        size.append(len(ids))
        kind.append(SENTENCE if w == "\n" or w[-1:] in (".", "!", "?") else WORD)
        codes[w] = code = len(size) - 1
        return code

    def forget() -> None:
        codes.clear()
        del flat[:], size[:], kind[:]
        learn("", [closing_id])
        kind[0] = DOCUMENT  # code 0: the mark after each document, no word
        del codes[""]
        learn("\n", [])

    def words(text: str) -> list[int]:
        # this vocabulary drops white space, so a text's ids are those of its words; "\n" stays as a word without ids
        if odd(text):
            # an upper-case mark keeps words of other texts, in the case they have, apart
            parts = [w if w == "\n" else "\0Z" + w for w in text.replace("\n", " \n ").split(" ")]
            return [codes[w] if w in codes else learn(w, tok.encode(w[2:], add_special_tokens=False).ids) for w in parts]
        low = text.lower().replace("\n", " \n ")
        if not signs(low):
            low = low.replace(". ", " . ").replace(", ", " , ")
        parts = low.split(" ")
        got = list(map(codes.get, parts))
        if None in got:
            i = -1
            with contextlib.suppress(ValueError):
                while True:
                    i = got.index(None, i + 1)
                    w = parts[i]
                    got[i] = codes[w] if w in codes else learn(w, [t.id for x in pattern(w) for t in tokenize(in_bytes(x, alphabet))])
        return got

    def encode(texts: list[str]) -> tuple[np.ndarray, ...]:
        if not size or len(codes) > CACHED_WORDS:
            forget()
        all_codes: list[int] = []
        for t in texts:
            all_codes += words(t)
            all_codes.append(0)
        code = np.array(all_codes, np.int64)
        sizes = np.frombuffer(size, np.int64).copy()
        n = sizes[code]
        first = np.cumsum(sizes) - sizes
        ends = np.cumsum(n)
        flat_ids = np.frombuffer(flat, np.uint32).copy()
        kinds = np.frombuffer(kind, np.int8).copy()[code]
        ids = flat_ids[np.repeat(first[code] - (ends - n), n) + np.arange(int(ends[-1]))]
        tokens = np.diff(ends[kinds == DOCUMENT], prepend=0)
        return ids.astype("<u4"), tokens, *_places(ends, kinds)

    cache["encode"] = encode
    return encode


def _ascending(*parts: np.ndarray) -> np.ndarray:
    """The distinct values of sorted or unsorted arrays."""
    a = np.sort(np.concatenate(parts))
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def _places(ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places to cut and their costs: ends of documents and sentences, and more of them inside long sentences."""
    docs = ends[kinds == DOCUMENT]
    stops = ends[(kinds == SENTENCE) & (ends > 0)]
    # of sentence ends that stand close together (one-word sentences) the last of each STEP ids is enough
    stops = stops[np.append(stops[1:] // STEP != stops[:-1] // STEP, True)] if len(stops) else stops
    place = _ascending(stops, docs)
    gaps = np.diff(place, prepend=0)
    marked = place
    if (gaps > LONG).any():
        at = np.searchsorted(place, ends)
        every = _ascending(place, ends[(ends > 0) & (gaps[at] > LONG)])
        wide = np.flatnonzero(np.diff(every, prepend=0) > LONG)
        starts = np.append(0, every)
        every = _ascending(every, *[np.arange(starts[i] + LONG, every[i], LONG) for i in wide])
        keep = np.isin(every, place) | np.append(every[1:] // STEP != every[:-1] // STEP, True)
        place = every[keep]
    cost = np.full(len(place), INSIDE, np.int64)
    cost[np.searchsorted(place, marked)] = AFTER_SENTENCE
    cost[np.searchsorted(place, docs)] = AFTER_DOCUMENT
    return place, cost


def choose_cuts(pos: list[int], cost: list[int], window: int, least: int = 256) -> list[int]:
    """Indices into ``pos`` where windows end, cheapest in all; ``pos`` ascends, starts after 0 and ends with the stream.

    ``least``: the shortest power of two that counts as a full window.
    """
    powers = [1 << k for k in range(window.bit_length()) if least <= 1 << k < window]
    place, best, come, at = [0], [0], [-1], {0: 0}
    # the monotone queue: indices from `head` on, their best + pos ascending
    queue, keys, head = [0], [0], 0
    for p, c in zip(pos, cost, strict=True):
        while place[queue[head]] < p - window:
            head += 1
        i = queue[head]
        value = keys[head] + window - p
        for power in powers:
            if (k := at.get(p - power)) is not None and best[k] < value:
                value, i = best[k], k
        value += c
        j = len(place)
        place.append(p)
        best.append(value)
        come.append(i)
        at[p] = j
        key = value + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    cuts, j = [], len(pos)
    while j > 0:
        cuts.append(j - 1)
        j = come[j]
    return cuts[::-1]


def _pack(batches: Iterator[pa.RecordBatch], encode: Callable, window: int, first_id: int) -> Iterator[pa.RecordBatch]:
    docs: deque[list] = deque()  # [doc_id, ids, start in stream, tokens]; those that an open window may still need
    pos: list[int] = []
    cost: list[int] = []
    base, end, seq = 0, 0, first_id

    def flush(last: bool) -> pa.RecordBatch | None:
        """Write the windows of the block; keep the last one open unless the stream has ended."""
        nonlocal base, pos, cost, seq
        cuts = choose_cuts([p - base for p in pos], cost, window)
        done = cuts if last else cuts[:-1]
        rows: dict[str, list] = {f.name: [] for f in SCHEMA}
        for c in done:
            stop, offset = pos[c], 0
            while base < stop:
                doc_id, ids, at, n = docs[0]
                start, upto = base - at, min(stop - at, n)
                for name, v in zip(rows, (doc_id, start, upto - start, zlib.crc32(ids[4 * start:4 * upto]), n, seq, offset), strict=True):
                    rows[name].append(v)
                offset += upto - start
                base = at + upto
                if upto == n:
                    docs.popleft()
            seq += 1
        if done:
            pos, cost = pos[done[-1] + 1:], cost[done[-1] + 1:]
        return to_batch(rows, SCHEMA) if rows["start"] else None

    for b in rows_of(batches, 128):
        ids, tokens, places, costs = encode(str_list(b))
        buffer, at = memoryview(ids.tobytes()), 0
        for doc_id, n in zip(b.column(0).to_pylist(), tokens.tolist(), strict=True):
            docs.append([doc_id, buffer[4 * at:4 * (at + n)], end + at, n])
            at += n
        pos += (places + end).tolist()
        cost += costs.tolist()
        end += at
        if end - base >= BLOCK and (out := flush(False)) is not None:
            yield out
    if pos and (out := flush(True)) is not None:
        yield out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, closing_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: where it starts, its ids' checksum, and its place in a sequence.

    ``sequence_id`` is the input partition's number in the high 32 bits and a
    counter in the low ones, so tasks need not agree on anything and a task that
    is run again gives the same ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        yield from _pack(batches, _encoder(tokenizer_path, closing_id), window, TaskContext.get().partitionId() << 32)

    return id_text(docs, id_col, text_col).mapInArrow(run, DDL)
