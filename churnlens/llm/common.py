"""Helpers shared by the corpus operators.

Python code that runs in tasks keeps what is dear to build (tokenizers, word
tables) in :func:`worker_cache`, which lives as long as the Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: U+0020 and U+0009 to U+000D, nothing else.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(name: str) -> dict:
    """A dict that outlives the task: one per name and Python worker."""
    import sys
    import types
    home = sys.modules.setdefault("_churnlens_worker", types.ModuleType("_churnlens_worker"))
    return home.__dict__.setdefault(name, {})


def str_list(batch: pa.RecordBatch, column: int = 1) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def to_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that other columns can have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def held_out(id_col: str | Column = "doc_id", folds: int = 5) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo ``folds``, is 0."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % folds == 0


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that work on one slice stays small."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next of U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def in_bytes(s: str, alphabet: list[str]) -> str:
    """A text as the characters of its UTF-8 bytes."""
    return "".join([alphabet[b] for b in s.encode()])


def latin_class(kind: str) -> str:
    """Body of a character class: the characters up to U+024F whose Unicode category begins with ``kind``."""
    import unicodedata
    return "".join([c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind])
