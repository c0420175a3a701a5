"""Snapshot sources: source trees on storage and release archives.

Layout read by ``scan_tree``: ``<root>/<repo>/<version>/<path...>``.  The
driver lists the repositories only; tasks list their trees, and, spread by
path, read the files.  Names may start with ``.`` or ``_`` (Spark's own file
listing hides those).  Hashes, sizes and the comparison are on bytes; text
is decoded for rendering only, without loss (:func:`decode`).
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.paths import snapshot_path_kept

TREE_SCHEMA = "repo string, version string, path string, content string, content_hash string, size long, modified_at timestamp"


def decode(data: bytes) -> str:
    """UTF-8, or one character per byte for files that are not UTF-8 (so that no difference is lost)."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _filesystem(root: str):
    """A file system that tasks can open, and the root's path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(root if ":" in root.split("/", 1)[0] else f"file://{root}")


def scan_tree(spark: SparkSession, root: str, mode: str = "product", path_glob: str | None = None) -> DataFrame:
    """S01 (product: excluded and hidden paths dropped) / S02 (folder: everything listed).

    Returns repo, version, path, content, content_hash, size, modified_at.
    ``path_glob`` matches file names.
    """
    from pyarrow import fs

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fnmatch
        files, base = _filesystem(root)
        for b in batches:
            for repo in b.column(0).to_pylist():
                rows = [(i.path[len(base.rstrip("/")) + 1:], i.size, i.mtime) for i in files.get_file_info(fs.FileSelector(f"{base}/{repo}", recursive=True))
                        if i.type == fs.FileType.File and (path_glob is None or fnmatch.fnmatchcase(i.base_name, path_glob))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.timestamp("us", "UTC")))],
                                                 names=["file", "size", "modified_at"])

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _filesystem(root)
        names = ["repo", "version", "path", "content", "content_hash", "size", "modified_at"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.timestamp("us", "UTC")]
        for b in batches:
            for r in b.to_pylist():  # a file is a batch: large files don't add up
                with files.open_input_stream(f"{base}/{r['file']}", compression=None) as f:
                    data = f.read()
                row = [*r["file"].split("/", 2), decode(data), hashlib.sha256(data).hexdigest(), len(data), r["modified_at"]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

    files, base = _filesystem(root)
    repos = [(i.base_name,) for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
    listed = (spark.createDataFrame(repos, "repo string").repartition(max(1, min(len(repos), spark.sparkContext.defaultParallelism)))
              .mapInArrow(listing, "file string, size long, modified_at timestamp")
              .where(F.size(F.split("file", "/", 3)) == 3))
    if mode == "product":
        listed = listed.where(snapshot_path_kept(F.get(F.split("file", "/", 3), 2)))
    return listed.repartition("file").mapInArrow(reading, TREE_SCHEMA)


def _zip_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One frame per contained file; an unreadable archive gives a row with its error and no path."""
    columns = ["repo", "version", "path", "content", "content_hash", "size", "error"]
    for pdf in batches:
        for repo, version, blob in zip(pdf["repo"], pdf["version"], pdf["content"]):
            try:
                zf = zipfile.ZipFile(io.BytesIO(bytes(blob)))
            except zipfile.BadZipFile as e:
                yield pd.DataFrame([(repo, version, None, None, None, None, str(e))], columns=columns)
                continue
            for name in zf.namelist():
                # the archive's first top-level directory becomes the root
                rel = name.split("/", 1)[-1]
                if name.endswith("/") or not rel:
                    continue
                data = zf.read(name)
                yield pd.DataFrame([(repo, version, rel, decode(data), hashlib.sha256(data).hexdigest(), len(data), None)], columns=columns)


def expand_archives(archives: DataFrame) -> DataFrame:
    """Release archives (repo, version, content: binary zip) -> one row per contained file.

    An archive that can't be read is one row with ``error`` set and no path.
    """
    return archives.select("repo", "version", "content").mapInPandas(
        _zip_rows, "repo string, version string, path string, content string, content_hash string, size long, error string")


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    """S04 scan: ``<root>/<repo>/<version>.zip`` -> (repo, version, content)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(root)
    return df.select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.zip$", 1).alias("repo"),
                     F.regexp_extract("path", r"([^/]+)/([^/]+)\.zip$", 2).alias("version"), "content",
                     F.col("path").alias("archive_path"))
