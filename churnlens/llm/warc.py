"""Deterministic sharded WARC writer and reader (operator 6).

:func:`write_archives` turns rows (id, URL, payload) into gzip members of WARC 1.1
files.  Records are sorted by id over shards of the id range; a shard's records
are rolled into files of about ``roll_bytes`` compressed bytes.  Headers, record
ids and digests are made anew from the row alone and the date is a parameter, so the
same rows give the same bytes wherever and however often a task runs.

Commit: a task writes each file under a temporary name of its own and renames it
when it is complete; the manifest (file, records, bytes, SHA-256) is one row per
file, and is itself written by Spark when all files are there.  Readers open
what the manifest lists and nothing else, so files of failed or repeated attempts don't count.

Records with equal payloads (of at least ``revisit_from`` bytes) are stored once: the one
with the smallest id is a response, the others are revisits that name its record and have
the HTTP header and the digest of the full payload.  Copies are found on (id, digest)
rows, counted map-side first; payloads cross one shuffle, the one that sorts them.

Null payloads count as empty.  Null ids sort first and are the target of a revisit only in a group
without other ids.  Rows that repeat id and payload: the first is the
response if the id is the smallest, the others revisit it.  Null URLs give records without a target.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.common import to_batch
from churnlens.session import checkpoint_dir

DATE = "2000-01-01T00:00:00Z"
ROLL_BYTES = 16 << 20
#: Rows of one shard, about; larger tables have larger shards, never more than this many.
SHARD_ROWS, MAX_SHARDS = 4096, 16384
#: Ids that the bounds of a shard are chosen from.
SAMPLE = 64
LEVEL = 6
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base 32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{page_id}:{payload_digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    sha = digest(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    head += [("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    if revisit:
        head.append(("WARC-Profile", REVISIT_PROFILE))
        head.append(("WARC-Refers-To", record_id(refers_to, sha)))
        if refers_to is not None:
            head.append(("X-Refers-To-Page-ID", str(refers_to)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1" + CRLF + b"".join([f"{k}: {v}".encode() + CRLF for k, v in head]) + CRLF + block + CRLF + CRLF
    # a gzip member with no time, name or system in its header
    body = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    packed = body.compress(raw) + body.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + packed + zlib.crc32(raw).to_bytes(4, "little") + (len(raw) & 0xFFFFFFFF).to_bytes(4, "little")


def _shards(pages: DataFrame, shards: int) -> list[int]:
    """Ids that part the id range into ``shards`` of about equal size: quantiles of at most ``SAMPLE`` ids a shard, chosen by their hash."""
    every = max(1, pages.count() // (SAMPLE * shards))
    ids = sorted(r[0] for r in pages.where("page_id IS NOT NULL").where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
                 .select("page_id").distinct().orderBy(F.xxhash64("page_id")).limit(SAMPLE * shards).collect())
    return sorted({ids[len(ids) * k // shards] for k in range(1, shards)}) if len(ids) >= shards else ids[1:]


def _shard_of(page_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not larger than the id, by binary search in one constant array; 0 for null."""
    if not bounds:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    fits = lambda at, step: (at + step <= len(bounds)) & (F.get(table, at + step - 1) <= page_id)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def _filesystem(uri: str):
    """A file system that tasks can write through, and the folder's path in it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   revisit_from: int = 0, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write the archives and their manifest below ``folder`` (a URI all executors can write); returns the manifest."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.encode(F.col(payload_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    if shards is None:
        shards = max(1, min(MAX_SHARDS, -(-rows.count() // SHARD_ROWS)))
    bounds = _shards(rows.select("page_id"), shards)
    narrow = rows.where(F.octet_length("payload") >= revisit_from).select("page_id", F.sha1("payload").alias("sha"))
    groups = (narrow.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
              .select(F.col("sha").alias("group_sha"), "first_id"))
    # which (id, digest) rows repeat a payload; they meet their rows in the shuffle that sorts the payloads
    marks = (narrow.join(groups, F.col("sha") == F.col("group_sha")).select("page_id", "sha", "first_id").distinct()
             .select("page_id", F.lit(None).cast("string").alias("url"), F.unhex("sha").alias("payload"),
                     F.lit(0).alias("kind"), "first_id"))
    both = rows.withColumns({"kind": F.lit(1), "first_id": F.lit(None).cast("long")}).unionByName(marks)
    # each shard is a task's partition of its own
    ordered = (both.withColumn("shard", _shard_of(F.col("page_id"), bounds).cast("int")).repartitionById(len(bounds) + 1, "shard")
               .sortWithinPartitions("shard", "page_id", "kind", "payload", "url"))
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _write(batches, folder, roll_bytes, schema)

    manifest = ordered.select("page_id", "url", "payload", "kind", "first_id", "shard").mapInArrow(
        run, "file string, records long, bytes long, sha256 string")
    manifest.write.mode("errorifexists").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.parquet(f"{folder}/_manifest")


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    shard, part, out, sha, written, records, temporary = None, 0, None, None, 0, 0, ""
    marks: dict[bytes, int | None] = {}
    seen: set[bytes] = set()
    page: object = ()

    def close() -> pa.RecordBatch:
        nonlocal out, part
        out.close()
        name = f"{shard:06d}-{part:05d}.warc.gz"
        files.move(temporary, f"{root}/{name}")
        part, out = part + 1, None
        return to_batch({"file": [name], "records": [records], "bytes": [written], "sha256": [sha.hexdigest()]}, schema)

    for b in batches:
        for row in b.to_pylist():
            if row["shard"] != shard:
                if out is not None:
                    yield close()
                shard, part = row["shard"], 0
            if row["page_id"] != page:
                page = row["page_id"]
                marks, seen = {}, set()
            if row["kind"] == 0:
                marks[row["payload"]] = row["first_id"]
                continue
            payload = row["payload"]
            key = hashlib.sha1(payload).digest()
            # a copy, unless it is the first row of the id that stands for its group
            revisit = key in marks and (marks[key] != page or key in seen)
            seen.add(key)
            member = record(page, row["url"], payload, marks.get(key) if revisit else None, revisit)
            if out is not None and written + len(member) > roll_bytes:
                yield close()
            if out is None:
                temporary = f"{root}/_temporary-{shard:06d}-{part:05d}-{uuid.uuid4().hex}"
                out, sha, written, records = files.open_output_stream(temporary), hashlib.sha256(), 0, 0
            out.write(member)
            sha.update(member)
            written += len(member)
            records += 1
    if out is not None:
        yield close()


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives that the manifest lists: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Checks the block digest of every record.  ``payload`` is null for revisits.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.large_binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[dict] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as raw:
                    for member in _members(raw):
                        rows.append(_parse(member))
                        if len(rows) == 256:
                            yield to_batch({f.name: [r[f.name] for r in rows] for f in schema}, schema)
                            rows = []
                if rows:
                    yield to_batch({f.name: [r[f.name] for r in rows] for f in schema}, schema)

    manifest = spark.read.parquet(f"{folder}/_manifest").select("file")
    return manifest.repartition(max(1, min(manifest.count(), 2 * spark.sparkContext.defaultParallelism)), "file").mapInArrow(
        run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _members(raw, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    rest = b""
    while True:
        rest = rest or raw.read(chunk)
        if not rest:
            return
        d = zlib.decompressobj(31)
        out = io.BytesIO()
        while not d.eof:
            if not rest:
                rest = raw.read(chunk)
                if not rest:
                    raise ValueError("an archive ends inside a record")
            out.write(d.decompress(rest))
            rest = d.unused_data
        yield out.getvalue()


def _parse(member: bytes) -> dict:
    head, _, rest = member.partition(CRLF + CRLF)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} differs")
    http, _, payload = block.partition(CRLF + CRLF)
    length = next(int(line.split(b":")[1]) for line in http.split(CRLF) if line.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
            "payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            "refers_to": number("X-Refers-To-Page-ID"), "payload": None if revisit else payload}


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
