"""Snapshot alignment and diffs.

Inputs
  files: repo, version, path, content (string)          -- one row per file of a snapshot
  pairs: pair_id, repo, old_version, new_version

Plan shape (one job for all pairs of all repositories):
  1. scan projection: path, sha-256 of the content, size, line count —
     content is dropped here, so the alignment shuffles only hashes;
  2. J14: each pair is two signed sides, old and new, stacked; one join gives
     every file its sides, under a key that deals a large release over tasks;
  3. J01-J03: one aggregate per (pair, path) puts the sides beside each other, labels
     modified / deleted / added and drops identical files (P06);
  4. content is fetched for the surviving keys only: the change list is written
     once, its sides meet the files, and one aggregate puts both texts of a path into its row;
  5. F10 renders added/deleted files in Catalyst; F11 renders modified
     files in an Arrow-batched pandas function (the only Python step).
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.paths import extension_allowed, parse_extensions, snapshot_path_kept, valid_filename
from churnlens.functions.text import file_lines, line_count
from churnlens.session import cut_lineage

CHANGE_ORDER = {"modified": 0, "deleted": 1, "added": 2}
#: Keys that one release is dealt over when its files meet the pairs.
PATH_SLICES = 32
PAIR = ["pair_id", "repo", "old_version", "new_version"]


def scan_files(files: DataFrame, mode: str = "product") -> DataFrame:
    """S01/S02 + S03 counts: the light projection used for alignment.

    ``files`` is a tree scan or the manifest of a store, which has the three columns already.
    """
    f = files
    if mode == "product":
        f = f.where(snapshot_path_kept("path"))
    # sources that saw the bytes give their hash; two encodings of one text are two contents
    of_text = F.sha2(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 256)
    if "content" not in files.columns:
        return f.select("repo", "version", "path", "content_hash", "size", "n_lines")
    return f.select("repo", "version", "path",
                    (F.coalesce("content_hash", of_text) if "content_hash" in files.columns else of_text).alias("content_hash"),
                    (F.col("size") if "size" in files.columns else F.octet_length("content")).cast("long").alias("size"),
                    line_count("content").alias("n_lines"))


def pair_sides(pairs: DataFrame) -> DataFrame:
    """Every pair as two rows, its old and its new snapshot (columns version and side)."""
    side = lambda name: F.struct(F.col(f"{name}_version").alias("version"), F.lit(name).alias("side"))
    return pairs.select(*PAIR, F.explode(F.array(side("old"), side("new"))).alias("s")).select(*PAIR, "s.version", "s.side")


def complete_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """The pairs of which both snapshots exist; a pair with a missing one fails as a whole (A22), it is not "all deleted"."""
    have = files.select("repo", "version").distinct()
    sides = pair_sides(pairs).distinct().join(have, ["repo", "version"], "left_semi")
    return sides.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def align(files: DataFrame, pairs: DataFrame, extensions: str | None = None, mode: str = "product") -> DataFrame:
    """pair_id, repo, old_version, new_version, path, change_type, and hash and lines of both sides.

    mode 'product': hidden/excluded paths dropped at the scan, invalid file
    names dropped, a modified file needs lines on both sides.
    mode 'folder': raw scan, modified needs lines on at least one side.
    Added/deleted files need at least one line in both modes.  Rows of one
    (repo, version, path) count as one file, that with the largest hash.
    """
    scan = scan_files(files, mode).where(extension_allowed("path", parse_extensions(F.lit(extensions or ""))))
    if mode == "product":
        scan = scan.where(valid_filename("path"))
    slices = F.sequence(F.lit(0), F.lit(PATH_SLICES - 1))
    sides = pair_sides(complete_pairs(pairs, files)).withColumn("slice", F.explode(slices))
    seen = (scan.withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(PATH_SLICES)).cast("int"))
            .join(sides, ["repo", "version", "slice"]))
    state = F.struct(F.col("content_hash").alias("hash"), F.col("n_lines").alias("lines"))
    both = seen.groupBy(*PAIR, "path").agg(F.max(F.when(F.col("side") == "old", state)).alias("old"),
                                           F.max(F.when(F.col("side") == "new", state)).alias("new"))
    change = (F.when(F.col("old").isNull(), F.lit("added"))
              .when(F.col("new").isNull(), F.lit("deleted"))
              .when(F.col("old.hash") != F.col("new.hash"), F.lit("modified")))
    out = both.withColumn("change_type", change).where(F.col("change_type").isNotNull())
    ol, nl = F.coalesce("old.lines", F.lit(0)), F.coalesce("new.lines", F.lit(0))
    if mode == "product":
        keep = F.when(F.col("change_type") == "modified", (ol > 0) & (nl > 0))
    else:
        keep = F.when(F.col("change_type") == "modified", (ol > 0) | (nl > 0))
    keep = keep.when(F.col("change_type") == "deleted", ol > 0).otherwise(nl > 0)
    return out.where(keep).select(*PAIR, "path", "change_type", F.col("old.lines").alias("old_lines"), F.col("new.lines").alias("new_lines"),
                                  F.col("old.hash").alias("old_hash"), F.col("new.hash").alias("new_hash"))


def path_sets(old_paths: DataFrame, new_paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(common, deleted, added) path sets of two snapshots as set operations.

    ``align`` computes the same three sets in one aggregate (and also
    tells modified from unchanged); this form is for callers holding two
    plain path lists.
    """
    o, n = old_paths.select("path").distinct(), new_paths.select("path").distinct()
    return o.intersect(n), o.subtract(n), n.subtract(o)


def with_contents(changes: DataFrame, files: DataFrame) -> DataFrame:
    """The changes with old_content and new_content, fetched for changed paths only.

    The change list (no texts) is written once, so that the alignment runs once.
    ``files`` is a tree scan (repo, version, path, content), met by path, or the contents of a
    store (content_hash, content), met by hash.  Where the list is small Spark sends it to the
    files; otherwise both are dealt by a key that spreads a release over its files.
    """
    by_hash = "path" not in files.columns
    listed = cut_lineage(changes)
    carry = [c for c in listed.columns if c not in ("pair_id", "path")]
    side = lambda name: F.struct(F.col(f"{name}_version").alias("version"), F.col(f"{name}_hash").alias("content_hash"), F.lit(name).alias("side"))
    sides = listed.select("*", F.explode(F.array(side("old"), side("new"))).alias("s")).select(*listed.columns, "s.*").where("content_hash is not null")
    if by_hash:
        found = sides.join(files.select("content_hash", "content"), "content_hash")
    else:
        found = sides.drop("content_hash").join(files.select("repo", "version", "path", "content"), ["repo", "version", "path"])
    return found.groupBy("pair_id", "path").agg(
        *[F.first(c).alias(c) for c in carry],
        F.max(F.when(F.col("side") == "old", F.col("content"))).alias("old_content"),
        F.max(F.when(F.col("side") == "new", F.col("content"))).alias("new_content")).select(*listed.columns, "old_content", "new_content")


def whole_file_diff(change_type: Column, lines: Column, label: Column) -> Column:
    """diff of an added or deleted file: headers, hunk line, every line prefixed."""
    n = F.size(lines)
    deleted = F.concat(F.array(F.concat(F.lit("--- "), label), F.lit("+++ /dev/null"),
                               F.format_string("@@ -1,%d +0,0 @@", n)),
                       F.transform(lines, lambda l: F.concat(F.lit("-"), l)))
    added = F.concat(F.array(F.lit("--- /dev/null"), F.concat(F.lit("+++ "), label),
                             F.format_string("@@ -0,0 +1,%d @@", n)),
                     F.transform(lines, lambda l: F.concat(F.lit("+"), l)))
    return F.when(change_type == "deleted", deleted).otherwise(added)


def _split_keep(text: str) -> list[str]:
    if not text:
        return []
    parts = text.split("\n")
    out = [p + "\n" for p in parts[:-1]]
    if parts[-1] != "":
        out.append(parts[-1])
    return out


def unified_diff_lines(old: str, new: str, old_label: str, new_label: str, context: int = 3) -> list[str]:
    """F11 for one file pair: unified diff lines (no trailing newline), [] when equal.

    Lines are compared with their line ends, so a change of the final
    newline is a change (Q11) and is marked with '\\ No newline at end of file'.
    Hunks come from difflib and may be placed differently than GNU diff's.
    """
    a, b = _split_keep(old or ""), _split_keep(new or "")
    if a == b:
        return []
    out = [f"--- {old_label}", f"+++ {new_label}"]

    def put(mark: str, lines: list[str]) -> None:
        for line in lines:
            out.append(mark + line.removesuffix("\n"))
            if not line.endswith("\n"):
                out.append("\\ No newline at end of file")

    def span(start: int, stop: int) -> str:
        n = stop - start
        return f"{start + 1}" if n == 1 else f"{start + (n > 0)},{n}"

    # without difflib's popular-line rule, which drops frequent lines of files from 200 lines on
    for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(context):
        out.append(f"@@ -{span(group[0][1], group[-1][2])} +{span(group[0][3], group[-1][4])} @@")
        for tag, i1, i2, j1, j2 in group:
            if tag == "equal":
                put(" ", a[i1:i2])
            else:
                put("-", a[i1:i2])
                put("+", b[j1:j2])
    return out


DIFF_SLICE = 200


def _unified_diff_batch(old: pa.Array, new: pa.Array, old_label: pa.Array, new_label: pa.Array) -> pa.Array:
    # a slice at a time: a text or line is far larger as a Python object than in Arrow
    lines, diffs = pa.list_(pa.string()), []
    for at in range(0, len(old), DIFF_SLICE):
        rows = zip(*(c.slice(at, DIFF_SLICE).to_pylist() for c in (old, new, old_label, new_label)))
        diffs.append(pa.array([unified_diff_lines(*r) for r in rows], lines))
    return pa.concat_arrays(diffs) if diffs else pa.array([], lines)


# Marked non-deterministic only so that Catalyst never copies the call into a
# later filter or projection (which would run difflib twice per file).
unified_diff_udf = F.arrow_udf(_unified_diff_batch, T.ArrayType(T.StringType())).asNondeterministic()


def render_diffs(changes: DataFrame, files: DataFrame, context_lines: int | None = None) -> DataFrame:
    """F10/F11 + P21: add ``diff`` (array<string>) and ``context`` (its first ``context_lines``; None: all of it)."""
    c = with_contents(changes, files)
    old_label = F.concat_ws("/", F.col("old_version"), F.col("path"))
    new_label = F.concat_ws("/", F.col("new_version"), F.col("path"))
    is_modified = F.col("change_type") == "modified"
    # Q10: binary files (a NUL byte on either side) are not diffed; they are dropped.
    binary = F.contains(F.coalesce("old_content", F.lit("")), F.lit("\u0000")) | \
        F.contains(F.coalesce("new_content", F.lit("")), F.lit("\u0000"))
    whole = F.when(F.col("change_type") == "deleted",
                   whole_file_diff(F.col("change_type"), file_lines("old_content"), old_label)) \
        .otherwise(whole_file_diff(F.col("change_type"), file_lines("new_content"), new_label))
    # one pass over all changes; the Python function gets nulls for added and deleted files and returns at once
    lines = unified_diff_udf(F.when(is_modified, F.col("old_content")), F.when(is_modified, F.col("new_content")), old_label, new_label)
    out = (c.where(~(is_modified & binary)).withColumn("_lines", lines)
           .withColumn("diff", F.when(is_modified, F.col("_lines")).otherwise(whole)).drop("_lines")
           .where(F.size("diff") > 0))
    return out.withColumn("context", F.col("diff") if context_lines is None else F.slice("diff", 1, context_lines))


def keyword_list(keywords: str | None) -> list[str]:
    """P04/P05 keywords: split on ',' and trimmed; '' stays (it matches every line)."""
    if keywords is None or keywords == "":
        return []
    return [k.strip() for k in keywords.split(",")]


def any_line_has_keyword(lines: Column, keywords: list[str]) -> Column:
    """True when no keywords, else when some line contains some keyword (case-sensitive)."""
    if not keywords:
        return F.lit(True)
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.exists(lines, lambda l: F.exists(kws, lambda k: F.contains(l, k)))


def keyword_scope(diffs: DataFrame, keywords: str | None) -> DataFrame:
    """P04 (modified: over diff lines) / P05 (added, deleted: over the file's raw lines)."""
    kws = keyword_list(keywords)
    raw = F.when(F.col("change_type") == "deleted", file_lines("old_content")).otherwise(file_lines("new_content"))
    hit = F.when(F.col("change_type") == "modified", any_line_has_keyword(F.col("diff"), kws)) \
        .otherwise(any_line_has_keyword(raw, kws))
    return diffs.where(hit)


def line_churn(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Lines added / removed per changed file as a multiset difference (moves ignored).

    Every old line counts -1 and every new line +1 under (pair, path, line);
    the partial aggregation collapses repeated lines (blank lines, braces)
    before the shuffle, so a huge file or a hot line does not skew a task.
    """
    c = with_contents(changes, files)
    signed = F.concat(F.transform(file_lines("old_content"), lambda l: F.struct(l.alias("line"), F.lit(-1).alias("d"))),
                      F.transform(file_lines("new_content"), lambda l: F.struct(l.alias("line"), F.lit(1).alias("d"))))
    per_line = (c.select("pair_id", "path", F.explode(signed).alias("s"))
                .groupBy("pair_id", "path", "s.line").agg(F.sum("s.d").alias("d")))
    return (per_line.groupBy("pair_id", "path")
            .agg(F.sum(F.when(F.col("d") > 0, F.col("d")).otherwise(0)).cast("bigint").alias("lines_added"),
                 F.sum(F.when(F.col("d") < 0, -F.col("d")).otherwise(0)).cast("bigint").alias("lines_removed")))


def diff_by_type(changes: DataFrame) -> DataFrame:
    """Number of diffs per (pair, change_type)."""
    return changes.groupBy("pair_id", "change_type").agg(F.count(F.lit(1)).alias("diff_count"))


def bulk_summary(pairs: DataFrame, files: DataFrame, changes: DataFrame) -> DataFrame:
    """Per pair index, versions, status ('completed' / 'error'), file count."""
    counts = changes.groupBy("pair_id").agg(F.count(F.lit(1)).alias("file_count"))
    ok = complete_pairs(pairs, files).select("pair_id", F.lit(True).alias("_ok"))
    return (pairs.join(ok, "pair_id", "left").join(counts, "pair_id", "left")
            .select("pair_id", "repo", "old_version", "new_version",
                    F.when(F.col("_ok"), "completed").otherwise("error").alias("status"),
                    F.when(F.col("_ok"), F.coalesce("file_count", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("file_count"),
                    F.when(F.col("_ok"), F.lit(None).cast("string")).otherwise(F.lit("snapshot not available")).alias("error")))


def pair_label(new_version, old_version, path) -> Column:
    """F32 / U03: '[new→old] file' key of a merged bulk result."""
    return F.format_string("[%s→%s] %s", new_version, old_version, path)


def diff_artifact(changes: DataFrame, k: int = 5) -> DataFrame:
    """Per pair, diff count, and the first k 'path (type)' highlights.

    Highlights follow (change type order, path).  The window is limited to k rows, which
    Spark also does before the shuffle: a task sends at most k rows of a pair.
    """
    order_map = F.create_map(*[F.lit(x) for kv in CHANGE_ORDER.items() for x in kv])
    listed = changes.select(*PAIR, "path", "change_type", F.element_at(order_map, F.col("change_type")).alias("_o"))
    top = (listed.withColumn("_n", F.row_number().over(Window.partitionBy("pair_id").orderBy("_o", "path"))).where(F.col("_n") <= k)
           .groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("_n", F.format_string("%s (%s)", "path", "change_type").alias("h")))).alias("_hs")))
    counts = changes.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("diff_count"))
    return (counts.join(top, "pair_id", "left")
            .select("pair_id", "repo", F.col("old_version").alias("version_1"), F.col("new_version").alias("version_2"),
                    "diff_count", F.transform("_hs", lambda s: s["h"]).alias("highlights")))


def write_artifacts(diffs: DataFrame, folder: str, generated_at, k: int = 5) -> None:
    """S17 sink: a header per pair (counts, highlights, ``generated_at``) and its files with their diffs, as JSON.

    A pair's files are rows in a folder of the pair, not one value: a pair with very many changes is
    written by many tasks.  Diffs are rendered once: headers are made from the written files.
    """
    spark = diffs.sparkSession
    rows = diffs.select(*PAIR, "path", "change_type", "diff")
    rows.hint("rebalance", "pair_id").write.partitionBy("pair_id").json(f"{folder}/files")
    listed = read_artifact_files(spark, folder).select(*PAIR, "path", "change_type")
    (diff_artifact(listed, k).withColumn("generated_at", F.lit(generated_at).cast("timestamp"))
     .write.json(f"{folder}/headers"))


def read_artifact_files(spark, folder: str) -> DataFrame:
    """The files of all artefacts: the pair, path, change_type and diff of each."""
    kind = "repo string, old_version string, new_version string, path string, change_type string, diff array<string>, pair_id string"
    return spark.read.schema(kind).json(f"{folder}/files")


def snapshot_catalog(files: DataFrame) -> DataFrame:
    """Files and bytes per cached (repo, version)."""
    return files.groupBy("repo", "version").agg(F.count(F.lit(1)).alias("file_count"),
                                                 F.sum(F.octet_length("content")).cast("bigint").alias("size_bytes"))


def archive_integrity(archives: DataFrame, min_bytes: int = 1024) -> DataFrame:
    """Sha-256 and size of each archive; too small or a size mismatch is rejected."""
    size = F.length("content")
    status = (F.when(size < min_bytes, F.lit("too_small"))
              .when(F.col("declared_size").isNotNull() & (size != F.col("declared_size")), F.lit("size_mismatch"))
              .otherwise(F.lit("ok")))
    return archives.select("path", F.sha2("content", 256).alias("archive_sha256"),
                           size.cast("bigint").alias("archive_size"), status.alias("status"))
