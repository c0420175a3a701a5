import re

import pyarrow as pa

from churnlens.operators import snapshots as snap

FILES = [
    ("r", "v1", "a.php", "one\ntwo\nthree\n"), ("r", "v2", "a.php", "one\n2\nthree\n"),     # modified
    ("r", "v1", "same.php", "x\n"), ("r", "v2", "same.php", "x\n"),                          # unchanged
    ("r", "v1", "gone.js", "g1\ng2"), ("r", "v2", "new.py", "n1\n"),                         # deleted / added
    ("r", "v1", "empty.php", ""), ("r", "v2", "empty.php", "now\n"),                         # empty old side
    ("r", "v2", ".hidden.php", "h\n"), ("r", "v2", ".github/w.yml", "w\n"),                  # excluded (product)
    ("r", "v1", "nl.txt", "end"), ("r", "v2", "nl.txt", "end\n"),                           # only newline changed
]


def frames(spark):
    files = spark.createDataFrame(FILES, "repo string, version string, path string, content string")
    pairs = spark.createDataFrame([("p", "r", "v1", "v2"), ("q", "r", "v2", "v9")],
                                  "pair_id string, repo string, old_version string, new_version string")
    return files, pairs


def test_alignment_modes(spark):
    files, pairs = frames(spark)
    prod = {(r.path, r.change_type) for r in snap.align(files, pairs).collect()}
    assert prod == {("a.php", "modified"), ("gone.js", "deleted"), ("new.py", "added"), ("nl.txt", "modified")}
    folder = {(r.path, r.change_type) for r in snap.align(files, pairs, mode="folder").collect()}
    assert ("empty.php", "modified") in folder and (".hidden.php", "added") in folder
    ext = {r.path for r in snap.align(files, pairs, extensions="PHP").collect()}
    assert ext == {"a.php"}
    summary = {r.pair_id: (r.status, r.file_count) for r in
               snap.bulk_summary(pairs, files, snap.align(files, pairs)).collect()}
    assert summary == {"p": ("completed", 4), "q": ("error", 0)}


def apply_unified(old: str, diff: list[str]) -> str:
    """Apply a unified diff (our rendering) to old text — a brute-force check of F11."""
    src = old.split("\n")
    src = [l + "\n" for l in src[:-1]] + ([src[-1]] if src[-1] else [])
    out, i, k = [], 0, 2
    while k < len(diff):
        m = re.match(r"@@ -(\d+)(?:,(\d+))? \+", diff[k])
        start = int(m.group(1)) - (0 if m.group(2) == "0" else 1)
        out += src[i:start]
        i = start
        k += 1
        while k < len(diff) and not diff[k].startswith("@@"):
            line = diff[k]
            nonl = k + 1 < len(diff) and diff[k + 1] == "\\ No newline at end of file"
            body = line[1:] + ("" if nonl else "\n")
            if line[0] == " ":
                out.append(body); i += 1
            elif line[0] == "-":
                i += 1
            elif line[0] == "+":
                out.append(body)
            k += 2 if nonl else 1
    out += src[i:]
    return "".join(out)


def test_unified_diff_roundtrip():
    cases = [("a\nb\nc\n", "a\nB\nc\n"), ("end", "end\n"), ("1\n2\n3\n4\n5\n6\n7\n8\n9\n", "1\n2\nx\n4\n5\n6\n7\n8\ny\n"),
             ("", "new\n"), ("x\ny", "y")]
    for old, new in cases:
        d = snap.unified_diff_lines(old, new, "o", "n")
        assert apply_unified(old, d) == new, (old, new, d)
    assert snap.unified_diff_lines("same\n", "same\n", "o", "n") == []


def test_frequent_lines_do_not_blow_up_a_diff():
    old = [f"line {k % 3}\n" for k in range(400)]
    new = [*old[:200], "inserted\n", *old[200:]]
    d = snap.unified_diff_lines("".join(old), "".join(new), "o", "n")
    assert [x for x in d[2:] if x[0] in "+-"] == ["+inserted"]


def test_lines_that_look_like_headers():
    d = snap.unified_diff_lines("a\n-- c", "a\n++ d", "o", "n")
    assert d == ["--- o", "+++ n", "@@ -1,2 +1,2 @@", " a", "--- c", "\\ No newline at end of file", "+++ d", "\\ No newline at end of file"]


def test_rendered_diffs_and_churn(spark):
    files, pairs = frames(spark)
    ch = snap.align(files, pairs)
    d = {r.path: r for r in snap.render_diffs(ch, files).collect()}
    assert d["gone.js"].diff == ["--- v1/gone.js", "+++ /dev/null", "@@ -1,2 +0,0 @@", "-g1", "-g2"]
    assert d["new.py"].diff == ["--- /dev/null", "+++ v2/new.py", "@@ -0,0 +1,1 @@", "+n1"]
    assert "\\ No newline at end of file" in d["nl.txt"].diff          # Q11
    churn = {r.path: (r.lines_added, r.lines_removed) for r in snap.line_churn(ch, files).collect()}
    assert churn["a.php"] == (1, 1) and churn["gone.js"] == (0, 2) and churn["nl.txt"] == (0, 0)
    art = snap.diff_artifact(ch, k=2).collect()[0]
    assert art.diff_count == 4 and art.highlights == ["a.php (modified)", "nl.txt (modified)"]


def test_path_sets_agree_with_align(spark):
    files, pairs = frames(spark)
    old = files.where("version = 'v1'")
    new = files.where("version = 'v2'")
    common, deleted, added = snap.path_sets(old, new)
    assert {r.path for r in added.collect()} == {"new.py", ".hidden.php", ".github/w.yml"}
    assert {r.path for r in common.collect()} == {"a.php", "same.php", "empty.php", "nl.txt"}
    assert {r.path for r in deleted.collect()} == {"gone.js"}


def test_invariants_on_test_tables(spark):
    """SURVEY §5(c): J01 partitions the paths exactly; churn balances the line counts."""
    from pyspark.sql import functions as F

    from churnlens.plans.catalog import fx_pairs
    from churnlens.sources import testdata as td
    from conftest import SF_SMALL
    files = td.fx_snapshots(spark, SF_SMALL)
    pairs = fx_pairs(spark, SF_SMALL).where(F.col("new_version") == "new")
    ch = snap.align(files, pairs, mode="folder")
    old = {r.path: r.h for r in snap.scan_files(files, "folder").where("version = 'old'").select("path", F.col("content_hash").alias("h")).collect()}
    new = {r.path: r.h for r in snap.scan_files(files, "folder").where("version = 'new'").select("path", F.col("content_hash").alias("h")).collect()}
    changes = {r.path: r.change_type for r in ch.collect()}
    unchanged = {p for p in old.keys() & new.keys() if old[p] == new[p]}
    assert set(changes) | unchanged == old.keys() | new.keys()
    assert not (set(changes) & unchanged)
    assert {p for p, t in changes.items() if t == "added"} == new.keys() - old.keys()
    assert {p for p, t in changes.items() if t == "deleted"} == old.keys() - new.keys()
    churn = snap.line_churn(ch, files).join(ch.select("pair_id", "path", "old_lines", "new_lines"), ["pair_id", "path"])
    for r in churn.collect():
        assert r.lines_added - r.lines_removed == (r.new_lines or 0) - (r.old_lines or 0)


def test_artifacts_are_written_and_read_back(spark, scratch):
    files, pairs = frames(spark)
    diffs = snap.render_diffs(snap.align(files, pairs), files)
    snap.write_artifacts(diffs, f"{scratch}/art", "2024-05-01 12:00:00", k=2)
    back = {(r.pair_id, r.path, r.change_type, tuple(r["diff"])) for r in snap.read_artifact_files(spark, f"{scratch}/art").collect()}
    assert back == {(r.pair_id, r.path, r.change_type, tuple(r["diff"])) for r in diffs.collect()} and len(back) == 4
    head = spark.read.json(f"{scratch}/art/headers").first()
    assert (head.pair_id, head.version_1, head.version_2, head.diff_count) == ("p", "v1", "v2", 4)
    assert head.highlights == ["a.php (modified)", "nl.txt (modified)"] and head.generated_at.startswith("2024-05-01T12:00:00")


def test_diffs_of_a_batch_are_made_in_slices():
    n = 2 * snap.DIFF_SLICE + 1
    old, new = ["a\nb"] * n, [None if i % 3 else f"a\n{i}" for i in range(n)]
    got = snap._unified_diff_batch(*(pa.array(c, pa.string()) for c in (old, new, ["o"] * n, ["n"] * n)))
    assert got.to_pylist() == [snap.unified_diff_lines(o, w, "o", "n") for o, w in zip(old, new)]
    none = pa.array([], pa.string())
    assert len(snap._unified_diff_batch(none, none, none, none)) == 0
