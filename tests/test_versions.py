import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlens.operators import versions as ver


def reference_compare(v1: str, v2: str) -> int:
    """A plain re-statement of the version comparison rule (for checking the sort key)."""
    def parts(v):
        v = v[1:] if v.startswith("v") else v
        return v.replace("_", ".").split(".")

    def num(p):
        m = re.match(r"[0-9]+", p)
        return int(m.group(0)) if m else None

    a, b = parts(v1), parts(v2)
    n = max(len(a), len(b))
    a += ["0"] * (n - len(a))
    b += ["0"] * (n - len(b))
    for x, y in zip(a, b):
        nx, ny = num(x), num(y)
        if nx is not None and ny is not None:
            if nx != ny:
                return 1 if nx > ny else -1
        elif x != y:
            return 1 if x.encode() > y.encode() else -1
    return 0


def test_fixed_cases(spark):
    pairs = [("v1.2", "1.2.0", 0), ("1_10", "1.9", 1), ("2.0-rc1", "2.0", 0), ("1.a", "1.0", 1),
             ("1.-x", "1", -1), ("1." + "9" * 25, "1." + "9" * 24, 1), ("vv1", "v1", 1)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = [r[0] for r in df.select(ver.compare_versions("a", "b")).collect()]
    assert got == [p[2] for p in pairs]


part = st.one_of(st.from_regex(r"[0-9]{1,3}[a-z]{0,2}", fullmatch=True), st.from_regex(r"[a-z-]{0,3}", fullmatch=True))
version = st.builds(lambda v, ps: ("v" if v else "") + ".".join(ps), st.booleans(), st.lists(part, min_size=1, max_size=4))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(version, version), min_size=300, max_size=300))
def test_key_matches_comparator(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(ver.compare_versions("a", "b")).collect()]
    assert got == [reference_compare(a, b) for a, b in pairs]


def test_release_pairs_and_next(spark):
    tags = spark.createDataFrame(
        [(1, "v1.0"), (1, "v1.10"), (1, "v1.2"), (1, " v1.2 "), (1, "bad tag"), (2, "0.1")], "repo long, tag string")
    out = {(r["repo"], r["pair_index"]): (r["new_version"], r["old_version"], r["status"])
           for r in ver.release_pairs(tags, 2).collect()}
    assert out[(1, 0)] == ("v1.10", "v1.2", "ok") and out[(1, 1)] == ("v1.2", "v1.0", "ok")
    assert out[(2, None)] == (None, None, "insufficient")
    dated = spark.createDataFrame(
        [(1, "2.0-b", "2024-01-03"), (1, "2.0-a", "2024-01-02"), (1, "1.0", "2024-01-01"), (1, "2.0-c", "2024-01-04"),
         (1, "3.0", "2024-01-05")], "repo long, tag string, d string").withColumn("published_at", F.to_timestamp("d"))
    cur = spark.createDataFrame([(1, "2.0-a"), (1, "3.0"), (1, "9.9"), (2, "x")], "repo long, current_version string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in ver.next_versions(dated, cur).collect()}
    assert got[(1, "2.0-a")] == ("2.0-b", "2.0-c")  # next by date; newest same-base tag
    assert got[(1, "3.0")] == ("3.0", "3.0")       # at the head: the head itself
    assert got[(1, "9.9")] == ("3.0", "3.0")       # unknown: list head
    assert got[(2, "x")] == ("x", "x")             # no tags: itself


def test_pairs_and_next_versions_equal_the_sorted_lists(spark):
    import datetime as dt
    import random

    rnd = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    rows = [(f"r{rnd.randint(0, 5)}" if rnd.random() < 0.6 else "big", f"{rnd.choice(['v', ''])}{rnd.randint(0, 3)}.{rnd.randint(0, 12)}{rnd.choice(['', '-1', '-rc', '_2'])}",
             None if rnd.random() < 0.05 else day + dt.timedelta(hours=rnd.randint(0, 60))) for _ in range(400)] + [("one", "1.0", day), ("none", "bad tag", day)]
    tags = spark.createDataFrame(rows, "repo string, tag string, published_at timestamp")
    ranked = {}
    for r in ver.sorted_versions(tags).orderBy("version_rank").collect():
        ranked.setdefault(r.repo, []).append(r.tag)
    for count in (1, 3, 20):
        got = {(r.repo, r.pair_index, r.new_version, r.old_version, r.available_versions, r.status) for r in ver.release_pairs(tags, count).collect()}
        want = set()
        for repo, t in ranked.items():
            if len(t) >= count + 1:
                want |= {(repo, i, t[i], t[i + 1], len(t), "ok") for i in range(count)}
            else:
                want.add((repo, None, None, None, len(t), "insufficient"))
        assert got == want
    listed = {}
    for r in ver.tags_by_date(tags).orderBy("date_rank").collect():
        listed.setdefault(r.repo, []).append(r.tag)
    current = [(repo, t) for repo, ts in listed.items() for t in [*ts, "unknown", "0-x"]] + [("none", "1.0"), ("nowhere", "2-1")]
    got = {(r.repo, r.current_version): (r.next_version, r.next_incremental)
           for r in ver.next_versions(tags, spark.createDataFrame(current, "repo string, current_version string")).collect()}
    for repo, cur in current:
        ts = listed.get(repo, [])
        at = ts.index(cur) if cur in ts else -1
        nxt = ts[at - 1] if at > 0 else ts[0] if ts else cur
        family = [t for t in ts[:max(at, 0)] if "-" in cur and "-" in t and t.split("-")[0] == cur.split("-")[0]]
        assert got[repo, cur] == (nxt, family[0] if family else nxt), (repo, cur)
    plan = ver.release_pairs(tags, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "rangepartitioning" not in plan
