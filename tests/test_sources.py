import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from churnlens.plans import compare as cmp
from churnlens.sources import documents as docs
from churnlens.sources import snapshots as src

UUID1 = "123e4567-e89b-12d3-a456-426614174000"
UUID2 = "223e4567-e89b-12d3-a456-426614174000"


def _doc(status, params, results):
    return {"meta": {"created_at": "2024-01-05T10:00:00+02:00", "finished_at": "2024-01-05T10:05:00Z",
                     "source": "products", "ai_enabled": True, "status": status, "params": params},
            "results": results, "vuln_count": 0}


def test_read_documents(spark, scratch):
    d = os.path.join(scratch, "saved")
    os.makedirs(d)
    res = {"a.php": {"context": ["+x"], "ai_response": "Vulnerability Existed: yes\nCWE-79: XSS",
                     "vulnerability_status": "AI: 1 vulnerabilities", "cwe": ["CWE-79: XSS"],
                     "cve_matches": {"CVE-1": {"result": "Yes", "description": "d"}}}}
    with open(os.path.join(d, UUID1 + ".json"), "w") as f:
        json.dump(_doc("completed", {"product": "", "repo_name": "r", "bulk_total": 3}, res), f, indent=2)
    with open(os.path.join(d, UUID2 + ".json"), "w") as f:
        json.dump(_doc("running", {"product": None, "old_folder": "/x/y/"}, {}), f)
    with open(os.path.join(d, "not-a-uuid.json"), "w") as f:
        json.dump(_doc("completed", {}, {}), f)
    with open(os.path.join(d, "323e4567-e89b-12d3-a456-426614174000.json"), "w") as f:
        f.write("{ broken")
    raw = docs.read_documents(spark, d)
    assert docs.read_documents(spark, d, modified_after="2999-01-01 00:00:00").count() == 0     # S16
    assert docs.read_documents(spark, d, modified_after="2000-01-01 00:00:00").count() == 2
    a = {r.analysis_id: r for r in docs.analyses_table(raw).collect()}
    assert set(a) == {UUID1, UUID2}
    assert a[UUID1].product == "" and a[UUID1].repo_name == "r" and a[UUID1].bulk_total is None   # number, not string
    assert a[UUID2].has_product and a[UUID2].product is None                                     # Q6: null counts
    assert str(a[UUID1].created_at) == "2024-01-05 08:00:00"
    f = docs.findings_table(raw).collect()
    assert len(f) == 1 and f[0].cwe == ["CWE-79: XSS"]
    assert [(r.cve_id, r.result) for r in docs.finding_cves(docs.findings_table(raw)).collect()] == [("CVE-1", "Yes")]
    info = {r.analysis_id: (r.product_name, r.old_version) for r in docs.product_info(docs.analyses_table(raw)).collect()}
    assert info[UUID1] == ("r", "") and info[UUID2] == ("y", "/x/y/")                              # Q5 fallback


def test_payload_products_library(spark):
    p = spark.createDataFrame([(json.dumps({"source": "ci\x01-tool-with-a-long-name-here", "results": {
        "f.py": {"context": ["a", 1, "b"], "ai_response": "CWE-89: SQLi", "vulnerability_status": 5}}}),)], "json string")
    row = docs.ingest_payload(p).collect()[0]
    assert row.source == "ci-tool-with-a-long-" and row.cwe == ["CWE-89: SQLi"]
    assert row.context == ["a", "b"] and row.vulnerability_status == "" and row.ai_enabled is False
    prods = spark.createDataFrame([('{"a": {"repo_url": "u", "versions": ["1"]}}',), ("broken",)], "json string")
    assert [(r.product, r.repo_url) for r in docs.products_from_json(prods).collect()] == [("a", "u")]
    lib = docs.library_from_json(spark.createDataFrame(
        [('[{"id": "1", "name": "x", "repo_url": "https://github.com/o/x", "auto_scan": true}]',)], "json string"))
    new = spark.createDataFrame([("2", "y", "https://gitlab.com/y"), ("3", "x", "dup")], "id string, name string, repo_url string")
    lib2 = docs.library_add(lib, new)
    assert sorted(r.name for r in lib2.collect()) == ["x", "y"]
    toggled = {r.id: r.auto_scan for r in docs.library_toggle(lib2, spark.createDataFrame([("1",)], "id string")).collect()}
    assert toggled["1"] is False
    assert [r.id for r in docs.auto_scan_candidates(lib).collect()] == ["1"]
    assert [r.id for r in docs.library_remove(lib2, spark.createDataFrame([("1",)], "id string")).collect()] == ["2"]


def test_cwe_xml_dictionary(spark, scratch):
    path = os.path.join(scratch, "cwe.xml")
    with open(path, "w") as f:
        f.write('<Weakness_Catalog><Weaknesses><Weakness ID="089" Name=" SQL Injection "/>'
                '<Weakness ID="79" Name="XSS"></Weakness><Weakness ID="" Name="blank"/></Weaknesses></Weakness_Catalog>')
    got = {r.cwe_id: r.name for r in docs.cwe_dictionary(spark, path).collect()}
    assert got == {"89": "SQL Injection", "79": "XSS"}


def test_tree_scan_and_archives(spark, scratch):
    root = os.path.join(scratch, "trees")
    for rel, text in [("r/v1/a.php", "x\n"), ("r/v1/.git/config", "c"), ("r/v2/a.php", "y\n"), ("r/v2/.env", "s")]:
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)
    prod = {(r.repo, r.version, r.path) for r in src.scan_tree(spark, root).collect()}
    assert prod == {("r", "v1", "a.php"), ("r", "v2", "a.php")}
    everything = {(r.version, r.path) for r in src.scan_tree(spark, root, mode="folder").collect()}
    assert {p for p in everything if "/." in f"/{p[1]}" or "/_" in f"/{p[1]}"} <= everything and len(everything) >= 2
    zroot = os.path.join(scratch, "zips", "lib")
    os.makedirs(zroot)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("lib-1.0/src/a.py", "print(1)\n")
        z.writestr("lib-1.0/README", "hi")
    with open(os.path.join(zroot, "1.0.zip"), "wb") as f:
        f.write(buf.getvalue())
    with open(os.path.join(zroot, "bad.zip"), "wb") as f:
        f.write(b"no archive")
    files = src.expand_archives(src.read_archives(spark, os.path.join(scratch, "zips")))
    assert [(r.version, r.path) for r in files.where("error IS NOT NULL").collect()] == [("bad", None)]
    files = files.where("error IS NULL")
    assert sorted((r.repo, r.version, r.path) for r in files.collect()) == [("lib", "1.0", "README"), ("lib", "1.0", "src/a.py")]


def test_compare_jobs(spark):
    files = spark.createDataFrame([("r", "1.0", "a.php", "function f() { return g(1); }\nx\n"),
                                   ("r", "1.1", "a.php", "function f() { return g(2); }\nx\n"),
                                   ("r", "1.1", "b.php", "function g($a) { return $a; }\n"),
                                   ("r", "1.2", "a.php", "y\n"), ("r", "1.2", "b.php", "function g($a) { return $a; }\n")],
                                  "repo string, version string, path string, content string")
    tags = spark.createDataFrame([("r", "1.0"), ("r", "1.1"), ("r", "1.2")], "repo string, tag string")
    keyed, summary = cmp.bulk_compare(files, tags, 2)
    keys = {r.result_key for r in keyed.collect()}
    assert keys == {"[1.1→1.0] a.php", "[1.1→1.0] b.php", "[1.2→1.1] a.php"}
    assert {r.status for r in summary.collect()} == {"completed"}
    pairs = spark.createDataFrame([("p", "r", "1.0", "1.1")], "pair_id string, repo string, old_version string, new_version string")
    diffs = cmp.compare_snapshots(files, pairs)
    prompts = {r.path: r.prompt for r in cmp.review_requests(diffs, files.where(F.col("version") == "1.1")).collect()}
    assert "[Function: g]" in prompts["a.php"] and "a.php" in prompts["a.php"]
    cves = spark.createDataFrame([("cpe:x:1.0", "CVE-9", "d")], "cpe_name string, cve_id string, description string")
    req = pairs.withColumn("cpe", F.lit("cpe:x"))
    seeded = cmp.cve_compare(files, req, cves).collect()
    assert {(r.path, r.cve_id, r.result) for r in seeded} == {("a.php", "CVE-9", "Pending AI analysis"),
                                                               ("b.php", "CVE-9", "Pending AI analysis")}


def test_dashboard_bundle_agrees_with_the_single_metrics(spark):
    from churnlens.operators import dashboards as dash
    from churnlens.plans import catalog
    from churnlens.sources import testdata as td
    from conftest import SF_SMALL
    got = {}
    for r in catalog.QUERIES["dashboard_bundle"](spark, SF_SMALL).collect():
        assert (r.metric, r.key) not in got
        got[r.metric, r.key] = r.value
    kpi = catalog.QUERIES["analysis_kpis"](spark, SF_SMALL).first().asDict()
    assert {k: got[k, ""] for k in kpi} == {k: float(v) for k, v in kpi.items()}
    cache = catalog.QUERIES["cache_kpis"](spark, SF_SMALL).first().asDict()
    import pytest
    assert all(got[k, ""] == pytest.approx(float(v)) for k, v in cache.items())
    top = {r.cwe: r.cwe_count for r in catalog.QUERIES["top_cwes"](spark, SF_SMALL).collect()}
    assert {k: v for (m, k), v in got.items() if m == "top_cwes"} == top
    weeks = {r.period: r.vuln_count for r in dash.vuln_trend(catalog._roll(spark, SF_SMALL), "week").collect()}
    assert {k: v for (m, k), v in got.items() if m == "trend_week"} == weeks
    from churnlens.plans.dashboard import ALWAYS, dashboard_bundle
    empty = lambda df: df.limit(0)
    none = dashboard_bundle(empty(td.fx_analyses(spark, SF_SMALL)), empty(catalog.parsed_findings(spark, SF_SMALL)), empty(catalog.cve_matches(spark, SF_SMALL)),
                            empty(td.fx_library(spark, SF_SMALL)), empty(td.fx_products(spark, SF_SMALL)), empty(td.fx_access(spark, SF_SMALL)),
                            spark.createDataFrame([], "size_bytes long")).collect()
    assert {r.metric for r in none} >= set(ALWAYS) and all(r.value == 0 for r in none)


def test_a_lookup_reads_one_row_group(spark, scratch):
    import glob
    import hashlib

    import pyarrow.parquet as pq
    ids = ["-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:32])) for h in (hashlib.md5(str(i).encode()).hexdigest() for i in range(20_000))]
    rows = spark.createDataFrame([(x, i, f"{x} {i}" * 20) for i, x in enumerate(ids)], "analysis_id string, number long, body string")
    docs.write_lookup(rows, f"{scratch}/lookup", group_bytes=100_000)
    found = docs.analysis_by_id(spark.read.parquet(f"{scratch}/lookup"), ids[777])
    assert found.first()["number"] == 777
    assert "PushedFilters: [IsNotNull(analysis_id), EqualTo(analysis_id" in found._jdf.queryExecution().toString()
    groups = holding = blooms = 0
    for f in glob.glob(f"{scratch}/lookup/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(0)
            groups += 1
            blooms += column.statistics is not None
            holding += column.statistics.min <= ids[777] <= column.statistics.max
    assert groups >= 20 and holding == 1 and blooms == groups


def test_lookup_sink_status_and_library_compare(spark, scratch):
    import datetime as dt

    import pytest
    from churnlens.operators import snapshots as snap
    a = spark.createDataFrame([(UUID1, dt.datetime(2024, 1, 5, 10), "running", None),
                               (UUID2, dt.datetime(2024, 1, 6, 11), "running", None)],
                              "analysis_id string, created_at timestamp, status string, error string")
    assert docs.analysis_by_id(a, UUID1).count() == 1
    with pytest.raises(ValueError):
        docs.analysis_by_id(a, "not-a-uuid")
    failed = docs.mark_failed(a, spark.createDataFrame([(UUID2, "download failed")], "analysis_id string, error string"))
    got = {r.analysis_id: (r.status, r.error) for r in failed.collect()}
    assert got == {UUID1: ("running", None), UUID2: ("failed", "download failed")}
    out = os.path.join(scratch, "analyses")
    docs.write_analyses(failed, out)
    assert {"created_day=2024-01-05", "created_day=2024-01-06"} <= set(os.listdir(out))
    assert spark.read.parquet(out).count() == 2
    files = spark.createDataFrame([("https://github.com/o/r", "1", "a.c", "int a;\n"),
                                   ("https://github.com/o/r", "2", "a.c", "int b;\n"),
                                   ("https://github.com/o/r", "1", "bin.c", "x\u0000y\n"),
                                   ("https://github.com/o/r", "2", "bin.c", "x\u0000z\n")],
                                  "repo string, version string, path string, content string")
    req = spark.createDataFrame([("https://github.com/o/r", "1", "2")], "repo_url string, old_version string, new_version string")
    res = cmp.library_compare(files, req).collect()
    assert [r.path for r in res] == ["a.c"]                      # Q10: the binary file is not diffed
    assert res[0].pair_id == "https://github.com/o/r:1:2"
    assert len(snap.align(files, req.select(F.lit("p").alias("pair_id"), F.col("repo_url").alias("repo"),
                                            "old_version", "new_version")).collect()) == 2


def test_readme_flow(spark, scratch):
    from churnlens.operators import dashboards, findings
    root = os.path.join(scratch, "readme_trees")
    by_version = {"1.0": "<?php\nfunction f() { return g(1); }\nfunction g($a) { return $a; }\n",
           "1.1": "<?php\nfunction f() { return g(2); }\nfunction g($a) { return $a; }\n",
           "1.2": "<?php\nfunction f() { return g(3); }\nfunction g($a) { return $a + 1; }\n"}
    for ver, text in by_version.items():
        os.makedirs(os.path.join(root, "repo1", ver))
        with open(os.path.join(root, "repo1", ver, "a.php"), "w") as fh:
            fh.write(text)
    files = src.scan_tree(spark, root)
    tags = spark.createDataFrame([("repo1", v) for v in by_version], "repo string, tag string")
    keyed, per_pair = cmp.bulk_compare(files, tags, count=2)
    reqs = cmp.review_requests(keyed, files).collect()
    assert len(reqs) == 2 and all("a.php" in r.prompt for r in reqs)
    assert any("[Function: g]" in r.prompt for r in reqs)
    assert {r.status for r in per_pair.collect()} == {"completed"}
    d = os.path.join(scratch, "readme_docs")
    os.makedirs(d)
    with open(os.path.join(d, UUID1 + ".json"), "w") as fh:
        json.dump(_doc("completed", {"repo_name": "repo1"},
                       {"a.php": {"ai_response": "Vulnerability Existed: yes\nCWE-79: XSS"}}), fh)
    raw = docs.read_documents(spark, d)
    parsed = findings.parse_findings(docs.findings_table(raw))
    kpis = dashboards.analysis_kpis(dashboards.rollup(docs.analyses_table(raw), parsed)).collect()[0]
    assert (kpis.total_completed, kpis.total_vulns) == (1, 1)
    assert findings.vuln_type_counts(parsed).collect()[0].vuln_type == "CWE-79: XSS"


def test_tree_scan_sees_every_name_and_compares_bytes(spark, scratch):
    root = os.path.join(scratch, "bytes")
    trees = {"v1": {"__init__.py": b"x = 1\n", "_p.php": b"<?php\n", "_private/b.py": b"y\n", "a.py": b"a\n", ".env": b"k=v\n", "lib/.hidden": b"h\n",
                    "latin.c": b"caf\xe9\n", "high.c": b"z\xe9", "same.c": b"\xff\xfe\n"},
             "v2": {"__init__.py": b"x = 2\n", "_p.php": b"<?php\n", "_private/b.py": b"z\n", "a.py": b"a\n", ".env": b"k=w\n", "lib/.hidden": b"h\n",
                    "latin.c": b"caf\xe8\n", "high.c": "z\u00e9".encode(), "same.c": b"\xff\xfe\n"}}
    for version, files in trees.items():
        for path, data in files.items():
            p = os.path.join(root, "r", version, path)
            os.makedirs(os.path.dirname(p), exist_ok=True)
            with open(p, "wb") as f:
                f.write(data)
    folder = src.scan_tree(spark, root, mode="folder")
    assert {(r.version, r.path) for r in folder.collect()} == {(v, p) for v, files in trees.items() for p in files}
    product = {r.path for r in src.scan_tree(spark, root).collect()}
    assert {"__init__.py", "_p.php", "_private/b.py", "a.py"} <= product and ".env" not in product
    assert {r.path for r in src.scan_tree(spark, root, path_glob="*.py").collect()} == {"__init__.py", "_private/b.py", "a.py"}
    pairs = spark.createDataFrame([("p", "r", "v1", "v2")], "pair_id string, repo string, old_version string, new_version string")
    changes = cmp.compare_snapshots(folder, pairs, mode="folder")
    got = {r.path: r.diff for r in changes.collect()}
    assert set(got) == {"__init__.py", "_private/b.py", ".env", "latin.c"} | ({"high.c"} & set(got))
    assert got["latin.c"][-2:] == ["-caf\u00e9", "+caf\u00e8"]
    from churnlens.operators import snapshots as ops
    kinds = {r.path: r.change_type for r in ops.align(folder, pairs, mode="folder").collect()}
    assert kinds["high.c"] == "modified" and "same.c" not in kinds  # two encodings of one text are two contents


def test_a_deep_page_reads_its_blocks_only(spark, scratch):
    import datetime as dt
    import random

    from churnlens.operators import reports
    rnd = random.Random(1)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(hours=rnd.randint(0, 400))) for i in range(3_000)]
    table = spark.createDataFrame(rows, "analysis_id long, created_at timestamp")
    reports.write_paged(table, f"{scratch}/paged", block_rows=400)
    listed = [i for i, t in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    for page in (1, 2, 77, 150, 299, 300, 301, 5_000):
        got = reports.stored_page(spark, f"{scratch}/paged", page, 10)
        assert [r.analysis_id for r in got.collect()] == listed[(page - 1) * 10:page * 10], page
        assert got.columns == table.columns
    index = spark.read.parquet(f"{scratch}/paged/index").collect()
    held = [r.block for r in index if r.start < 1500 and r.start + r.rows > 1490]
    scan = reports.stored_page(spark, f"{scratch}/paged", 150, 10)._jdf.queryExecution().executedPlan().toString()
    wanted = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert len(index) == 8 and 1 <= len(held) <= 2 and "block#" in wanted and all(f"{k}" in wanted for k in held)
    reports.write_paged(table.limit(0), f"{scratch}/none")
    assert reports.stored_page(spark, f"{scratch}/none", 1, 10).collect() == []


def test_document_texts_are_parsed_once(spark):
    rows = [(1, _doc("completed", {"product": "p"}, {"a.php": {"ai_response": "x"}, "b.php": {"ai_response": None}})),
            (2, _doc("failed", {}, {})), (3, '{"results": {"a.php": {"ai_response": "x"}}}'), (4, "no json"), (5, None),
            (6, '{"meta": null}'), (7, ""), (None, _doc("running", {}, {"c.php": {"ai_response": "yy"}})),
            (8, '{"meta": {"status": "completed"}, "results": [1]}')]
    rows = [(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in rows]
    parsed = docs.parse_documents(spark.createDataFrame(rows, "analysis_id long, json string"))
    status = parsed.select("analysis_id", "meta.status", "results")
    text = status._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json") == 1                                    # not once more for the filter and for each field
    got = {(r["analysis_id"], r["status"]): r["results"] for r in status.collect()}
    assert set(got) == {(1, "completed"), (2, "failed"), (None, "running"), (8, "completed")}
    assert got[2, "failed"] == {} and got[8, "completed"] is None
    found = docs.findings_table(parsed).select("analysis_id", "filename", "ai_response").collect()
    assert {tuple(r) for r in found} == {(1, "a.php", "x"), (1, "b.php", None), (None, "c.php", "yy")}


def test_document_texts_reads_stored_documents(spark, scratch):
    from churnlens.plans import catalog
    day = "timestamp'1995-02-18 10:00:00'"
    tables = {
        "nation": "SELECT 1 AS n_nationkey, 'N' AS n_name",
        "customer": "SELECT 7L AS c_custkey, 1 AS c_nationkey, 'SEG' AS c_mktsegment",
        "part": "SELECT 5L AS p_partkey, 'red plate' AS p_name, 'TIN' AS p_type",
        "orders": f"SELECT id AS o_orderkey, 7L AS o_custkey, 'F' AS o_orderstatus, {day} AS o_orderdate, '3-MEDIUM' AS o_orderpriority FROM range(1, 4)",
        "lineitem": """SELECT CAST(o AS BIGINT) AS l_orderkey, 5L AS l_partkey, 2L AS l_suppkey, n AS l_linenumber, 1.0D AS l_quantity, 'N' AS l_returnflag,
                              'O' AS l_linestatus FROM VALUES (1, 1), (1, 2), (1, 2), (2, 1) t(o, n)""",
    }
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{scratch}/{name}.parquet")
    out = catalog.document_texts(spark, scratch)
    assert "from_json" not in out._jdf.queryExecution().optimizedPlan().toString()      # no text is parsed by both branches
    no = len("Vulnerability Existed: no")
    assert sorted((r["analysis_id"], r["product"], r["created_at"], r["n_results"], r["n_chars"]) for r in out.collect()) == [
        (1, "SEG", "1995-02-18 10:00:00", 2, 2 * no), (2, "SEG", "1995-02-18 10:00:00", 1, no), (3, "SEG", "1995-02-18 10:00:00", 0, 0)]
