"""Operator 12 against running the filters in every order."""

import re
from collections import defaultdict
from itertools import permutations

from churnlens.llm import filter_audit
from edge import edge_docs, edge_rows

LABELS = [(10, 1, 0), (11, 0, 1), (13, 1, 1), (13, 0, 0), (17, None, 1), (20, 1, None), (None, 1, 1), (999, 1, 1), (5, 1, 0)]


def labels_of(spark):
    return spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string")


def failures(i, text, rows):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t in rows)}


def brute(rows, parts):
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    out = {}
    fails = [failures(i, t or "", rows) for i, t in rows]
    for order in permutations("ABCDE"):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            gone = [k for k in left if fails[k][f]]
            stay = [k for k in left if not fails[k][f]]
            for part in set(parts):
                own = lambda ks: [k for k in ks if parts[k] == part]  # noqa: B023, E731
                out[part, "".join(order), step] = [
                    len(own(stay)), len(own(gone)), len([k for k in own(range(len(rows))) if fails[k][f] and k not in left]),
                    len([k for k in own(range(len(rows))) if [g for g in "ABCDE" if fails[k][g]] == [f]]),
                    len([k for k in own(gone) if rows[k][0] in good]), len([k for k in own(gone) if rows[k][0] in toxic])]
            left = stay
    total = defaultdict(int)
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {(p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_every_order_against_brute_force(spark):
    symbols = [(40, "a # b"), (41, "GOOD $ WORDS " * 60), (3, "a # b"), (42, "Word " * 100), (43, " ".join(f"w{i}" for i in range(100))), (44, "ÄÖÜ É")]
    rows = edge_rows() + symbols
    parts = ["de" if k % 3 == 0 else "" if k % 3 == 1 else "en" for k in range(len(rows))]
    docs = spark.createDataFrame([(i, t, p or None, "m", 1) for (i, t), p in zip(rows, parts, strict=True)], "doc_id long, text string, lang string, mask string, n int")
    got = filter_audit.filter_audit(docs, labels_of(spark))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    got = [tuple(r) for r in got.collect()]
    assert len(got) == 3 * 600 and set(got) == brute(rows, parts)


def test_edge_rows_and_clashing_columns(spark):
    got = {tuple(r) for r in filter_audit.filter_audit(edge_docs(spark), labels_of(spark)).collect()}
    assert got == brute(edge_rows(), [""] * len(edge_rows()))


def test_empty_tables(spark):
    assert filter_audit.filter_audit(edge_docs(spark).limit(0), labels_of(spark)).collect() == []
    none = filter_audit.filter_audit(edge_docs(spark), labels_of(spark).limit(0)).collect()
    assert len(none) == 600 and all(r.good_lost == r.toxic_lost == 0 for r in none)


def test_no_python_in_the_plan(spark):
    plan = filter_audit.filter_audit(edge_docs(spark), labels_of(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
