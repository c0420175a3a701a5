"""Answers parsed once per text."""

from churnlens.functions import responses as rs
from churnlens.functions.cwe import extract_labels
from conftest import one_col
from test_plans import plan


def test_status_needs_no_lambda_over_lines(spark):
    df = spark.createDataFrame([("x",)], "s string").select(rs.response_status("s")["normalized"].alias("n"))
    assert "lambda" not in plan(df)


def test_status_and_severity_of_odd_answers(spark):
    texts = [None, "", "  \n\x85", "ok", "NOT SURE", "x\nVulnerability Existed: YES vulnerability existed: yes\nvulnerability existed: yes low",
             "high\nVulnerability existed: yes\ncritical", "a medium vulnerability existed: yes\r\nhigh", "low: vulnerability existed: yes (LOW)"]
    st = one_col(spark, texts, rs.response_status("s"))
    assert [s["normalized"] for s in st] == ["unknown"] * 3 + ["no", "not_sure"] + ["yes"] * 4
    assert st[5]["text"] == "AI: 2 vulnerabilities" and st[0]["text"] == rs.NO_ANALYSIS_TEXT
    assert one_col(spark, texts, rs.response_severity("s"))[5:] == ["high", "high", "medium", "low"]


def test_labels_with_and_without_a_part_to_cut(spark):
    texts = ["CWE-079: XSS", "CWE-79: XSS - src/a.php [1]", "CWE-000: nothing", "CWE-7: a b - CWE-7\nCWE-07: again\nCWE-8 - c - d", None]
    assert one_col(spark, texts, extract_labels("s")) == [["CWE-79: XSS"], ["CWE-79: XSS"], [], ["CWE-7: a b", "CWE-8: c"], []]
