from pyspark.sql import functions as F

from churnlens.functions import responses as rs
from conftest import one_col


def test_status_and_severity_cases(spark):
    cases = [
        ("", ("AI: No analysis", "unknown"), "low"),
        ("   \n\t ", ("AI: No analysis", "unknown"), "low"),
        ("Vulnerability Existed: yes Vulnerability Existed: yes", ("AI: 1 vulnerabilities", "yes"), "high"),
        ("Vulnerability Existed: yes\nVulnerability Existed: not sure", ("AI: 1 vulnerabilities", "yes"), "high"),
        ("Vulnerability Existed: YES (medium)", ("AI: 1 vulnerabilities", "yes"), "medium"),
        ("Vulnerability Existed: yes - critical\nVulnerability Existed: yes low", ("AI: 2 vulnerabilities", "yes"), "high"),
        ("Vulnerability Existed: yes (low)", ("AI: 1 vulnerabilities", "yes"), "low"),
        ("I am not sure about this change", ("AI: Not Sure", "not_sure"), "low"),
        ("Vulnerability Existed: no", ("AI: No vulnerabilities", "no"), "low"),
    ]
    got = one_col(spark, [c[0] for c in cases], F.struct(rs.response_status("s").alias("st"),
                                                         rs.response_severity("s").alias("sev")))
    for (text, status, sev), row in zip(cases, got):
        assert (row["st"]["text"], row["st"]["normalized"]) == status, text
        assert row["sev"] == sev, text


def test_cve_answer_cases(spark):
    cases = [("Description matches: yes\nDescription matches: no", "Yes"),
             ("analysis\nDescription Matches: NO\nmatch: yes", "No"),
             ("  match: no  ", "No"), ("Matches: YES", "Yes"), ("nothing decisive", "No"), ("", "No")]
    assert one_col(spark, [c[0] for c in cases], rs.cve_answer("s")) == [c[1] for c in cases]


def test_normalized_status_fallback(spark):
    df = spark.createDataFrame([
        ("not_sure", "Vulnerability Existed: yes", "AI: 1 vulnerabilities"),   # stored wins
        ("", "Vulnerability Existed: yes", ""),                                 # parsed answer
        ("", "", "AI: No vulnerabilities"),                                     # status text -> no
        ("", "", "AI: Not Sure"),                                               # -> not_sure
        ("", "", "AI: 3 vulnerabilities"),                                      # -> yes
        ("", "", "pending"),                                                    # -> unknown
    ], "stored string, resp string, st string")
    got = [r[0] for r in df.select(rs.normalized_status("stored", "resp", "st")).collect()]
    assert got == ["not_sure", "yes", "no", "not_sure", "yes", "unknown"]


def test_q1_no_vulnerabilities_counts_as_confirmed(spark):
    got = one_col(spark, ["AI: No vulnerabilities", "AI: Not Sure", "AI: No analysis", "AI: 2 vulnerabilities"],
                  rs.confidence_class("s"))
    assert got == ["confirmed", "uncertain", None, "confirmed"]


def test_envelope_text(spark):
    bodies = ['{"response": "a"}', '{"choices": [{"message": {"content": "b"}}]}',
              '{"content": [{"text": "c"}]}', '{"error": "x"}', "not json", '{"response": 5}']
    assert one_col(spark, bodies, rs.envelope_text("s")) == ["a", "b", "c", "No AI response", "No AI response",
                                                             "No AI response"]
    assert one_col(spark, ['{"response": "a", "content": [{"text": "c"}]}'], rs.envelope_text("s", "claude")) == ["c"]


def test_type_details_filter(spark):
    import pytest

    from churnlens.operators import findings as fnd
    f = spark.createDataFrame([(1, "a.php", "Vulnerability Existed: yes\nCWE-79: XSS"),
                               (1, "b.php", "Vulnerability Existed: yes"),
                               (1, "c.php", "Vulnerability Existed: no\nCWE-89: SQLi")],
                              "analysis_id long, filename string, ai_response string")
    p = fnd.parse_findings(f)
    assert [r.filename for r in fnd.vuln_type_details(p, "CWE-79: XSS").collect()] == ["a.php"]
    assert [r.filename for r in fnd.vuln_type_details(p, "Uncategorized").collect()] == ["b.php"]
    assert fnd.vuln_type_details(p, "CWE-1: unknown").count() == 0          # unknown type -> empty
    with pytest.raises(ValueError):
        fnd.vuln_type_details(p, "  ")                                       # blank -> error
    counts = {r.vuln_type: (r.type_count, r.type_rank) for r in fnd.vuln_type_counts(p).collect()}
    assert counts == {"CWE-79: XSS": (1, 1), "Uncategorized": (1, 2)}        # c.php is not relevant (Q3)
    assert fnd.vuln_count_per_analysis(p).collect()[0].vuln_count == 2       # A18 counts every label
