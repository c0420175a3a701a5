
from pyspark.sql import functions as F

from churnlens.functions import cwe as cwefn
from conftest import one_col


def labels(spark, texts, names=None):
    return one_col(spark, texts, cwefn.extract_labels("s", names))


def test_labelled_mentions(spark):
    cases = [
        ("CWE-79: Cross-site Scripting", ["CWE-79: Cross-site Scripting"]),
        ("CWE-089 - SQL Injection [high]", ["CWE-89: SQL Injection"]),
        ("CWE-000: nothing here", []),
        ("CWE-79: XSS\nCWE-079: again", ["CWE-79: XSS"]),
        ("CWE-22: Path Traversal - CWE-22", ["CWE-22: Path Traversal"]),
        ("CWE-79: XSS - src/a.php", ["CWE-79: XSS"]),
        ("CWE-352\n: CSRF issue", ["CWE-352: CSRF issue"]),
        ("CWE-79: Cross-site scripting - foo", ["CWE-79: Cross-site scripting"]),
        ("CWE-79: XSS in (template) - see docs", ["CWE-79: XSS in (template) - see docs"]),
        ("CWE-79: a\r\nCWE-20: b", ["CWE-79: a", "CWE-20: b"]),
        ("CWE-79:", []),
        ("no ids at all", []),
    ]
    assert labels(spark, [c[0] for c in cases]) == [c[1] for c in cases]


def test_dictionary_and_bare_ids(spark):
    d = spark.createDataFrame([("79", "Improper Neutralization"), ("CWE-020", "Improper Input Validation"),
                               ("0", "zero"), ("89", "")], "cwe_id string, name string")
    texts = ["see CWE-20 for details", "CWE-79: whatever\nalso CWE-20 and CWE-999", "CWE-89 bare without name"]
    rows = cwefn.with_dictionary(spark.createDataFrame([(t,) for t in texts], "s string"), d, "names", "s", ["s"])
    got = [r[0] for r in rows.select(cwefn.extract_labels("s", F.col("names"))).collect()]
    none = cwefn.with_dictionary(spark.createDataFrame([(texts[0],)], "s string"), d.limit(0), "names", "s", ["s"])
    assert [r[0] for r in none.select(cwefn.extract_labels("s", F.col("names"))).collect()] == [[]]
    assert got == [["CWE-20: Improper Input Validation"],
                   ["CWE-79: Improper Neutralization", "CWE-20: Improper Input Validation"], []]
    # Q16: without a dictionary bare ids give nothing
    assert labels(spark, ["see CWE-20 for details"]) == [[]]


def test_sanitize_and_normalize(spark):
    df = spark.createDataFrame([(" Buffer overflow - CWE-120 ", "120"), ("Thing - webapp", "1"),
                                ("Short - one two", "1"), ("", "1")], "d string, i string")
    got = [r[0] for r in df.select(cwefn.sanitize_description("d", "i")).collect()]
    assert got == ["Buffer overflow", "Thing", "Short - one two", ""]
    assert one_col(spark, [" cwe-0079 ", "CWE-000", "12"], cwefn.normalize_id("s")) == ["79", "", "12"]
