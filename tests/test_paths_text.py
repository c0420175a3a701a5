from pyspark.sql import functions as F

from churnlens.functions import paths as pth
from churnlens.functions import text as tx
from churnlens.operators.reports import page_params
from churnlens.operators.snapshots import any_line_has_keyword, keyword_list
from conftest import one_col


def test_language_detection(spark):
    cases = [("a/b.php", "php"), ("x/test.min.js", "javascript"), (".php", "php"), ("A.PY", "python"),
             ("m.h", "c"), ("m.hpp", "cpp"), ("m.ixx", "cpp"), ("k.ts", "typescript"), ("k.tsx", "typescript"),
             ("r.rs", "rust"), ("g.go", "go"), ("j.java", "java"), ("c.cs", "csharp"), ("r.gemspec", "ruby"),
             ("Makefile", "unknown"), ("dir.d/file", "unknown")]
    assert one_col(spark, [c[0] for c in cases], pth.analysis_language("s")) == [c[1] for c in cases]
    assert one_col(spark, ["a.jsx", "a.h", "a.swift", "a.txt"], pth.display_language("s")) == \
        ["JavaScript", None, "Swift", None]


def test_extension_and_filters(spark):
    assert one_col(spark, ["x.MIN.JS", "noext", "a.b/c", ".env"], pth.extension("s")) == [".js", "", "", ".env"]
    kept = one_col(spark, [".github/x.yml", "a/.env", "src/a.php", "node_modules/x.js"], pth.snapshot_path_kept("s"))
    assert kept == [False, False, True, False]
    multi = "é" * 128  # 256 bytes
    valid = one_col(spark, ["a..b", "ok.txt", "", multi, "é" * 127, "a:b", 'q"'], pth.valid_filename("s"))
    assert valid == [False, True, False, False, True, False, False]
    assert one_col(spark, ["php, .JS,,", "", None], pth.parse_extensions("s")) == [[".php", ".js"], [], []]


def test_index_exclusions_and_validity(spark):
    got = one_col(spark, ["src/Vendor/x.php", "src/vendorx/y.php", "tests/t.py", "a/b/c.go", "a/b/Makefile"],
                  pth.index_path_kept("s"))
    assert got == [False, True, False, True, False]
    assert one_col(spark, ["v1.2.3", "1.0-rc_1", "bad tag", "x" * 51, ""], pth.valid_version("s")) == \
        [True, True, False, False, False]
    assert one_col(spark, ["https://github.com/a/b", "http://github.com/a", "https://gitlab.com/a"],
                   pth.valid_repo_url("s")) == [True, True, False]
    assert one_col(spark, ["123e4567-e89b-12d3-a456-426614174000", "{123e4567-e89b-12d3-a456-426614174000}",
                           "urn:uuid:123e4567-e89b-12d3-a456-426614174000", "123e4567e89b12d3a456426614174000",
                           "nope"], pth.valid_uuid("s")) == [True, True, True, True, False]


def test_repo_name_and_ip(spark):
    assert one_col(spark, ["https://github.com/org/repo/", "plain"], pth.repo_name("s"))[0] == "repo"
    assert one_col(spark, ["plain"], pth.repo_name("s"))[0].startswith("repo_")
    assert len(one_col(spark, ["plain"], pth.repo_name("s"))[0]) == 8
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9:80"), ("", "10.0.0.1:5000"), (None, "[::1]:80")],
                               "xff string, addr string")
    assert [r[0] for r in df.select(pth.client_ip("xff", "addr")).collect()] == ["1.2.3.4", "10.0.0.1", "[::1]"]


def test_lines_and_cleaning(spark):
    got = one_col(spark, ["", "\n", "a\nb", "a\r\nb\n", "a\n\n"], tx.file_lines("s"))
    assert got == [[], [""], ["a", "b"], ["a\r", "b"], ["a", ""]]
    assert one_col(spark, ["  a\x01b\x7f\u0085c  "], tx.clean_input("s", 100)) == ["abc"]
    assert one_col(spark, ["a\tb\nc\x08"], tx.clean_prompt("s", 100)) == ["a\tb\nc"]
    assert one_col(spark, ["ééé"], tx.clean_input("s", 5)) == ["éé"]     # 6 bytes cut to 5: broken char dropped
    assert one_col(spark, ["Hello, World!", "", "***", "A__b"], tx.path_slug("s")) == \
        ["hello_world", "unknown", "value", "a_b"]


def test_keywords(spark):
    assert keyword_list(None) == [] and keyword_list("a,") == ["a", ""] and keyword_list(" x , y") == ["x", "y"]
    df = spark.createDataFrame([(["--- a/f", "+++ b/f", "+foo"],)], "lines array<string>")
    hit = lambda kws: df.select(any_line_has_keyword(F.col("lines"), keyword_list(kws))).first()[0]
    assert hit(None) and hit("foo") and not hit("bar") and hit("bar,")   # '' matches every line
    assert hit("a/f")                                                     # header lines count


def test_page_params():
    assert page_params(0, 4) == (1, 10)
    assert page_params(1, 5) == (1, 5)
    assert page_params(3, 50) == (3, 50)
    assert page_params("x", 51) == (1, 10)
    assert page_params(2, "text") == (2, 10)
