"""Plan-shape checks: the properties the scale design relies on, read from explain()."""

import contextlib
import io
import re

import __spark_entry__ as E
from conftest import SF_SMALL

Q = E.queries()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_parsing_stays_in_the_jvm_and_prunes_columns(spark):
    p = plan(Q["cwe_labels"](spark, SF_SMALL))
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    lineitem_schema = [l for l in p.splitlines() if "ReadSchema" in l and "l_orderkey" in l][0]
    for unused in ("l_extendedprice", "l_discount", "l_tax", "l_shipdate"):
        assert unused not in lineitem_schema


def test_global_top_k_is_bounded(spark):
    p = plan(Q["top_cwes"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_python_only_for_modified_file_diffs(spark):
    p = plan(Q["unified_diff"](spark, SF_SMALL))
    assert len(set(re.findall(r"ArrowEvalPython \((\d+)\)", p))) == 1      # difflib runs once per file


def exchange_outputs(p: str) -> list[str]:
    """The column lists that go into each exchange of a formatted plan."""
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", p)


def test_alignment_does_not_shuffle_content(spark):
    from churnlens.operators import snapshots as snap
    from churnlens.plans.catalog import fx_pairs
    from churnlens.sources import testdata as td
    moved = exchange_outputs(plan(snap.align(td.fx_snapshots(spark, SF_SMALL), fx_pairs(spark, SF_SMALL))))
    assert moved
    for columns in moved:
        names = {c.split("#")[0].strip() for c in columns.split(",")}
        assert not names & {"content", "text", "old_content", "new_content"}


def test_type_ranking_reads_its_positions_from_one_table(spark):
    p = plan(Q["vuln_type_counts"](spark, SF_SMALL))
    assert "Scan ExistingRDD" in p and "rangepartitioning" not in p.lower()


def test_an_alignment_is_planned_once(spark):
    """Line churn and diffs read the written change list; the files are scanned for the alignment and for the texts."""
    for name in ("line_churn", "whole_file_diffs", "snapshot_changes"):
        p = plan(Q[name](spark, SF_SMALL))
        # before adaptive execution; the fixture's union of two versions is two scans of one table
        assert len(re.findall(r"\) Scan parquet", p)) <= 10, name
