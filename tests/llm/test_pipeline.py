"""The corpus pipeline against its stages done in plain Python."""

import corpus_pipeline
import public_tokenizers
from churnlens.llm import decontaminate, quality_fm
from test_exact_dedup import sha
from test_simhash import plain_components, plain_fingerprint
from test_tokens_and_packing import check_pieces

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and public_tokenizers.path("word_bpe_49k.json")


def test_run_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality_fm.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in good)
    first = {}
    for i, t in rows:
        first.setdefault(sha(t), i)
    rows = [(i, t) for i, t in rows if first[sha(t)] == i]
    items = [(i, plain_fingerprint(t)) for i, t in rows]
    rows = [r for r, c in zip(rows, plain_components(items), strict=True) if r[0] == c]
    words = lambda t: " " + " ".join(decontaminate.WORDS(t.lower())) + " "
    tests = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(x in words(t) for x in tests)]
    check_pieces(corpus_pipeline.run(spark, SF).collect(), rows, 2048)


def test_every_stage_keeps_the_columns_and_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns and stage(spark, docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
