"""The corpus pipeline: quality, exact copies, near copies, benchmark passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which the next stage gets back from Parquet as ``docs``.
All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import decontaminate, exact_dedup, packing, quality_fm, simhash
from churnlens.llm.common import table
from churnlens.llm.queries import GOOD_FROM, MAX_BITS, SHINGLE_WORDS, WINDOW
from churnlens.session import checkpoint_dir, remove_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_fm.keep_good(docs, table(spark, sf_dir, "labels"), threshold=GOOD_FROM)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs, words=SHINGLE_WORDS, max_bits=MAX_BITS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=WINDOW)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_benchmark), ("packing", pack_documents)]
#: Model scores and tokens can't be had from SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's folder goes once the next stage has written its own; the last one stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs
