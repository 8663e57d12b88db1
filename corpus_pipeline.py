"""A corpus pipeline of five stages over ``documents``.

Each stage takes what the one before kept, and its decisions take effect: documents that the
toxicity and language stages reject go, one document of each near-duplicate class stays,
documents that contain a benchmark item go, and the last stage says how often the mix takes each
document that is left.  Between stages the rows are written as Parquet to the shared folder that
``spark.checkpoint.dir`` names, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import decontaminate, lang_id, mixing, order_minhash, toxicity
from ledgerflow.llm.common import crc_mod
from ledgerflow.session import ensure_checkpoint_dir
from ledgerflow.sources.driver import read_table

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not predicted toxic."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose text is in one of the learned languages."""
    return lang_id.keep_known(docs, crc_mod(F.col("doc_id"), 3) != 1)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    return order_minhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, sources weighted 5, 2, 1 in turn."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near_duplicates", keep_one_of_each_class),
          ("decontamination", drop_benchmark_leaks), ("mixing", mix)]

#: Trained models decide in the first two stages, which SQL cannot express; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
