"""From raw documents to tokens: quality, line dedup, near-dedup, decontamination, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the documents table, each on
what its predecessor wrote.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, line_chunks, neardup, quality, sp_encode
from corpusgraph.llm._common import delete_folder, shared_folder, table
from corpusgraph.llm.queries import piece_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and repeated runs of lines removed from the texts; n_chars follows."""
    out = line_chunks.remove_repeated(docs, run_words=line_chunks.RUN_WORDS)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and the digests of the ids and of the text decoded from them."""
    return sp_encode.encode_digests(docs, piece_model())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: Signatures, tilings and byte-pair merges are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of ``sf_dir``, each written as Parquet in the shared folder and read again.

    A stage's table is deleted when its successor is written; the last one is left to who reads the result.
    """
    docs, base, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", ""
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if before:
            delete_folder(spark, before)
        before = f"{base}/{i}"
    return STAGES[-1][1](spark, docs, sf_dir)
