"""A training-corpus pipeline: each stage works on all rows that the one before kept, from Parquet to Parquet.

Language ID drops documents without a language, SimHash keeps one document of each group of near-duplicates, benchmark
decontamination drops contaminated documents, the secret scan masks owner-specific secrets, and the last stage encodes
what is left with SentencePiece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import bounded_batches, materialize, read, small_batches
from threadloom.llm.decontaminate import drop_contaminated
from threadloom.llm.langid import keep_identified
from threadloom.llm.pieces import round_trips
from threadloom.llm.secrets import mask_live
from threadloom.llm.simhash import keep_first

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_identified(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mask_live(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trips(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: Language models, fingerprints and piece ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    with bounded_batches(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
