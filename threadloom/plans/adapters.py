"""Views of the test tables in the library's own shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1420070400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as comments: turn t replies to turn (t - 1) div 2, so threads branch."""
    turns = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    parent = F.expr("(turn - 1) div 2").cast("string")
    return turns.select(
        F.concat_ws("_", conv, turn.cast("string")).alias("id"),
        F.col("role").alias("author"),
        F.concat(F.lit("t3_"), conv).alias("link_id"),
        F.when(turn == 0, F.concat(F.lit("t3_"), conv)).otherwise(F.concat(F.lit("t1_"), conv, F.lit("_"), parent)).alias("parent_id"),
        F.col("text").alias("body"),
        (F.lit(EPOCH) + F.col("conv_id") * 86400 + turn * 60).alias("created_utc"),
        "conv_id",
        "turn",
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission for each conversation but those that end in 9."""
    first = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 10 <> 9")
    return first.select(
        F.col("conv_id").cast("string").alias("id"),
        F.concat(F.lit("sub"), (F.col("conv_id") % 7).cast("string")).alias("subreddit"),
        F.substring("text", 1, 40).alias("title"),
        F.lit("").alias("selftext"),
        F.lit(True).alias("is_self"),
        F.lit("system").alias("author"),
        (F.lit(EPOCH) + F.col("conv_id") * 86400).alias("created_utc"),
    )


def authored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("author"),
        F.col("lang").alias("subreddit"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("created_utc"),
        (F.col("n_chars") / 4).alias("token_count_approx"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("author"), "event_id", "ts", "props")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as judged outputs: the language is the model, labelled rows are ranked."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labelled = F.col("quality").isNotNull()
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("sample_id"),
        F.col("lang").alias("model"),
        F.when(labelled, 1 + F.col("doc_id") % 3).otherwise(-1).cast("int").alias("rank"),
        (F.col("quality") == 1).alias("correct"),
        F.col("n_chars").alias("input_length"),
        F.when(labelled, F.col("doc_id") % 3).otherwise(-1).cast("int").alias("violation_count"),
    )
