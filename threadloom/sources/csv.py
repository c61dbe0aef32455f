"""CSV files with quoted newlines, and the evaluation inputs made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.authors import seeded_sample
from threadloom.sources.ndjson import matching

CONTEXT = "formatted_context"


def read_csv(spark: SparkSession, path: str | list[str], infer: bool = False) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", infer)
    return reader.csv(path)


def read_contexts(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """All CSVs in a folder that have a formatted_context column, as one frame; ValueError if none has."""
    frames = [read_csv(spark, p) for p in matching(spark, folder, pattern)]
    usable = [f for f in frames if CONTEXT in f.columns]
    if not usable:
        raise ValueError(f"no file in {folder} has a column {CONTEXT}")
    out = usable[0]
    for frame in usable[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def sampled_contexts(frame: DataFrame, n: int, seed: int) -> DataFrame:
    """sample_id (from 0) and formatted_context of n seeded rows; fewer rows are all taken.

    Inputs that repeat count as often as they come: the rows of a text are numbered, and text and number are drawn.
    """
    if CONTEXT not in frame.columns:
        raise ValueError(f"the input lacks the column {CONTEXT}")
    times = frame.where(F.col(CONTEXT).isNotNull()).groupBy(CONTEXT).agg(F.count("*").alias("times"))
    every = times.select(CONTEXT, F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(n).cast("long")))).alias("copy"))
    picked = seeded_sample(every, [CONTEXT, "copy"], n, seed)
    rows = [(i, r[0]) for i, r in enumerate(picked.collect())]  # n rows at most
    return frame.sparkSession.createDataFrame(rows, f"sample_id long, {CONTEXT} string")
