"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset, a temporary folder of our own."""
    if where := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return where.rstrip("/")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path of any store that Spark reads."""
    files, target = _at(spark, path)
    return files.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    files, target = _at(spark, path)
    files.delete(target, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def counted(df: DataFrame, name: str, **what: Column) -> tuple[DataFrame, dict[str, int]]:
    """stored(df, name), and aggregates over its rows that the write itself takes, so that no job reads it for them."""
    seen = Observation()
    return stored(df.observe(seen, *(c.alias(k) for k, c in what.items())), name), seen.get
