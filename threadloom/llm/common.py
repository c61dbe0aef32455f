"""Helpers that the training-data operators share: shared-folder tables, row numbers, table reads."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    where = context.getCheckpointDir()
    if not where:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def workdir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = workdir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialize()d table that no later plan reads."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialize()d tables that no later plan reads, and let Spark's cleaner drop shuffle files of finished plans.

    Spark cleans up behind objects that the driver has collected, which a busy driver may do after hours only. Python's
    references to them end in the background, so a second round finds what the first one let go.
    """
    for df in tables:
        drop_table(df)
    for _ in range(2):
        gc.collect()
        time.sleep(0.5)
        spark._jvm.System.gc()


#: Rows of an Arrow batch. Texts may be long, and both a batch and what is made of it are in memory at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of the session to BATCH_ROWS rows, unless it has a smaller bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """small_batches() for the jobs that run inside, and the session's own bound again behind them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of df has them; Spark's names know no case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone; all-ASCII texts take the cheap built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """Add `name`, a gapless global row number from 0 in the given order, and return the number of rows.

    Rows are range-partitioned, sorted within partitions and written once with their partition and their place in
    it; the per-partition counts (one row per partition, so bounded) become offsets. No window over all rows.
    """
    spark = df.sparkSession
    n = partitions(spark)
    placed = materialize(
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "numbered",
    )
    offsets, total = [], 0
    for part, count in sorted(placed.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += count
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    out = placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place"))
    return out.drop("_part", "_place", "_start"), total
