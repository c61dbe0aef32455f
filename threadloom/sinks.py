"""Writers: Parquet, NDJSON, CSV with sorted columns, appended runs, one partition per user, result names."""

from __future__ import annotations

from datetime import datetime
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.expr import safe_name


def write_parquet(df: DataFrame, path: str, schema: T.StructType | None = None, mode: str = "errorifexists") -> None:
    (df.to(schema) if schema else df).write.mode(mode).parquet(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns in alphabetical order, with a header; quotes are doubled, so newlines in values come back."""
    df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def append_run(df: DataFrame, path: str) -> None:
    """Add rows of a run to a Parquet folder; rows carry run_id, which orders runs."""
    if "run_id" not in df.columns:
        raise ValueError("rows of a run need a run_id")
    df.write.mode("append").parquet(path)


def write_by_user(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per user; folder names keep letters and digits, and a hash follows where users would share one."""
    named = df.withColumn("user_dir", safe_name(F.col("user")))
    shared = named.groupBy("user_dir").agg(F.min("user").alias("_first"), F.max("user").alias("_last")).where("_first <> _last").select("user_dir", F.lit(True).alias("_shared"))
    own = F.when(F.col("_shared"), F.concat_ws("-", "user_dir", F.substring(F.sha2("user", 256), 1, 12))).otherwise(F.col("user_dir"))
    named.join(shared, "user_dir", "left").withColumn("user_dir", own).drop("_shared").write.mode(mode).partitionBy("user_dir").parquet(path)


def sanitize_name(name: str) -> str:
    return name.replace("/", "_")


def result_name(
    folder: str, prefix: str, workflow: str, judge: str, prompt: str, data: str, seed: int | None = None, append: bool = False, now: datetime | None = None
) -> str:
    """Path of a result file. Appended files carry neither seed nor time; others need a seed."""
    core = f"{prefix}_workflow-{workflow}_judge-{sanitize_name(judge)}_prompt-{prompt}_input-{data}"
    if not append:
        if seed is None:
            raise ValueError("a result file of its own needs a seed")
        core += f"_seed_{seed}_{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}"
    return str(PurePosixPath(folder) / f"{core}.csv")
