"""Newline-delimited JSON dumps into typed tables: tolerant reads, row-level rejects, a Parquet cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def matching(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """All paths that a glob matches, sorted; FileNotFoundError without any."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    paths = sorted(status.getPath().toString() for status in found or ())
    if not paths:
        raise FileNotFoundError(f"nothing matches {pattern} in {folder}")
    return paths


def read_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Raw rows of NDJSON files, compressed or not: every column as text, and _corrupt for lines that are no JSON.

    Blank lines are skipped and bad UTF-8 bytes are replaced. Files ending in .zst go through the long-window reader,
    one task a file, and are dealt out again behind it; one that breaks off gives a line in _corrupt that says so.
    """
    raw = T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(CORRUPT, T.StringType())])
    # The text reader keeps bytes as they are; U+FFFD takes the place of those that are no UTF-8.
    parsed = F.from_json(F.call_function("make_valid_utf8", F.col("line")), raw, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return _lines(spark, [paths] if isinstance(paths, str) else list(paths)).select(parsed.alias("r")).select("r.*")


def lines_of(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The lines, valid UTF-8, of all files that a glob matches."""
    return _lines(spark, matching(spark, folder, pattern)).select(F.call_function("make_valid_utf8", F.col("line")).alias("line"))


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    squeezed, plain = [p for p in paths if p.endswith(".zst")], [p for p in paths if not p.endswith(".zst")]
    parts = []
    if plain:
        parts.append(spark.read.text(plain).select(F.col("value").alias("line")).where(F.trim("line") != ""))
    if squeezed:
        from threadloom.sources.zstd_source import read_zst_lines

        parts.append(read_zst_lines(spark, squeezed).repartition(max(len(squeezed), spark.sparkContext.defaultParallelism)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _cast(name: str, kind: T.DataType):
    value = F.col(name)
    if isinstance(kind, T.LongType):
        return F.coalesce(value.try_cast("bigint"), F.when(value.rlike(r"^-?\d+\.0+$"), F.regexp_replace(value, r"\.0+$", "").try_cast("bigint")))
    if isinstance(kind, T.BooleanType):
        return F.lower(value).try_cast("boolean")
    if isinstance(kind, T.StringType):
        return value
    return value.try_cast(kind)


def flag_or_time(value):
    """A flag that may hold a time: false, true or an integer, as text."""
    return F.regexp_replace(F.lower(value), r"\.0+$", "")


def conform(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """raw with exactly the schema's columns, in order: missing ones null, extra ones gone, uncastable values null.

    The column _rejected says why a row can't stay: a line that is no JSON, or a required column without a value.
    """
    present = set(raw.columns)
    columns = [(_cast(f.name, f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    if "edited" in present and "edited" in schema.names:
        columns[schema.names.index("edited")] = flag_or_time(F.col("edited")).alias("edited")
    corrupt = F.col(CORRUPT) if CORRUPT in present else F.lit(None).cast("string")
    typed = raw.select(*columns, corrupt.alias(CORRUPT))
    required = [F.when(F.col(f.name).isNull(), F.lit(f"no {f.name}")) for f in schema.fields if not f.nullable]
    reason = F.coalesce(F.when(F.col(CORRUPT).isNotNull(), F.lit("not JSON")), *required, F.lit(None).cast("string"))
    return typed.withColumn("_rejected", reason)


def split(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and rejects with their reason."""
    return conformed.where("_rejected is null").drop("_rejected", CORRUPT), conformed.where("_rejected is not null")


def read_ndjson(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Typed rows of all files that the glob matches; rejects are left out."""
    kept, _ = split(conform(read_lines(spark, matching(spark, folder, pattern), schema), schema))
    return kept.select(*columns) if columns else kept


def _readable(spark: SparkSession, rows: str, rejects: str, schema: T.StructType) -> bool:
    """Whether a cache is whole: both tables committed, footers readable, the schema's columns and types in the rows."""
    if not all(_exists(spark, f"{p}/_SUCCESS") for p in (rows, rejects)):
        return False
    try:
        got = {f.name: f.dataType for f in spark.read.option("mergeSchema", "true").parquet(rows).schema.fields}
    except Exception:  # noqa: BLE001  (a broken footer comes as one of several JVM errors)
        return False
    return got == {f.name: f.dataType for f in schema.fields}


def ensure_parquet_cache(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, cache: str) -> DataFrame:
    """The typed table behind a glob, from its Parquet cache where that is whole, else built now.

    Every match is ingested, sorted, and parsed once: all rows go to a staging table, from which `cache`/rows and
    `cache`/rejects are written. A cache without Spark's _SUCCESS marks, with a broken footer or with another schema is
    deleted and built anew. A source without rows gives an empty table of the schema.
    """
    rows, rejects, staged = (f"{cache.rstrip('/')}/{name}" for name in ("rows", "rejects", "staged"))
    if not _readable(spark, rows, rejects, schema):
        conformed = conform(read_lines(spark, matching(spark, folder, pattern), schema), schema)
        conformed.write.mode("overwrite").parquet(staged)
        kept, rejected = split(spark.read.schema(conformed.schema).parquet(staged))
        kept.write.mode("overwrite").parquet(rows)
        rejected.write.mode("overwrite").parquet(rejects)
        target = spark._jvm.org.apache.hadoop.fs.Path(staged)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    got = spark.read.parquet(rows)  # count_cached() tells how many
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    return got.to(nullable)


def count_cached(spark: SparkSession, cache: str) -> tuple[int, int]:
    """Rows and rejects of a cache, by the footers of its files."""
    return tuple(spark.read.parquet(f"{cache.rstrip('/')}/{name}").count() for name in ("rows", "rejects"))
