"""Schemas of NDJSON files from all their lines: a lattice of types, folded in the tasks and merged in a tree.

null < boolean < string and null < long < double < string; arrays merge by element, objects by field, and what does not
fit together is a string. Merging is commutative and associative, so any split of the lines gives the same schema.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.sources.ndjson import lines_of

#: Partial schemas that come to the driver.
LAST = 32
_LONG = 1 << 63

# A type is "null", "boolean", "long", "double", "string", ["array", type] or {"field": type, ...}.
Kind = str | list | dict


def kind_of(value) -> Kind:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long" if -_LONG <= value < _LONG else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, list):
        out: Kind = "null"
        for v in value:
            out = join(out, kind_of(v))
        return ["array", out]
    if isinstance(value, dict):
        return {k: kind_of(v) for k, v in value.items()}
    return "string"


def join(a: Kind, b: Kind) -> Kind:
    """The least type that holds both."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: join(a.get(k, "null"), b.get(k, "null")) for k in a.keys() | b.keys()}
    if isinstance(a, list) and isinstance(b, list):
        return ["array", join(a[1], b[1])]
    return "double" if a in ("long", "double") and b in ("long", "double") else "string"


def spark_type(kind: Kind) -> T.DataType:
    """Fields in alphabetical order; what held nulls alone is a string, and so is an object without fields."""
    if isinstance(kind, dict):
        return T.StructType([T.StructField(k, spark_type(v)) for k, v in sorted(kind.items())]) if kind else T.StringType()
    if isinstance(kind, list):
        return T.ArrayType(spark_type(kind[1]))
    return {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType()}.get(kind, T.StringType())


def _fold_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind: Kind = "null"
    for batch in batches:
        for line in batch.column("line").to_pylist():
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                kind = join(kind, kind_of(value))
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(kind)])], names=["kind"])


def _fold_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind: Kind = "null"
    for batch in batches:
        for part in batch.column("kind").to_pylist():
            kind = join(kind, json.loads(part))
    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(kind)])], names=["kind"])


def inferred(lines: DataFrame, overrides: dict[str, T.DataType] | None = None) -> T.StructType:
    """The schema of a column `line` of JSON objects; lines that are none, which readers reject, do not count.

    `overrides` gives the types of top-level fields, and adds fields that no line has. Each task folds its lines into one
    partial schema; LAST tasks merge these, and what they make is merged here.
    """
    parts = lines.mapInArrow(_fold_lines, "kind string").repartition(LAST).mapInArrow(_fold_kinds, "kind string")
    kind: Kind = {}
    for r in parts.collect():
        kind = join(kind, json.loads(r.kind))
    fields = {f.name: f.dataType for f in spark_type(kind).fields} if kind else {}
    fields |= overrides or {}
    return T.StructType([T.StructField(name, fields[name]) for name in sorted(fields)])


def infer_schema(spark: SparkSession, folder: str, pattern: str, overrides: dict[str, T.DataType] | None = None) -> T.StructType:
    """inferred() over all files that a glob matches, compressed or not."""
    return inferred(lines_of(spark, folder, pattern), overrides)


def read_inferred(spark: SparkSession, folder: str, pattern: str, overrides: dict[str, T.DataType] | None = None) -> DataFrame:
    """Rows of all matching files by their inferred schema; lines that are no JSON object are left out, values that an
    override can't hold are null."""
    schema = infer_schema(spark, folder, pattern, overrides)
    if not schema.fields:
        return spark.createDataFrame([], schema)
    corrupt = "_corrupt_line"
    whole = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    lines = lines_of(spark, folder, pattern).where(F.ltrim("line").startswith("{"))
    parsed = lines.select("line", F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    return parsed.where(F.try_parse_json("line").isNotNull()).select(*(F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields))
