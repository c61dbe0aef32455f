"""Answers of text models, kept under a hash of model and prompt: each different prompt is asked once, in all runs."""

from __future__ import annotations

import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from threadloom.functions.batches import Batches, pieces
from threadloom.sources.clients import MISSING, TextClient, answer
from threadloom.tables import delete, exists, stored

SCHEMA = "answer_key string, raw string"
#: Prompts that a task asks before it writes their answers down.
NOTED = 64


def _store(path: str):
    """The file system behind a URI or a local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if ":" in path else f"file://{path}")


def _note(folder: str, keys: list[str], got: list[tuple[str | None, str | None]]) -> None:
    """Write answers, not errors, into a file of their own, which appears whole or not at all."""
    lines = "".join(json.dumps({"answer_key": k, "raw": raw}) + "\n" for k, (raw, _) in zip(keys, got, strict=True) if raw is not None)
    if lines:
        files, at = _store(folder)
        files.create_dir(at, recursive=True)
        name = hashlib.sha256("".join(keys).encode()).hexdigest()
        hidden = f"{at}/_{name}-{uuid.uuid4().hex}"
        with files.open_output_stream(hidden) as out:
            out.write(lines.encode())
        files.move(hidden, f"{at}/{name}.json")


def _noted(folder: str, keys: list[str]) -> dict[str, str]:
    """Answers that an earlier attempt of the task has written down for just these prompts."""
    files, at = _store(folder)
    path = f"{at}/{hashlib.sha256(''.join(keys).encode()).hexdigest()}.json"
    if not files.get_file_info(path).is_file:
        return {}
    with files.open_input_stream(path) as held:
        return {r["answer_key"]: r["raw"] for r in map(json.loads, held.read().decode().splitlines())}


def _read(spark: SparkSession, table: str, notes: str) -> DataFrame:
    """Answers of the table and of notes that a run which did not end has left."""
    known = spark.createDataFrame([], SCHEMA)
    if exists(spark, table):
        try:
            known = spark.read.schema(SCHEMA).parquet(table)
        except AnalysisException:  # a folder without files yet
            pass
    if exists(spark, notes):
        known = known.unionByName(spark.read.schema(SCHEMA).json(notes))
    return known.dropDuplicates(["answer_key"])


def answered(rows: DataFrame, client: TextClient, path: str, model: str = "model", text: str = "prompt_text", threads: int = 16) -> DataFrame:
    """rows with raw and error, as completed(), from the answer table in the folder `path`.

    Different (model, prompt) pairs that the table lacks are asked once, whatever the number of rows that hold them, and
    their answers are appended in one commit. Errors are results of this run only and are asked anew by the next. While
    they ask, tasks write answers down in blocks; a retried task reads its blocks, and the next run those of one that
    did not end. Asking happens at once, not when the result is read. One run at a time may write to a table.
    """
    spark = rows.sparkSession
    table, notes = f"{path.rstrip('/')}/answers", f"{path.rstrip('/')}/notes"
    name, prompt = F.coalesce(F.col(model), F.lit("")), F.col(text)
    key = F.when(prompt.isNotNull(), F.sha2(F.concat(F.length(name).cast("string"), F.lit(":"), name, prompt), 256))
    keyed = stored(rows.drop("raw", "error").withColumn("answer_key", key), "keyed")
    known = stored(_read(spark, table, notes), "answers-known")
    asked = keyed.where("answer_key is not null").groupBy("answer_key").agg(F.first(model).alias("model"), F.first(text).alias("text"))
    asked = stored(asked.join(known, "answer_key", "left_anti"), "answers-asked")

    def run(batches: Batches) -> Batches:
        with ThreadPoolExecutor(threads) as pool:
            for part in pieces(batches, NOTED):
                keys, models, texts = (part[c].to_pylist() for c in ("answer_key", "model", "text"))
                held = _noted(notes, keys)
                one = lambda r: (held[r[0]], None) if r[0] in held else answer(client, r[1], r[2])  # noqa: B023, E731
                got = list(pool.map(one, zip(keys, models, texts, strict=True)))
                _note(notes, keys, got)
                found = [keys, [g[0] for g in got], [g[1] for g in got]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in found], ["answer_key", "raw", "error"])

    fresh = stored(asked.mapInArrow(run, "answer_key string, raw string, error string"), "answers-fresh")
    new = fresh.where("raw is not null").select("answer_key", "raw")
    if exists(spark, notes):
        new = new.union(spark.read.schema(SCHEMA).json(notes)).dropDuplicates(["answer_key"])
    committed = spark.read.schema(SCHEMA).parquet(table).select("answer_key") if exists(spark, table) else spark.createDataFrame([], "answer_key string")
    new.join(committed, "answer_key", "left_anti").write.mode("append").parquet(table)
    delete(spark, notes)
    every = known.select("answer_key", "raw", F.lit(None).cast("string").alias("error")).union(fresh)
    joined = keyed.join(every, "answer_key", "left").drop("answer_key")
    return joined.withColumn("error", F.when(F.col(text).isNull(), F.lit(MISSING)).otherwise(F.col("error")))
