"""Judges: blinded rankings and constraint checks over workflow results, in long form; wide tables only at the sink."""

from __future__ import annotations

import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.batches import Batches, Step, chained, pieces
from threadloom.functions.outputs import ranking_verdict, violations
from threadloom.operators.report import unmask
from threadloom.plans.workflow import Catalogue
from threadloom.sources.clients import TextClient, asking, completed
from threadloom.tables import stored

RANK_FORM = (
    'Answer with one JSON object between <result> and </result>: {"ranking": [names, best first], '
    '"rationale": why, "correct_models": [names whose output is correct]}.'
)
CONSTRAINT_FORM = (
    "Answer with one JSON object between <result> and </result> that maps each violated constraint's id "
    "(CATEGORY.Main.Sub) to an explanation; {} if there are no violations."
)
SKIPPED, UNPARSED, NOT_JUDGED = "Judge Skipped/Failed", "ERROR: Judge Parse Failed", "Not Judged (Input Error)"


def masks(inputs: DataFrame, seed: int) -> DataFrame:
    """inputs' valid rows with mask: MODEL_A to MODEL_Z, MODEL_AA, ... to MODEL_ZZ, by the MD5 of seed, sample and model;
    models are few per sample."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), "model"))
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(drawn, "model")) - 1
    first = F.when(place >= 26, F.char(F.floor(place / 26) + 64)).otherwise("")
    return inputs.where("valid").withColumn("mask", F.concat(F.lit("MODEL_"), first, F.char(place % 26 + 65)))


def ranking_prompts(samples: DataFrame, masked: DataFrame, directive: str, text: str = "formatted_context") -> DataFrame:
    """(sample_id, prompt_text) for samples with two valid outputs or more; outputs appear under their masks."""
    shown = F.concat(F.lit("### "), F.col("mask"), F.lit("\n"), F.col("judge_input"))
    listed = masked.groupBy("sample_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mask", shown.alias("t")))), lambda s: s["t"]), "\n\n").alias("outputs"), F.count("*").alias("n")
    )
    joined = listed.where("n > 1").join(samples, "sample_id")
    parts = [F.lit(directive), F.lit("INPUT:"), F.coalesce(F.col(text), F.lit("")), F.lit("OUTPUTS:"), F.col("outputs"), F.lit(RANK_FORM)]
    return joined.select("sample_id", F.concat_ws("\n\n", *parts).alias("prompt_text"))


def constraint_prompts(samples: DataFrame, inputs: DataFrame, directive: str, text: str = "formatted_context") -> DataFrame:
    """(sample_id, model, prompt_text) for valid outputs."""
    joined = inputs.where("valid").join(samples, "sample_id")
    parts = [F.lit("CONSTRAINTS:"), F.lit(directive), F.lit("INPUT:"), F.coalesce(F.col(text), F.lit("")), F.lit("OUTPUT:"), F.col("judge_input"), F.lit(CONSTRAINT_FORM)]
    return joined.select("sample_id", F.col("model").alias("model_evaluated"), F.concat_ws("\n\n", *parts).alias("prompt_text"))


def _judged(asked: DataFrame, client: TextClient, read: Step, schema: str, answers: str | None) -> DataFrame:
    """What `read` makes of a judge's answers; in one Python worker a task, unless an answer table stands between."""
    if answers is None:
        return asked.mapInArrow(chained(asking(client), read), schema)
    return completed(asked, client, answers=answers).mapInArrow(read, schema)


def _ranked(batches: Batches) -> Batches:
    names = pa.list_(pa.string())
    kinds = {"ranking": names, "rationale": pa.string(), "correct_models": names}
    for piece in pieces(batches):
        found = [ranking_verdict(t) for t in piece["raw"].to_pylist()]
        read = [pa.array([v[k] for v in found], kind) for k, kind in kinds.items()]
        yield pa.RecordBatch.from_arrays([piece["sample_id"], piece["raw"], *read], ["sample_id", "raw", *kinds])


def judge_rankings(samples: DataFrame, inputs: DataFrame, client: TextClient, judge: str, directive: str, seed: int, text: str = "formatted_context", answers: str | None = None) -> DataFrame:
    """(sample_id, model, mask, rank, correct, judge_status, judge_rationale, judge_raw_output, input_length).

    correct is null where the judge did not say; judge_status says why. Names in the rationale are the models' own.
    """
    masked = stored(masks(inputs, seed), "masks")
    asked = ranking_prompts(samples, masked, directive, text).withColumn("model", F.lit(judge))
    schema = "sample_id long, raw string, ranking array<string>, rationale string, correct_models array<string>"
    verdicts = stored(_judged(asked, client, _ranked, schema, answers), "verdicts")
    ranks = unmask(verdicts.where("ranking is not null").select("sample_id", "ranking"), masked.select("sample_id", "mask", "model"))
    names = masked.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.length("mask").alias("n"), "mask", "model"))).alias("names"))
    plain = F.aggregate(F.reverse("names"), F.col("rationale"), lambda t, m: F.replace(t, m["mask"], m["model"]))
    told = verdicts.join(names, "sample_id").select("sample_id", "raw", "correct_models", plain.alias("judge_rationale"))
    rows = inputs.select("sample_id", "model", "valid").join(masked.select("sample_id", "model", "mask"), ["sample_id", "model"], "left")
    rows = rows.join(told, "sample_id", "left").join(ranks, ["sample_id", "model"], "left")
    correct = F.when(F.col("valid"), F.array_contains("correct_models", F.col("mask")))
    status = F.when(~F.col("valid"), NOT_JUDGED).when(F.col("raw").isNull(), SKIPPED).when(F.col("correct_models").isNull(), UNPARSED)
    lengths = samples.select("sample_id", F.length(text).alias("input_length"))
    return rows.join(lengths, "sample_id").select(
        "sample_id",
        "model",
        "mask",
        F.coalesce("rank", F.lit(-1)).alias("rank"),
        correct.alias("correct"),
        status.alias("judge_status"),
        F.coalesce("judge_rationale", F.when(F.col("raw").isNotNull(), "ERROR: Rationale not parsed").otherwise(SKIPPED)).alias("judge_rationale"),
        F.coalesce("raw", F.lit(SKIPPED)).alias("judge_raw_output"),
        "input_length",
    )


def _violated(batches: Batches) -> Batches:
    kind = pa.map_(pa.string(), pa.string())
    for piece in pieces(batches):
        found = [v if v is None else list(v.items()) for v in map(violations, piece["raw"].to_pylist())]
        columns = [piece["sample_id"], piece["model_evaluated"], piece["raw"], pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays(columns, ["sample_id", "model", "raw", "violated"])


def judge_constraints(samples: DataFrame, inputs: DataFrame, client: TextClient, judge: str, directive: str, text: str = "formatted_context", answers: str | None = None) -> DataFrame:
    """(sample_id, model, violated_constraints, violation_count, judge_raw_output, judge_input, input_length).

    violated_constraints is a map of id to explanation; violation_count is -1 where there is none to count.
    """
    asked = constraint_prompts(samples, inputs, directive, text).withColumn("model", F.lit(judge))
    found = _judged(asked, client, _violated, "sample_id long, model string, raw string, violated map<string,string>", answers)
    lengths = samples.select("sample_id", F.length(text).alias("input_length"))
    joined = inputs.join(found, ["sample_id", "model"], "left").join(lengths, "sample_id")
    return joined.select(
        "sample_id",
        "model",
        F.col("violated").alias("violated_constraints"),
        F.when(F.col("violated").isNull(), -1).otherwise(F.size("violated")).alias("violation_count"),
        F.coalesce("raw", F.lit(SKIPPED)).alias("judge_raw_output"),
        "judge_input",
        "input_length",
    )


def wide(long: DataFrame, results: DataFrame, catalogue: Catalogue, models: list[str], run: dict[str, str | int]) -> DataFrame:
    """One row per sample for files: rank_/correct_ columns per model, raw_/validated_output_ per task and model,
    version_ per task, and the run's own columns. The pivots' values are given, so no pass looks for them."""
    flag = F.coalesce(F.col("correct").cast("string"), "judge_status")
    verdicts = long.groupBy("sample_id").agg(
        F.first("judge_raw_output").alias("judge_raw_output"),
        F.first("judge_rationale").alias("judge_rationale"),
        F.first("input_length").alias("input_length"),
        *(F.coalesce(F.max(F.when(F.col("model") == m, F.col("rank"))), F.lit(-1)).alias(f"rank_{m}") for m in models),
        *(F.max(F.when(F.col("model") == m, flag)).alias(f"correct_{m}") for m in models),
    )
    tasks = [t for t in catalogue.prompts]
    outputs = results.groupBy("sample_id").agg(
        *(
            F.coalesce(F.max(F.when((F.col("model") == m) & (F.col("task") == t), c)), F.lit("N/A")).alias(f"{name}_{t}_{m}")
            for m in models
            for t in tasks
            for name, c in (("raw_output", F.col("raw")), ("validated_output", F.coalesce("value", "error")))
        )
    )
    versions = {f"version_{t}": F.lit(catalogue.version(t)) for t in tasks}
    return verdicts.join(outputs, "sample_id", "left").withColumns(versions | {k: F.lit(v) for k, v in run.items()})


def effective_seed(given: int | None, runs: DataFrame | None, now: float | None = None) -> int:
    """The seed of a refinement run: the given one; else, if the last run (by run_id) has violations or its judge failed,
    that run's; else a new one from the clock. RuntimeError if earlier runs can't tell."""
    fresh = int(time.time() if now is None else now)
    if given is not None:
        return given
    if runs is None:
        return fresh
    if missing := {"run_id", "seed", "violation_count"} - set(runs.columns):
        raise RuntimeError(f"earlier runs lack {', '.join(sorted(missing))}")
    last = runs.agg(F.max_by(F.struct("seed", "violation_count"), "run_id").alias("l")).first().l
    if last is None or last.seed is None or last.violation_count is None:
        raise RuntimeError("earlier runs hold no seed")
    return fresh if last.violation_count == 0 else int(last.seed)


def default_directive(workflow, catalogue: Catalogue, named: str | None = None) -> tuple[str, str]:
    """(prompt name, text) that a judge goes by: the named one, or that of the only task in the last stage."""
    if named is None:
        tasks = max(workflow, key=lambda s: s.number).tasks
        if len(tasks) != 1:
            raise ValueError("name a judge prompt: the last stage has several tasks")
        named = tasks[0].prompt
    if named not in catalogue.prompts:
        raise ValueError(f"prompt {named} is unknown")
    return named, catalogue.prompts[named][0]
