"""Staged text-model workflows as a chain of DataFrame steps over the long table (sample_id, model, task)."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.batches import Batches, Step, chained, pieces, table_of
from threadloom.functions.outputs import OUTPUT_FIELDS, parse_task
from threadloom.sources.clients import TextClient, asking, completed
from threadloom.tables import stored

log = logging.getLogger(__name__)

RAW = "__RAW_INPUT__"
RESULT_HINT = "\n\nPut the final answer between <result> and </result>."


@dataclass(frozen=True)
class Task:
    prompt: str
    inputs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Stage:
    number: int
    tasks: tuple[Task, ...]


Formatter = Callable[[dict], str]


@dataclass
class Catalogue:
    """Prompts (name: text, version), fields of outputs, and formatters for tasks with several inputs."""

    prompts: dict[str, tuple[str, str]]
    fields: dict[str, dict[str, str]] = field(default_factory=lambda: dict(OUTPUT_FIELDS))
    formatters: dict[str, Formatter] = field(default_factory=dict)

    def version(self, name: str) -> str:
        return self.prompts.get(name, ("", "N/A"))[1]


def _one(prompt: str) -> tuple[Stage, ...]:
    return (Stage(1, (Task(prompt, (RAW,)),)),)


# The known workflows. The first one names a prompt that catalogues do not hold, and so fails validation.
WORKFLOWS: dict[str, tuple[Stage, ...]] = {
    "serial_separation_inference": (*_one("separation"), Stage(2, (Task("inference", ("separation",)),))),
    "concurrent_intent_koa": (Stage(1, (Task("intent_only", (RAW,)), Task("koa_only", (RAW,)))),),
    "single_all_in_one": _one("all_in_one"),
    "single_intent_only": _one("intent_only"),
    "inference_only": _one("inference"),
    "koa_only": _one("koa_only"),
    "inference_with_intent": (*_one("inference"), Stage(2, (Task("intent_only", ("inference", RAW)),))),
}


def intent_with_inference(inputs: dict) -> str:
    """Input of an intent task that sees the raw data and what was inferred from it."""
    return f"{inputs.get(RAW, '')}\n\nINFERENCE:\n{json.dumps(inputs.get('inference'), ensure_ascii=False)}"


FORMATTERS: dict[str, Formatter] = {"intent_only": intent_with_inference}


def problems(workflow: tuple[Stage, ...], prompts) -> list[str]:
    """What makes a workflow invalid; empty if nothing does."""
    out = []
    numbers = sorted(s.number for s in workflow)
    if len(set(numbers)) < len(numbers):
        out.append("stage numbers repeat")
    elif numbers != list(range(1, len(numbers) + 1)):
        out.append("stage numbers do not run from 1 without gaps")
    if not workflow:
        out.append("there are no stages")
    made: set[str] = set()
    for stage in sorted(workflow, key=lambda s: s.number):
        if not stage.tasks:
            out.append(f"stage {stage.number} has no tasks")
        ids = [t.prompt for t in stage.tasks]
        for task in stage.tasks:
            if not task.prompt:
                out.append(f"a task of stage {stage.number} has no prompt")
                continue
            if ids.count(task.prompt) > 1 or task.prompt in made:
                out.append(f"task {task.prompt} comes more than once")
            if task.prompt not in prompts:
                out.append(f"prompt {task.prompt} is unknown")
            for name in task.inputs:
                if name == RAW or name in made:
                    continue
                if stage.number == 1:
                    log.warning("task %s of stage 1 asks for %s, which nothing makes", task.prompt, name)
                out.append(f"task {task.prompt} needs {name}, which no earlier stage makes")
        made |= set(ids)
    return list(dict.fromkeys(out))


def is_valid(workflow: tuple[Stage, ...], prompts) -> bool:
    return not problems(workflow, prompts)


def task_input(task: Task, raw: str | None, results: dict[str, tuple[str | None, str | None]], formatter: Formatter | None) -> tuple[str | None, str | None]:
    """(input text, None), or (None, error) for a task, from the raw input and earlier (value, error) results."""
    names = [n for n in task.inputs if n != RAW]
    if not task.inputs:
        return "", None
    if not names:
        return raw, None
    missing = [n for n in names if results.get(n, (None, None))[0] is None]
    if missing:
        return None, f"ERROR: Missing required inputs ({', '.join(missing)})"
    values = {n: json.loads(results[n][0]) for n in names}
    with_raw = {RAW: raw, **values} if RAW in task.inputs else values
    if formatter is not None:
        try:
            return formatter(with_raw), None
        except Exception as e:  # a formatter's failure is the task's result
            return None, f"ERROR: Formatter failed - {e}"
    if len(with_raw) == 1:
        return json.dumps(next(iter(values.values())), indent=2, ensure_ascii=False), None
    return None, f"ERROR: Ambiguous inputs for {task.prompt}: several inputs need a formatter"


PREPARED = "sample_id long, model string, stage int, task string, prompt_text string, blocked string, version string"
RESULTS = "sample_id long, model string, stage int, task string, prompt_text string, raw string, value string, error string, version string"


def run_workflow(samples: DataFrame, models: list[str], workflow: tuple[Stage, ...], catalogue: Catalogue, client: TextClient, text: str = "formatted_context", answers: str | None = None) -> DataFrame:
    """Long results (sample_id, model, stage, task, prompt_text, raw, value, error, version).

    Stages follow each other; all tasks of a stage run in one pass over samples x models. Every stage is written to the
    shared folder before the next, so answers are asked for once; `answers` is a folder of answers, see completed(). Inputs
    are made, asked and parsed piece by piece in one Python worker a task. ValueError for an invalid workflow.
    """
    if found := problems(workflow, catalogue.prompts):
        raise ValueError("; ".join(found))
    spark = samples.sparkSession
    model_rows = F.array(*map(F.lit, models))
    pairs = samples.select("sample_id", F.col(text).alias("raw_input")).withColumn("model", F.explode(model_rows))
    done: DataFrame | None = None
    for stage in sorted(workflow, key=lambda s: s.number):
        asked = pairs.withColumn("results", F.create_map().cast("map<string,struct<value:string,error:string>>"))
        if done is not None:
            earlier = done.groupBy("sample_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct("value", "error")))).alias("results"))
            asked = pairs.join(earlier, ["sample_id", "model"])
        prepare, parse = _prepare(stage, catalogue), _parse(catalogue)
        if answers is None:
            result = asked.mapInArrow(chained(prepare, asking(client), parse), RESULTS)
        else:
            result = completed(asked.mapInArrow(prepare, PREPARED), client, answers=answers).mapInArrow(parse, RESULTS)
        result = stored(result, f"workflow-{stage.number}")
        done = result if done is None else done.unionByName(result)
    return done if done is not None else spark.createDataFrame([], "sample_id long, model string")


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of longs, ints, booleans and strings."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, ddl.split(", "))])


def _prepare(stage: Stage, catalogue: Catalogue) -> Step:
    schema = _arrow(PREPARED)

    def prepare(batches: Batches) -> Batches:
        for piece in pieces(batches):
            rows = []
            for r in piece.to_pylist():
                results = {k: (v["value"], v["error"]) for k, v in r["results"] or []}
                for task in stage.tasks:
                    data, error = task_input(task, r["raw_input"], results, catalogue.formatters.get(task.prompt) if len(task.inputs) > 1 else None)
                    prompt, version = catalogue.prompts[task.prompt]
                    full = None if error or data is None else f"{prompt}\n\nINPUT DATA:\n---\n{data}\n---{RESULT_HINT}"
                    rows.append((r["sample_id"], r["model"], stage.number, task.prompt, full, error, version))
            yield table_of(rows, schema)

    return prepare


def _parse(catalogue: Catalogue) -> Step:
    """Answers as checked outputs; what blocked a task or failed it is its error."""
    schema, kept = _arrow(RESULTS), ("sample_id", "model", "stage", "task", "prompt_text", "raw")

    def parse(batches: Batches) -> Batches:
        for piece in pieces(batches):
            values, errors = [], []
            for r in piece.select(["task", "raw", "blocked", "error"]).to_pylist():
                first = r["blocked"] if r["blocked"] is not None else r["error"]
                value, error = (None, first) if first is not None else parse_task(r["raw"], catalogue.fields.get(r["task"]))
                values.append(value)
                errors.append(error)
            made = [pa.array(values, pa.string()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in kept), *made, piece["version"]], schema=schema)

    return parse


def judge_inputs(results: DataFrame, workflow: tuple[Stage, ...]) -> DataFrame:
    """(sample_id, model, judge_input, valid): what a judge sees of each model's final stage.

    One task: its output, JSON with indentation or bare text; several: one JSON object by task. If any failed, a text
    that starts with ERROR: and carries the details.
    """
    last = max(s.number for s in workflow)
    tasks = [t.prompt for s in workflow if s.number == last for t in s.tasks]
    final = results.where(F.col("stage") == last)
    grouped = final.groupBy("sample_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct("value", "error")))).alias("results"))

    shape = "sample_id long, model string, judge_input string, valid boolean"
    schema = _arrow(shape)

    def build(batches: Batches) -> Batches:
        for piece in pieces(batches):
            rows = []
            for r in piece.to_pylist():
                got = {k: (v["value"], v["error"]) for k, v in r["results"]}
                rows.append((r["sample_id"], r["model"], *final_text(tasks, got)))
            yield table_of(rows, schema)

    return grouped.mapInArrow(build, shape)


def final_text(tasks: list[str], got: dict[str, tuple[str | None, str | None]]) -> tuple[str, bool]:
    """(judge input, whether all final outputs are valid)."""
    shown, whole = {}, True
    for task in tasks:
        value, error = got.get(task, (None, None))
        if value is None:
            shown[task], whole = error or f"ERROR: Output missing for task '{task}'", False
        else:
            loaded = json.loads(value)
            shown[task] = loaded["task_output"] if set(loaded) == {"task_output"} else loaded
    if not whole:
        return "ERROR: One or more final stage outputs failed validation or parsing.\nDetails:\n" + json.dumps(shown, indent=2), False
    if len(tasks) == 1:
        only = shown[tasks[0]]
        return (only if isinstance(only, str) else json.dumps(only, indent=2, ensure_ascii=False)), True
    return json.dumps(shown, indent=2, ensure_ascii=False), True


__all__ = ["Catalogue", "FORMATTERS", "RAW", "Stage", "Task", "WORKFLOWS", "is_valid", "judge_inputs", "problems", "run_workflow", "task_input"]
