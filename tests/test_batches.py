"""What a task's Python holds at once: pieces of Spark's batches, in one worker for all steps of a stage."""

import json

import pyarrow as pa
import pytest

from threadloom.plans import judging
from threadloom.plans.workflow import WORKFLOWS, Catalogue, judge_inputs, run_workflow
from threadloom.sources.clients import StubClient, completed

PROMPTS = {"inference": ("Infer.", "v1"), "intent_only": ("Intents.", "v1")}
MOST = 256


def test_pieces():
    from threadloom.functions.batches import pieces

    texts = ["a" * n for n in (10, 10, 5000, 10, 10, 10, 900, 900, 900)] + [None]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    got = list(pieces(iter([batch, batch.slice(0, 0), batch.slice(7)]), rows=4, size=1000))
    assert [t for p in got for t in p["t"].to_pylist()] == texts + texts[7:]
    assert all(0 < p.num_rows <= 4 and (p.nbytes <= 1000 or p.num_rows == 1) for p in got)


def counted():
    """A formatter and a client that answers how many inputs were made in its process and not yet asked, its own included."""
    made, asked = [], []

    def formatter(inputs: dict) -> str:
        made.append(1)
        return "x"

    def answer(model: str, text: str) -> str:
        if text.startswith("Infer."):
            return '<result>{"inference_output": "x"}</result>'
        asked.append(1)
        return f'<result>{{"intents": ["{len(made) - len(asked) + 1}"]}}</result>'

    return formatter, StubClient(answer)


@pytest.mark.parametrize("chars", [10, 40_000])
def test_inputs_are_made_as_they_are_asked(spark, chars):
    samples = spark.range(2400).selectExpr("id AS sample_id", f"repeat('y', {chars}) AS formatted_context")
    formatter, client = counted()
    results = run_workflow(samples, ["m"], WORKFLOWS["inference_with_intent"], Catalogue(PROMPTS, formatters={"intent_only": formatter}), client)
    ahead = [int(json.loads(r.value)["intents"][0]) for r in results.where("stage = 2").select("value").collect()]
    assert len(ahead) == 2400 and min(ahead) > 0
    assert max(ahead) <= (MOST if chars < 1000 else (4 << 20) // chars)


def test_answer_tables_give_the_same_results(spark, tmp_path):
    samples = spark.createDataFrame([(i, "x" * i if i else None) for i in range(9)], "sample_id long, formatted_context string")

    def answer(model: str, text: str) -> str:
        if "OUTPUTS:" in text:
            return '<result>{"ranking": ["MODEL_B", "MODEL_A"], "correct_models": ["MODEL_B"]}</result>'
        if "OUTPUT:" in text:
            return '<result>{"A.1.1": "é"}</result>'
        if len(text) % 4 == 0:
            raise ValueError("refused")
        return '<result>{"intents": ["a"], "koa": ["b"], "inference_output": "c"}</result>'

    def run(folder):
        stages, client = WORKFLOWS["concurrent_intent_koa"], StubClient(answer)
        results = run_workflow(samples, ["m1", "m2"], stages, Catalogue(PROMPTS | {"koa_only": ("Know.", "v2")}), client, answers=folder)
        inputs = judge_inputs(results, stages)
        ranks = judging.judge_rankings(samples, inputs, client, "j", "Rank.", 3, answers=folder)
        broken = judging.judge_constraints(samples, inputs, client, "j", "Be brief.", answers=folder)
        return [sorted(map(str, df.collect())) for df in (results, ranks, broken)]

    direct = run(None)
    assert direct == run(str(tmp_path / "answers")) and len(direct[0]) == 36 and "'A.1.1': 'é'" in "".join(direct[2])


def test_columns_come_through(spark):
    rows = spark.sql("SELECT id, IF(id = 1, NULL, 9007199254740993 + id) AS big, timestamp_micros(id) AS at, array(named_struct('k', id)) AS deep, 'm' AS model, IF(id = 2, NULL, 'p') AS prompt_text FROM range(3)")
    got = completed(rows, StubClient(lambda m, t: m + t))
    kept = got.drop("raw", "error")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.collect()))
    assert {r.id: r.raw for r in got.collect()} == {0: "mp", 1: "mp", 2: None}
