import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from threadloom.functions import outputs
from threadloom.plans import judging, similar_users
from threadloom.plans.queries import STUB_PROMPTS, stub_answer
from threadloom.plans.workflow import FORMATTERS, RAW, WORKFLOWS, Catalogue, Stage, Task, final_text, is_valid, judge_inputs, problems, run_workflow, task_input
from threadloom.sources.clients import StubClient


def test_known_workflows():
    assert {name for name, w in WORKFLOWS.items() if not is_valid(w, STUB_PROMPTS)} == {"serial_separation_inference"}


@pytest.mark.parametrize(
    ("workflow", "said"),
    [
        ((), "no stages"),
        ((Stage(1, (Task("inference"),)), Stage(1, (Task("koa_only"),))), "repeat"),
        ((Stage(1, (Task("inference"),)), Stage(3, (Task("koa_only"),))), "gaps"),
        ((Stage(1, ()),), "no tasks"),
        ((Stage(1, (Task("inference"), Task("inference"))),), "more than once"),
        ((Stage(1, (Task("inference", ("koa_only",)),)), Stage(2, (Task("koa_only"),))), "no earlier stage"),
        ((Stage(1, (Task("nothing"),)),), "unknown"),
        ((Stage(1, (Task(""),)),), "no prompt"),
    ],
)
def test_invalid_workflows(workflow, said):
    assert any(said in p for p in problems(workflow, STUB_PROMPTS))


def test_task_inputs():
    done = {"a": ('{"x": 1}', None), "b": ('{"y": 2}', None), "c": (None, "ERROR: x")}
    assert task_input(Task("t"), "raw", done, None) == ("", None)
    assert task_input(Task("t", (RAW,)), "raw", done, None) == ("raw", None)
    assert task_input(Task("t", ("a",)), "raw", done, None) == ('{\n  "x": 1\n}', None)
    assert "Ambiguous" in task_input(Task("t", ("a", "b")), "raw", done, None)[1]
    assert "Ambiguous" in task_input(Task("t", ("a", RAW)), "raw", done, None)[1]
    assert task_input(Task("t", ("a", RAW)), "raw", done, lambda d: f"{d[RAW]}{d['a']['x']}") == ("raw1", None)
    assert "Missing" in task_input(Task("t", ("c",)), "raw", done, None)[1]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1}', {"a": 1}),
        ("```json\n{'a': 'it\\'s', b: True,}\n```", {"a": "it's", "b": True}),
        ('Sure: {"a": [1, 2,], "b": {"c": null', {"a": [1, 2], "b": {"c": None}}),
        ("nothing here", None),
        ("", None),
        (None, None),
        ("[1, 2", [1, 2]),
        ('{"a": "see ```json\\n{}\\n```"}', {"a": "see ```json\n{}\n```"}),
    ],
)
def test_repair(text, value):
    assert outputs.repaired(text) == value


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda s: st.lists(s, max_size=3) | st.dictionaries(st.text(), s, max_size=3), max_leaves=8))
def test_repair_leaves_json_alone(value):
    assert outputs.repaired(json.dumps(value)) == value


def test_task_outputs():
    fields = outputs.OUTPUT_FIELDS["intent_only"]
    assert json.loads(outputs.parse_task('<result>{"intents": ["a"], "more": 1}</result>', fields)[0]) == {"intents": ["a"], "rationale": None}
    assert "missing" in outputs.parse_task("<result>{}</result>", fields)[1]
    assert "list of strings" in outputs.parse_task('<result>{"intents": [1]}</result>', fields)[1]
    assert "no result tag" in outputs.parse_task("{}", fields)[1]
    assert json.loads(outputs.parse_task("free text", None)[0]) == {"task_output": "free text"}


def test_verdicts():
    assert outputs.ranking_verdict('<result>{"ranking": ["A"], "rationale": 3, "correct_models": "A"}</result>') == {
        "ranking": ["A"], "rationale": None, "correct_models": None,
    }
    assert outputs.violations("{}") == {} and len(outputs.violations('{"A.1.1": "x", "B.1.2": "y"}')) == 2
    assert outputs.violations('{"A.1.1": 3}') is None and outputs.violations("??") is None


def test_final_text():
    assert final_text(["t"], {"t": ('{"task_output": "plain"}', None)}) == ("plain", True)
    assert final_text(["a", "b"], {"a": ('{"x": "é"}', None), "b": ('{"y": 1}', None)}) == (json.dumps({"a": {"x": "é"}, "b": {"y": 1}}, indent=2, ensure_ascii=False), True)
    text, valid = final_text(["a", "b"], {"a": (None, "ERROR: no")})
    assert not valid and text.startswith("ERROR: One or more") and "Output missing for task 'b'" in text


@pytest.fixture(scope="module")
def run(spark):
    samples = spark.createDataFrame([(i, "x" * i) for i in range(12)], "sample_id long, formatted_context string")
    catalogue = Catalogue(STUB_PROMPTS, formatters=FORMATTERS)
    stages = WORKFLOWS["inference_with_intent"]
    results = run_workflow(samples, ["m1", "m2"], stages, catalogue, StubClient(stub_answer)).cache()
    return samples, catalogue, results, judge_inputs(results, stages).cache()


def test_workflow_propagates_errors(run):
    _, _, results, inputs = run
    rows = {(r.sample_id, r.model, r.task): r for r in results.collect()}
    assert len(rows) == 48
    for (i, model, task), r in rows.items():
        assert (r.value is None) != (r.error is None) and r.version == "v1"
        if task == "intent_only" and rows[i, model, "inference"].error:
            assert "Missing" in r.error and r.prompt_text is None
    assert {r.valid for r in inputs.collect()} == {True, False}


def test_ranking_judge(run):
    samples, catalogue, results, inputs = run
    client = StubClient(stub_answer)
    long = judging.judge_rankings(samples, inputs, client, "j", "Rank.", 5).cache()
    for r in long.collect():
        if r.judge_status is None:
            assert r["rank"] == (1 if r.mask == "MODEL_B" else 2) and r.correct == (r.mask == "MODEL_B") and r.judge_rationale.startswith("m")
        else:
            assert r["rank"] == -1 and r.correct is None
    wide = judging.wide(long, results, catalogue, ["m1", "m2"], {"seed": 5})
    assert wide.count() == 12 and {"rank_m1", "correct_m2", "raw_output_inference_m1", "version_koa_only", "seed"} <= set(wide.columns)


def test_constraint_judge(run):
    samples, _, _, inputs = run
    judge = StubClient(lambda m, t: '<result>{"A.1.1": "x"}</result>' if len(t) % 2 else "no idea")
    got = judging.judge_constraints(samples, inputs, judge, "j", "A.1.1 Be brief.").collect()
    assert len(got) == 24 and {r.violation_count for r in got if "ERROR" not in r.judge_input} <= {1, -1}
    assert all(r.violation_count == -1 for r in got if r.judge_input.startswith("ERROR"))


def test_seeds(spark):
    runs = lambda *rows: spark.createDataFrame(list(rows), "run_id long, seed long, violation_count int")
    assert judging.effective_seed(4, None) == 4 and judging.effective_seed(None, None, 99.0) == 99
    assert judging.effective_seed(None, runs((1, 7, 3), (2, 8, 0)), 99.0) == 99
    assert judging.effective_seed(None, runs((2, 8, 3), (1, 7, 0)), 99.0) == 8
    assert judging.effective_seed(None, runs((2, 8, -1)), 99.0) == 8
    with pytest.raises(RuntimeError):
        judging.effective_seed(None, runs())
    with pytest.raises(RuntimeError):
        judging.effective_seed(None, spark.range(1))


def test_default_directive():
    catalogue = Catalogue(STUB_PROMPTS)
    assert judging.default_directive(WORKFLOWS["koa_only"], catalogue)[0] == "koa_only"
    with pytest.raises(ValueError):
        judging.default_directive(WORKFLOWS["concurrent_intent_koa"], catalogue)


def test_similar_users(spark):
    rows = [(i, f"u{i}", f"text {i}", [float(i), 1.0]) for i in range(4)]
    users = spark.createDataFrame(rows, "vec_id long, author string, formatted_comment string, embedding array<float>")
    echo = StubClient(lambda m, t: f"{m} {len(t)}")
    got = similar_users.label_candidates(users.where("vec_id = 0"), users, 2, echo, echo, "t", "j").collect()
    assert [c.author for c in got[0].candidates] == ["u1", "u2"] and got[0].teacher_output.startswith("t ") and got[0].judge_output.startswith("j ")


def test_command_line(spark, tmp_path):
    from threadloom import cli

    for name, (text, _) in STUB_PROMPTS.items():
        (tmp_path / "prompts" / name).mkdir(parents=True)
        (tmp_path / "prompts" / name / "v1.txt").write_text(text)
    (tmp_path / "in.csv").write_text("formatted_context\n" + "\n".join(f"text {i}" for i in range(5)) + "\n")
    common = ["--workflow", "single_intent_only", "--input-data-file", str(tmp_path / "in.csv"), "--output-dir", str(tmp_path), "--prompts", str(tmp_path / "prompts"), "--url", "http://x", "--judge-model", "j"]
    for command, models in (("rank", "a,b"), ("adherence", "a"), ("refine", "a"), ("refine", "a")):
        path = cli.evaluate(cli.parser().parse_args([command, "--models", models, *common]), StubClient(stub_answer))
        assert (tmp_path / path).exists()
    assert spark.read.parquet(path).select("run_id").distinct().count() == 2


def test_masks_beyond_the_alphabet(spark):
    from threadloom.plans.judging import masks

    rows = spark.createDataFrame([(1, f"m{i}", True) for i in range(60)], "sample_id long, model string, valid boolean")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    expected = [*letters, *(f"A{c}" for c in letters), *(f"B{c}" for c in letters[:8])]
    got = {r.mask for r in masks(rows, 3).collect()}
    assert got == {f"MODEL_{c}" for c in expected}
