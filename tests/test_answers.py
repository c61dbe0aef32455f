"""The answer table, inferred schemas, embeddings with errors, and times in any time zone."""

from __future__ import annotations

import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions import expr as E
from threadloom.sources import clients, csv, infer, ndjson


def counting(folder: str, fatal: tuple[str, ...] = ()):
    """A client that notes every call; texts in `fatal` end the task. A local class, so that workers get it by value."""

    class Counting:
        def complete(self, model: str, text: str) -> str:
            if text in fatal:
                raise SystemExit("the task dies")
            with open(f"{folder}/calls", "a") as f:
                f.write(json.dumps([model, text]) + "\n")
            if text.startswith("bad"):
                raise ValueError("no")
            return f"{model}:{text}"

    return Counting()


def calls(folder) -> list:
    path = f"{folder}/calls"
    return sorted(map(json.loads, open(path))) if os.path.exists(path) else []


def results(rows, client, path):
    return sorted((r.n, r.raw, r.error) for r in clients.completed(rows, client, answers=path).collect())


def test_each_prompt_is_asked_once(spark, tmp_path):
    client, path = counting(str(tmp_path)), str(tmp_path / "table")
    rows = spark.createDataFrame([(n, "m1" if n % 2 else "m2", f"p{n % 3}") for n in range(60)] + [(90, "m1", None), (91, "m1", "bad")], "n int, model string, prompt_text string").repartition(5)
    got = results(rows, client, path)
    assert got[:3] == [(0, "m2:p0", None), (1, "m1:p1", None), (2, "m2:p2", None)]
    assert got[-2:] == [(90, None, clients.MISSING), (91, None, clients.FAILED + "no")] and len(got) == 62
    assert calls(tmp_path) == [["m1", "bad"], *(["m1", f"p{n}"] for n in range(3)), *(["m2", f"p{n}"] for n in range(3))]
    assert results(rows, client, path) == got
    assert len(calls(tmp_path)) == 8 and calls(tmp_path).count(["m1", "bad"]) == 2  # errors are asked anew
    assert spark.read.parquet(f"{path}/answers").count() == 6 and not os.path.exists(f"{path}/notes")


def test_answers_of_a_failed_run_are_kept(spark, tmp_path, monkeypatch):
    from threadloom.sources import answers

    monkeypatch.setattr(answers, "NOTED", 4)
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(n, "m", f"p{n:03}") for n in range(40)], "n int, model string, prompt_text string")
    dying = counting(str(tmp_path), ("p025",))
    with pytest.raises(Exception, match="dies|failed|SystemExit"):
        results(rows, dying, path)
    before = len(calls(tmp_path))
    whole = counting(str(tmp_path))
    assert results(rows, whole, path) == [(n, f"m:p{n:03}", None) for n in range(40)]
    after = len(calls(tmp_path))
    assert before and after < before + 40 and after <= 40 + 4 * 4  # no more than the block that broke off, in each task
    assert results(rows, whole, path) and len(calls(tmp_path)) == after


LINES = [
    {"id": "a", "n": 1, "x": 1, "o": {"p": 1, "q": [1, 2]}, "flag": True, "nothing": None},
    {"id": "b", "n": 2.5, "x": True, "o": {"q": [None, 2.5], "r": "s"}, "flag": None, "big": 2**70},
    {"id": "c", "n": None, "x": [1], "o": None, "late": {"deep": {"er": 1}}, "mixed": {}},
    {"mixed": {"k": 1}},
]


@pytest.mark.parametrize("squeezed", [False, True])
def test_inferred_schema(spark, tmp_path, squeezed):
    body = "\n".join([*map(json.dumps, LINES), "", "no json", "[1]", '{"id": "d", "cut'] * 3).encode()
    (tmp_path / ("a.zst" if squeezed else "a.json")).write_bytes(zstandard.ZstdCompressor().compress(body) if squeezed else body)
    schema = infer.infer_schema(spark, str(tmp_path), "a.*", {"n": T.StringType(), "new": T.LongType()})
    assert schema.simpleString() == (
        "struct<big:double,flag:boolean,id:string,late:struct<deep:struct<er:bigint>>,mixed:struct<k:bigint>,n:string,new:bigint,nothing:string,"
        "o:struct<p:bigint,q:array<double>,r:string>,x:string>"
    )
    rows = infer.read_inferred(spark, str(tmp_path), "a.*", {"flag": T.StringType()}).collect()
    assert len(rows) == 12 and {r.id for r in rows} == {"a", "b", "c", None}
    first = next(r for r in rows if r.id == "a")
    assert first.o.q == [1.0, 2.0] and first.x == "1" and first.flag == "true" and first.nothing is None


def test_declared_schema_is_inferred(spark, tmp_path):
    """Dumps whose values have the declared types give the declared types; overrides settle the rest."""
    from threadloom.schema import COMMENTS

    sample = {T.StringType(): "s", T.LongType(): 7, T.BooleanType(): True, T.DoubleType(): 0.5}
    (tmp_path / "RC.json").write_text("\n".join(json.dumps({f.name: sample[f.dataType] if i else None for f in COMMENTS.fields}) for i in range(3)))
    got = infer.infer_schema(spark, str(tmp_path), "RC.*", {"score": T.DoubleType()})
    assert {f.name: f.dataType for f in got} == {f.name: f.dataType for f in COMMENTS} | {"score": T.DoubleType()}


def test_joining_is_commutative_and_associative():
    kinds = ["null", "boolean", "long", "double", "string", ["array", "long"], ["array", "null"], {"a": "long"}, {"a": ["array", "string"], "b": "null"}, {}]
    for a in kinds:
        assert infer.join(a, a) == a
        for b in kinds:
            assert infer.join(a, b) == infer.join(b, a)
            for c in kinds:
                assert infer.join(infer.join(a, b), c) == infer.join(a, infer.join(b, c))


def test_embeddings_fail_row_by_row(spark):
    def embed(text: str) -> list[float]:
        if text == "bad":
            raise ValueError("no")
        return [1.0] * len(text) if text != "nan" else [1.0, float("nan"), 1.0, 1.0]

    rows = spark.createDataFrame([("four",), ("bad",), ("three",), ("nan",), (None,)], "t string")
    got = [tuple(r.e) for r in rows.select(clients.embedding_results(embed, F.col("t"), 4).alias("e")).collect()]
    assert got[0] == ([1.0] * 4, None) and got[1] == (None, clients.FAILED + "no") and got[4] == (None, None)
    assert "5 dimensions" in got[2][1] and "finite" in got[3][1]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata", "UTC"])
def test_times_are_utc(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(1438603020,), (-1,), (0,), (None,), (1 << 60,)], "t long")
        got = [r[0] for r in rows.select(E.epoch_text(F.col("t"))).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["03-08-2015 11:57", "31-12-1969 23:59", "01-01-1970 00:00", "[unknown_time]", "[invalid_time]"]


def test_samples_keep_repeated_inputs(spark):
    frame = spark.createDataFrame([("a",)] * 5 + [("b",)], "formatted_context string")
    assert sorted(r.formatted_context for r in csv.sampled_contexts(frame, 9, 1).collect()) == ["a"] * 5 + ["b"]
    assert csv.sampled_contexts(frame, 3, 1).count() == 3


def test_cache_counts(spark, tmp_path):
    from threadloom.schema import COMMENTS

    (tmp_path / "RC_1.json").write_text("\n".join([*(json.dumps({"id": str(i), "created_utc": 1, "retrieved_on": 1}) for i in range(5)), "x"]))
    ndjson.ensure_parquet_cache(spark, str(tmp_path), "RC_*", COMMENTS, str(tmp_path / "cache"))
    assert ndjson.count_cached(spark, str(tmp_path / "cache")) == (5, 1)


def test_users_do_not_share_a_folder(spark, tmp_path):
    from threadloom import sinks

    sinks.write_by_user(spark.createDataFrame([("a.b", 1), ("a_b", 2), ("c/d", 3)], "user string, n int"), str(tmp_path / "u"))
    folders = {p.name: {r.user for r in spark.read.parquet(str(p)).collect()} for p in (tmp_path / "u").iterdir() if p.is_dir()}
    assert sorted(map(sorted, folders.values())) == [["a.b"], ["a_b"], ["c/d"]] and "user_dir=c_d" in folders
