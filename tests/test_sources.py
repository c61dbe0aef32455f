import json
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom import sinks
from threadloom.schema import COMMENTS
from threadloom.sources import clients, csv, ndjson, prompts, zstd_source


def lines():
    whole = {"id": "a", "author": "x", "created_utc": 1420070400, "retrieved_on": 1, "edited": False, "score": 3, "extra": 1, "stickied": True}
    return [
        json.dumps(whole),
        json.dumps(whole | {"id": "b", "edited": 1420070999, "created_utc": "1420070401"}),
        json.dumps({k: v for k, v in whole.items() if k != "edited"} | {"id": "c", "score": "many"}),
        json.dumps(whole | {"id": "d", "created_utc": None}),
        "",
        '{"id": "e", "auth',
        json.dumps(whole | {"id": "f", "author": "café"}, ensure_ascii=False).replace("é", "\udcff"),
    ]


def raw():
    return "\n".join(lines()).encode("utf-8", "surrogateescape")


@pytest.mark.parametrize("window", [None, 27, 31])
def test_dump_to_cache(spark, tmp_path, window):
    if window is None:
        (tmp_path / "RC_1.json").write_bytes(raw())
    else:
        params = zstandard.ZstdCompressionParameters.from_level(3, window_log=window)
        (tmp_path / "RC_1.zst").write_bytes(zstandard.ZstdCompressor(compression_params=params).compress(raw()))
    make = lambda: ndjson.ensure_parquet_cache(spark, str(tmp_path), "RC_*", COMMENTS, str(tmp_path / "cache"))
    rows = {r.id: r for r in make().collect()}
    assert set(rows) == {"a", "b", "c", "f"}
    assert [rows[i].edited for i in "abc"] == ["false", "1420070999", None]
    assert rows["b"].created_utc == 1420070401 and rows["c"].score is None and rows["a"].stickied is True
    assert rows["f"].author == "caf�" and rows["a"].body is None
    assert make().columns == COMMENTS.names
    reasons = {r._rejected for r in spark.read.parquet(str(tmp_path / "cache/rejects")).collect()}
    assert reasons == {"not JSON", "no created_utc"}
    (tmp_path / "cache/rows/_SUCCESS").unlink()
    assert make().count() == 4


def test_broken_cache_is_rebuilt(spark, tmp_path):
    (tmp_path / "RC_1.json").write_bytes(raw())
    make = lambda: ndjson.ensure_parquet_cache(spark, str(tmp_path), "RC_*", COMMENTS, str(tmp_path / "cache"))
    assert make().count() == 4 and not (tmp_path / "cache/staged").exists()
    for part in (tmp_path / "cache/rows").glob("*.parquet"):
        part.write_bytes(part.read_bytes()[:40])
    for check in (tmp_path / "cache/rows").glob(".*.crc"):
        check.unlink()
    assert make().count() == 4
    spark.createDataFrame([(1,)], "other int").write.mode("overwrite").parquet(str(tmp_path / "cache/rows"))
    assert make().count() == 4


@pytest.mark.parametrize("damage", ["cut", "garbage"])
def test_broken_stream_leaves_a_reject(spark, tmp_path, damage):
    body = "\n".join(json.dumps({"id": f"n{i}", "author": "x" * (i % 50), "created_utc": i, "retrieved_on": 1}) for i in range(20_000)).encode()
    squeezed = zstandard.ZstdCompressor().compress(body)
    two = squeezed + zstandard.ZstdCompressor().compress(b"\n" + body)
    (tmp_path / "RC_1.zst").write_bytes(two[: len(squeezed) * 3 // 2] if damage == "cut" else two + b"no frame")
    kept = ndjson.ensure_parquet_cache(spark, str(tmp_path), "RC_*", COMMENTS, str(tmp_path / "cache")).count()
    assert 20_000 <= kept < 40_000 if damage == "cut" else kept == 40_000
    told = [r._corrupt for r in spark.read.parquet(str(tmp_path / "cache/rejects")).collect()]
    assert any("broken zstd stream" in (t or "") for t in told)


def pieces_of(body, n, seed=1):
    rng = random.Random(seed)
    cuts = sorted(rng.randrange(len(body)) for _ in range(n - 1))
    return [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)], strict=True)]


BODY = "".join(f"{i} é{random.Random(i).randbytes(i % 90).hex()}\n" for i in range(3000)).encode()
SKIPPED = b"\x53\x2a\x4d\x18\x05\x00\x00\x00hello"


def damaged(frames, how):
    out = [zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=i % 2 == 0).compress(f) for i, f in enumerate(frames)]
    if how == "flip":
        out[7] = out[7][: len(out[7]) // 2] + bytes([out[7][len(out[7]) // 2] ^ 255]) + out[7][len(out[7]) // 2 + 1 :]
    if how == "header":
        out[9] = out[9][:4] + b"\xff" * 8 + out[9][12:]
    if how == "skippable":
        out = [x for frame in out for x in (frame, SKIPPED)]
    joined = b"".join(out)
    return {"cut": joined[:-9], "garbage": joined + b"no frame at all"}.get(how, joined)


@pytest.mark.parametrize("how", ["whole", "skippable", "flip", "header", "cut", "garbage"])
def test_frames_in_splits_give_the_lines_of_the_whole(tmp_path, how):
    (tmp_path / "a.zst").write_bytes(raw := damaged(pieces_of(BODY, 20), how))
    whole = list(zstd_source.stream_lines(str(tmp_path / "a.zst")))
    want = BODY.decode().splitlines()
    told = [x for x in whole if x.startswith(zstd_source.BROKEN)]
    assert len(told) == (how not in ("whole", "skippable"))
    assert whole == want if not told else len(set(whole) & set(want)) > 2500
    for split in (61, 997, 5000, 30_011, len(raw) // 2, len(raw)):
        bounds = [*range(0, len(raw), split), None]
        got = [x for a, b in zip(bounds, bounds[1:], strict=False) for x in zstd_source.stream_lines(str(tmp_path / "a.zst"), a, b)]
        assert sorted(got) == sorted(whole), split


def test_long_lines_and_bytes_that_look_like_frames(tmp_path):
    body = zstd_source.MAGIC * 5000 + b"x" * 3000 + b"\n" + zstd_source.MAGIC + b"\nend"
    (tmp_path / "a.zst").write_bytes(raw := b"".join(zstandard.compress(p, 1) for p in pieces_of(body, 40)))
    whole = list(zstd_source.stream_lines(str(tmp_path / "a.zst")))
    assert whole == [x.decode("utf-8", "replace") for x in body.split(b"\n")]
    for split in (100, 700):
        bounds = [*range(0, len(raw), split), None]
        assert [x for a, b in zip(bounds, bounds[1:], strict=False) for x in zstd_source.stream_lines(str(tmp_path / "a.zst"), a, b)] == whole


def test_a_file_of_many_frames_is_read_by_many_tasks(spark, tmp_path):
    frames = b"".join(zstandard.compress(p, 1) for p in pieces_of(BODY, 20))
    (tmp_path / "many.zst").write_bytes(frames)
    (tmp_path / "one.zst").write_bytes(zstandard.compress(BODY, 1))
    (tmp_path / "none.zst").write_bytes(b"")
    for name, several in (("many", True), ("one", False)):
        rows = zstd_source.read_zst_lines(spark, [str(tmp_path / f"{name}.zst"), str(tmp_path / "none.zst")], len(frames) // 10)
        found = rows.select("line", F.spark_partition_id().alias("task")).collect()
        assert sorted(r.line for r in found) == sorted(BODY.decode().splitlines())
        assert (len({r.task for r in found}) > 5) == several


def test_no_match_and_empty_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        ndjson.read_ndjson(spark, str(tmp_path), "*.json", COMMENTS)
    (tmp_path / "e.json").write_text("")
    assert ndjson.read_ndjson(spark, str(tmp_path), "*.json", COMMENTS, ["id"]).count() == 0


def test_csv_round_trip_and_union(spark, tmp_path):
    rows = spark.createDataFrame([('a "q"\n{"x": [1]}', 1), ("b", 2)], "formatted_context string, z int")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "one.csv"))
    assert csv.read_csv(spark, str(tmp_path / "one.csv")).columns == ["formatted_context", "z"]
    (tmp_path / "two.csv").write_text("other\n1\n")
    (tmp_path / "three.csv").write_text("formatted_context,extra\nc,9\n")
    got = csv.read_contexts(spark, str(tmp_path))
    assert {r.formatted_context for r in got.collect()} == {'a "q"\n{"x": [1]}', "b", "c"}
    assert csv.sampled_contexts(got, 2, 1).count() == 2 and csv.sampled_contexts(got, 9, 1).count() == 3
    with pytest.raises(ValueError):
        csv.sampled_contexts(spark.range(1), 1, 1)


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", 1), ("c", 2)], "user string, n int")
    sinks.write_by_user(rows, str(tmp_path / "u"))
    assert {p.name for p in (tmp_path / "u").iterdir() if p.is_dir()} == {"user_dir=a_b", "user_dir=c"}
    with pytest.raises(ValueError):
        sinks.append_run(rows, str(tmp_path / "r"))
    sinks.append_run(rows.selectExpr("n as run_id"), str(tmp_path / "r"))
    sinks.append_run(rows.selectExpr("n as run_id"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    sinks.write_ndjson(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.result_name("d", "p", "w", "x/y", "q", "i", append=True) == "d/p_workflow-w_judge-x_y_prompt-q_input-i.csv"
    with pytest.raises(ValueError):
        sinks.result_name("d", "p", "w", "x/y", "q", "i")


def test_prompts_sort_by_number(tmp_path):
    (tmp_path / "p").mkdir()
    for v in (2, 10):
        (tmp_path / f"p/v{v}.txt").write_text(f"text {v}")
    assert prompts.load_prompt(tmp_path, "p") == ("text 10", "v10")
    assert prompts.load_prompt(tmp_path, "p", "v2") == ("text 2", "v2")
    with pytest.raises(FileNotFoundError):
        prompts.load_prompt(tmp_path, "q")
    with pytest.raises(ValueError):
        prompts.wrap_json("p", "{")


def test_clients(spark):
    def answer(model, text):
        if text == "bad":
            raise ValueError("no")
        return f"{model}:{text}"

    rows = spark.createDataFrame([("m", "x"), ("m", "bad"), ("m", None)], "model string, prompt_text string")
    got = {r.prompt_text: (r.raw, r.error) for r in clients.completed(rows, clients.StubClient(answer)).collect()}
    assert got["x"] == ("m:x", None) and got["bad"] == (None, clients.FAILED + "no") and got[None][0] is None
    embed = clients.embedded(clients.hashed_embedding(8), rows.prompt_text, 8)
    assert [len(r[0]) if r[0] else None for r in rows.select(embed).collect()] == [8, 8, None]
    with pytest.raises(Exception, match="dimensions"):
        rows.select(clients.embedded(clients.hashed_embedding(8), rows.prompt_text, 9)).collect()
    assert [r[0] for r in rows.select(clients.token_counts(len, rows.prompt_text)).collect()] == [1, 3, None]
