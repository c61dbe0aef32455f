"""Chat templates and exact token counts against the libraries' own counts."""

import os

import pytest
from pyspark.sql import functions as F

from threadloom.sources import tokens
from threadloom.sources.tokens import ChatTemplate, exact_token_counts, per_token

FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
TEXTS = ["", " ", "one two three", "é ß 中文 🙂\n\n", "a" * 3000, "<|endoftext|> text", "x y " * 5000, None, "one two three"]
TURNS = "turns array<struct<role: string, content: string>>"


def file(name):
    path = f"{FOLDER}/{name}"
    if not os.path.exists(path):
        pytest.skip(f"{path} is not here")
    return path


def counted(spark, path, **options):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").repartition(3)
    return [r.n for r in rows.select("i", exact_token_counts(path, F.col("text"), **options).alias("n")).orderBy("i").collect()]


@pytest.mark.parametrize("chunk", [1, 1 << 22])
def test_counts_of_a_json_file(spark, monkeypatch, chunk):
    library = pytest.importorskip("tokenizers")
    monkeypatch.setattr(tokens, "CHUNK", chunk)
    path = file("byte_bpe_50k.json")
    own = library.Tokenizer.from_file(path)
    for specials in (False, True):
        own.encode_special_tokens = not specials
        want = [None if t is None else len(own.encode(t, add_special_tokens=False).ids) for t in TEXTS]
        assert counted(spark, path, specials=specials) == want
    assert counted(spark, path, specials=True)[5] < counted(spark, path)[5]


def test_counts_of_a_model_file(spark):
    library = pytest.importorskip("sentencepiece")
    path = file("piece_bpe_32k.model")
    own = library.SentencePieceProcessor(model_file=path)
    assert counted(spark, path) == [None if t is None else len(own.encode(t)) for t in TEXTS]


def test_no_rows(spark):
    rows = spark.createDataFrame([], "text string")
    assert rows.select(exact_token_counts(file("byte_bpe_50k.json"), F.col("text")).alias("n")).collect() == []


def test_templates(spark):
    rows = [([("user", "Hi"), ("assistant", "Yes {role}"), (None, None)],), ([],), (None,), ([None, ("system", "é")],)]
    frame = spark.createDataFrame(rows, TURNS)
    chat = ChatTemplate("<s>", "<{role}>", "</{role}>\n", "<model>", (("assistant", "model"),))
    got = [r[0] for r in frame.select(chat.render(F.col("turns"))).collect()]
    end = "</{role}>\n"  # only `before` names the role
    assert got == [f"<s><user>Hi{end}<model>Yes {{role}}{end}<>{end}<model>", "<s><model>", None, f"<s><>{end}<system>é{end}<model>"]
    bare = ChatTemplate(before="", after="|")
    assert [r[0] for r in frame.select(bare.render(F.col("turns"))).collect()] == ["Hi|Yes {role}||", "", None, "|é|"]


def test_ratios(spark):
    rows = spark.createDataFrame([(12, 4), (3, 0), (5, None)], "n int, t long")
    assert [r[0] for r in rows.select(per_token(F.col("n"), F.col("t"))).collect()] == [3.0, None, None]
