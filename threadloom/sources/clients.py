"""Text-model and embedding clients, and the columns that call them."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.batches import Batches, Step, pieces

#: Error texts of results.
FAILED = "ERROR: Model execution failed - "
MISSING = "ERROR: Missing required inputs"


class TextClient(Protocol):
    def complete(self, model: str, text: str) -> str: ...


@dataclass
class HttpClient:
    """Chat completions over HTTP. The key comes in as a value; the caller decides where to keep it."""

    url: str
    key: str
    timeout: float = 120.0

    def complete(self, model: str, text: str) -> str:
        body = json.dumps({"model": model, "messages": [{"role": "user", "content": text}]}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


@dataclass
class StubClient:
    """Answers by a function of (model, text): deterministic, without a network."""

    answer: Callable[[str, str], str]

    def complete(self, model: str, text: str) -> str:
        return self.answer(model, text)


def answer(client: TextClient, model: str, prompt: str | None) -> tuple[str | None, str | None]:
    """(answer, None), or (None, error): whatever a client raises is a result."""
    if prompt is None:
        return None, MISSING
    try:
        return client.complete(model, prompt), None
    except Exception as e:  # noqa: BLE001
        return None, f"{FAILED}{e}"


def completed(
    rows: DataFrame, client: TextClient, model: str = "model", text: str = "prompt_text", threads: int = 16, answers: str | None = None
) -> DataFrame:
    """rows with raw (the answer) and error; exactly one of the two is null. Null texts are not asked.

    Calls run in a bounded thread pool in each task, over pieces of its batches. With a folder `answers`, each different prompt is asked once, over
    all runs that share the folder, and retried tasks read what they had (sources/answers.py); without one, every row is
    asked and retried tasks ask again, so clients should be idempotent.
    """
    if answers is not None:
        from threadloom.sources.answers import answered

        return answered(rows, client, answers, model, text, threads)
    schema = rows.drop("raw", "error").schema.add("raw", "string").add("error", "string")
    return rows.drop("raw", "error").mapInArrow(asking(client, model, text, threads), schema)


def asking(client: TextClient, model: str = "model", text: str = "prompt_text", threads: int = 16) -> Step:
    """The step that adds raw and error, as completed(), to record batches; a piece of one is asked at a time."""

    def ask(pair: tuple[str, str]) -> tuple[str | None, str | None]:
        return answer(client, *pair)

    def run(batches: Batches) -> Batches:
        with ThreadPoolExecutor(threads) as pool:
            for piece in pieces(batches):
                got = list(pool.map(ask, zip(piece[model].to_pylist(), piece[text].to_pylist(), strict=True)))
                for at, name in enumerate(("raw", "error")):
                    piece = piece.append_column(name, pa.array([g[at] for g in got], pa.string()))
                yield piece

    return run


def embedded(embed: Callable[[str], list[float]], text: Column, dims: int = 3072, threads: int = 16) -> Column:
    """Column array<float>: embed(text), null for null; ValueError for a vector of other than `dims` dimensions."""

    def one(t: str | None) -> list[float] | None:
        if t is None:
            return None
        if len(vector := embed(t)) != dims:
            raise ValueError(f"a vector of {len(vector)} dimensions, not {dims}")
        return list(vector)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                yield pd.Series(list(pool.map(one, part)), dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


@dataclass
class HttpEmbedder:
    """Embeddings over HTTP, as a function of a text. The key comes in as a value."""

    url: str
    key: str
    model: str
    timeout: float = 120.0

    def __call__(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "input": text}).encode()
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as got:
            return json.load(got)["data"][0]["embedding"]


def embedding_results(embed: Callable[[str], list[float]], text: Column, dims: int = 3072, threads: int = 16) -> Column:
    """Column struct (vector array<float>, error string) of embed(text): exactly one of the two, and neither for null.

    What embed raises, and a vector of other than `dims` dimensions or with entries that are no finite numbers, is the
    row's error; other rows go on.
    """

    def one(t: str | None) -> tuple[list[float] | None, str | None]:
        if t is None:
            return None, None
        try:
            vector = [float(x) for x in embed(t)]
        except Exception as e:  # noqa: BLE001  (the row's result)
            return None, f"{FAILED}{e}"
        if len(vector) != dims:
            return None, f"{FAILED}a vector of {len(vector)} dimensions, not {dims}"
        if not all(map(math.isfinite, vector)):
            return None, f"{FAILED}a vector with entries that are not finite"
        return vector, None

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for part in parts:
                got = list(pool.map(one, part))
                yield pd.DataFrame({"vector": pd.Series([g[0] for g in got], dtype=object), "error": pd.Series([g[1] for g in got], dtype=object)})

    return F.pandas_udf(run, "vector array<float>, error string")(text)


def hashed_embedding(dims: int) -> Callable[[str], list[float]]:
    """A deterministic stand-in for an embedding model."""

    def embed(text: str) -> list[float]:
        raw = hashlib.shake_256(text.encode()).digest(dims)
        return [(b - 127.5) / 127.5 for b in raw]

    return embed


def token_counts(count: Callable[[str], int], text: Column) -> Column:
    """Column long: exact token counts by a pluggable tokenizer; null for null."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if t is None else count(t) for t in part], dtype="Int64")

    return F.pandas_udf(run, "long")(text)
