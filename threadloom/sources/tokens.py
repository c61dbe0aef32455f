"""Exact token counts: conversations rendered by a chat template, counted by a tokenizer read from a file."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a tokenizer gets at once, so that long texts do not pile up in a worker.
CHUNK = 1 << 22


@dataclass(frozen=True)
class ChatTemplate:
    """What stands around a conversation's turns. `{role}` in `before` is the turn's role, or its name in `roles`."""

    begin: str = ""
    before: str = "<|{role}|>\n"
    after: str = "\n"
    prompt: str = ""  # the opening of the answer, behind the last turn
    roles: tuple[tuple[str, str], ...] = ()

    def render(self, turns: Column) -> Column:
        """The text of an array of (role, content) structs, in column functions. Null turns, roles and contents are empty;
        a null array is null."""
        empty = lambda c: F.coalesce(c, F.lit(""))

        def role(given: Column) -> Column:
            named = given
            for old, new in self.roles:
                named = F.when(given == old, F.lit(new)).otherwise(named)
            return named

        parts = self.before.split("{role}")

        def turn(t: Column) -> Column:
            name = role(empty(t["role"]))
            head = [F.lit(parts[0]), *(c for p in parts[1:] for c in (name, F.lit(p)))]
            return F.concat(*head, empty(t["content"]), F.lit(self.after))

        return F.when(turns.isNotNull(), F.concat(F.lit(self.begin), F.array_join(F.transform(turns, turn), ""), F.lit(self.prompt)))


@lru_cache(maxsize=4)
def _loaded(path: str, specials: bool):
    """A function from texts to their numbers of tokens; a worker process loads a file once."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not specials
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def exact_token_counts(path: str, text: Column, specials: bool = False) -> Column:
    """Column of long: the tokens of a text by the tokenizer in a file, null for null.

    `*.model` files are read by sentencepiece, others by tokenizers. With `specials`, strings of special tokens in a text
    (those of a template) count as one token each; else they are ordinary text, which is what untrusted text needs.
    sentencepiece always takes them as ordinary text. The file must be at the same path on all workers.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _loaded(path, specials)
        for part in parts:
            out: list[int | None] = [None] * len(part)
            held: list[int] = []
            size = 0
            texts = part.tolist()
            for i, t in enumerate([*texts, None]):
                if t is not None:
                    held.append(i)
                    size += len(t)
                if held and (size >= CHUNK or i == len(texts)):
                    for k, n in zip(held, count([texts[k] for k in held]), strict=True):
                        out[k] = n
                    held, size = [], 0
            yield pd.Series(out, dtype="Int64")

    return F.pandas_udf(run, "long")(text)


def per_token(amount: Column, tokens: Column) -> Column:
    """Characters or words per token; null without tokens."""
    return F.try_divide(amount.cast("double"), tokens)
