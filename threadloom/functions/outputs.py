"""Parsing of text-model outputs: tagged results, lenient JSON, checked fields. Plain Python and its columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<result>(.*?)</result>", re.S)
_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def tagged(text: str | None) -> str | None:
    """The last <result>...</result> of a text, stripped; None without one."""
    found = _TAG.findall(text or "")
    return found[-1].strip() if found else None


def repaired(text: str | None):
    """The JSON value in a text: as it is, or after mending what models get wrong; None if that fails.

    Mended are: code fences and words around the outermost braces or brackets; comments; strings in single or curly quotes,
    with raw line ends, with quotes inside that are not escaped, with unknown escapes, or cut off; bare keys and values;
    commas too many or missing, colons missing; Python's words; closers that are missing or of the wrong kind. A key whose
    value is cut off at the end of the text is left out; one whose value is missing before that holds null. A damaged text
    that is nested deeper than 200 levels gives None.
    """
    if not text or not text.strip():
        return None
    text = text.strip()
    try:
        return json.loads(text)  # its strings may hold fences
    except (ValueError, RecursionError):
        pass
    if fenced := _FENCE.findall(text):
        text = fenced[-1].strip()
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        pass
    starts = [i for i in (text.find("{"), text.find("[")) if i >= 0]
    if not starts:
        return None
    return _Recovering(text[min(starts) :]).value()


_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None}
_SKIPPED = re.compile(r"(?:[\s,;]+|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_BLANK = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_INTEGER, _DECIMAL = re.compile(r"[+-]?\d{1,4000}"), re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
#: What may follow a string that ends: a closer, a colon, the end, a comma with a new item, a new item after white space.
_AFTER = re.compile(r"""\s*(?:[\]}:]|\Z|//|/\*|\#|,\s*(?:[\]}"'“‘{\[\d+-]|\Z|//|/\*|\#|(?:true|false|null|True|False|None)\b|\w+\s*:))|\s+["'“‘{\[]""")
_MISSING = object()


class _Recovering:
    """A parser of one object or array that goes on where the text breaks the rules.

    Open containers are on a stack of its own; texts nested deeper than DEPTH have no value, since writing them as JSON
    would exceed Python's own stack. A text is read once, but for strings whose
    end is in doubt, which are read twice at most.
    """

    DEPTH = 200

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.stack: list[list] = []  # [container, the key that waits for a value]
        self.sealed = False  # whether a string without an end that fits was met; the first quote ends those behind it

    def value(self):
        root = None
        while True:
            self.at = _SKIPPED.match(self.text, self.at).end()
            if self.at >= len(self.text):
                return root
            c = self.text[self.at]
            if c in "]}":
                self.at += 1
                self._close(dict if c == "}" else list)
                if not self.stack:
                    return root
                continue
            if self.stack and isinstance(self.stack[-1][0], dict) and self.stack[-1][1] is _MISSING:
                if not self._key():
                    continue
                c = self.text[self.at] if self.at < len(self.text) else ""
                if c in ",]}" and c:
                    self._put(None)
                    continue
                if not c:
                    return root
            if c in "{[":
                self.at += 1
                opened = {} if c == "{" else []
                if not self.stack:
                    root = opened
                else:
                    self._put(opened)
                self.stack.append([opened, _MISSING])
                if len(self.stack) > self.DEPTH:
                    return None
            else:
                self._put(self._string() if c in _QUOTES else self._bare())

    def _put(self, value) -> None:
        top = self.stack[-1]
        if isinstance(top[0], dict):
            top[0][top[1]], top[1] = value, _MISSING
        else:
            top[0].append(value)

    def _close(self, kind: type) -> None:
        """Close up to the nearest container of the kind; if none is open, the innermost one, but never the outermost."""
        if any(isinstance(held, kind) for held, _ in self.stack):
            while not isinstance(self.stack.pop()[0], kind):
                pass
        elif len(self.stack) > 1:
            self.stack.pop()

    def _key(self) -> bool:
        """Read a key and its colon, if any, and stand before its value; False if no key is there."""
        c = self.text[self.at]
        if c in _QUOTES:
            key = self._string(key=True)
        else:
            found = re.compile(r"[^\s:={}\[\],\"']+").match(self.text, self.at)
            if not found:
                self.at += 1
                return False
            key, self.at = found.group(), found.end()
        self.stack[-1][1] = key
        self.at = _BLANK.match(self.text, self.at).end()
        if self.text[self.at : self.at + 1] in (":", "="):
            self.at = _BLANK.match(self.text, self.at + 1).end()
        return True

    def _string(self, key: bool = False) -> str:
        end, start = _QUOTES[self.text[self.at]], self.at + 1
        i, first, n = start, None, len(self.text)
        while i < n:
            if self.text[i] == "\\":
                i += 2
                continue
            if self.text[i] == end:
                first = i if first is None else first
                if key or self.sealed or _AFTER.match(self.text, i + 1):
                    break
            i += 1
        if i >= n:
            self.sealed = True
            i = n if first is None else first
        self.at = i + 1
        return _unescaped(self.text[start:i])

    def _bare(self):
        found = re.compile(r'(?:(?!\s//|\s/\*|\s\#|\s["“])[^,\]}\n])+').match(self.text, self.at)
        if not found:
            self.at += 1
            return None
        self.at, word = found.end(), found.group().strip()
        if word in _WORDS:
            return _WORDS[word]
        if _INTEGER.fullmatch(word):
            return int(word)
        if _DECIMAL.fullmatch(word) and abs(float(word)) != float("inf"):
            return float(word)
        return word


def _unescaped(body: str) -> str:
    """A string's text: JSON's escapes are read, others stand for themselves, a cut one at the end is dropped."""
    parts = re.findall(r"\\u[0-9a-fA-F]{4}|\\.|[^\\]+|\\", body, re.S)
    out = []
    for part in parts:
        if part[0] != "\\":
            out.append(json.dumps(part)[1:-1])
        elif len(part) == 6 or (len(part) == 2 and part[1] in '"\\/bfnrt'):
            out.append(part)
        elif len(part) == 2:
            out.append(json.dumps(part[1] if part[1] in "'`“”‘’\n" else part)[1:-1])
    return json.loads('"' + "".join(out) + '"')


def parse_object(text: str | None) -> dict | None:
    """The JSON object of a model's answer: of its last result tag, or else of the text itself."""
    inner = tagged(text)
    value = repaired(inner if inner is not None else text)
    return value if isinstance(value, dict) else None


# Fields of task outputs; `?` marks one that may be missing.
OUTPUT_FIELDS: dict[str, dict[str, str]] = {
    "all_in_one": {"koa": "list", "intents": "list"},
    "intent_only": {"intents": "list", "rationale": "text?"},
    "koa_only": {"koa": "list"},
    "inference": {"inference_output": "text"},
}


def checked(value: dict, fields: dict[str, str]) -> tuple[dict | None, str | None]:
    """(the fields, None), or (None, why not). Keys that no field names are ignored."""
    out = {}
    for name, kind in fields.items():
        got = value.get(name)
        if got is None:
            if not kind.endswith("?"):
                return None, f"ERROR: Validation Failed - {name} is missing"
            out[name] = None
        elif kind.startswith("list") and not (isinstance(got, list) and all(isinstance(x, str) for x in got)):
            return None, f"ERROR: Validation Failed - {name} is no list of strings"
        elif kind.startswith("text") and not isinstance(got, str):
            return None, f"ERROR: Validation Failed - {name} is no string"
        else:
            out[name] = got
    return out, None


def parse_task(text: str | None, fields: dict[str, str] | None) -> tuple[str | None, str | None]:
    """(JSON text of a task's checked output, None), or (None, error).

    Without fields the whole answer is the output, as {"task_output": text}: its result tag, if it has one.
    """
    if text is None:
        return None, "ERROR: Parse Failed - no answer"
    if fields is None:
        return json.dumps({"task_output": tagged(text) if tagged(text) is not None else text}, ensure_ascii=False), None
    inner = tagged(text)
    if inner is None:
        return None, "ERROR: Parse Failed - no result tag"
    value = repaired(inner)
    if not isinstance(value, dict):
        return None, "ERROR: Parse Failed - no JSON object"
    out, error = checked(value, fields)
    return (None, error) if error else (json.dumps(out, ensure_ascii=False), None)


def ranking_verdict(text: str | None) -> dict:
    """{ranking, rationale, correct_models}: each None on its own where it is missing or of another type."""
    value = parse_object(text) or {}
    names = lambda x: x if isinstance(x, list) and all(isinstance(n, str) for n in x) else None
    rationale = value.get("rationale")
    return {
        "ranking": names(value.get("ranking")),
        "rationale": rationale if isinstance(rationale, str) else None,
        "correct_models": names(value.get("correct_models")),
    }


def violations(text: str | None) -> dict[str, str] | None:
    """Constraint id to explanation; None unless all are strings."""
    value = parse_object(text)
    if value is None or not all(isinstance(v, str) for v in value.values()):
        return None
    return value


def indented(value: Column) -> Column:
    """JSON text with two spaces of indentation, characters kept as they are; null for null."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if v is None else json.dumps(json.loads(v), indent=2, ensure_ascii=False) for v in part], dtype=object)

    return F.pandas_udf(run, "string")(value)
