"""Damaged JSON of model outputs and the values that it stands for."""

import json
import random

import pytest

from threadloom.functions.outputs import repaired

DAMAGED = [
    # Around the value
    ('Sure! {"a": 1} Hope it helps.', {"a": 1}),
    ('```json\n{"a": 1}\n```', {"a": 1}),
    ('```\n[1, 2]\n```', [1, 2]),
    ('{"a": 1}}', {"a": 1}),
    # Commas and colons
    ('{"a": 1,}', {"a": 1}),
    ("[1, 2,, 3,]", [1, 2, 3]),
    ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "x"\n"b": "y"}', {"a": "x", "b": "y"}),
    ('["a" "b"\n"c"]', ["a", "b", "c"]),
    ('[{"a": 1} {"a": 2}]', [{"a": 1}, {"a": 2}]),
    ('{"a" 1, "b" "x"}', {"a": 1, "b": "x"}),
    ('{"a" = 1}', {"a": 1}),
    ('{"a": , "b": 2}', {"a": None, "b": 2}),
    ('{"a", "b": 2}', {"a": None, "b": 2}),
    ('["a" 1]', ["a", 1]),
    # Comments
    ('{"a": 1, // first\n "b": 2}', {"a": 1, "b": 2}),
    ('{/* both */ "a": 1, "b": /* two */ 2}', {"a": 1, "b": 2}),
    ('{"a": 1, # first\n "b": 2}', {"a": 1, "b": 2}),
    ('{"a": "no // comment", "b": "http://x.org/#y"}', {"a": "no // comment", "b": "http://x.org/#y"}),
    # Quotes
    ("{'a': 'it\\'s', 'b': 'x \"y\" z'}", {"a": "it's", "b": 'x "y" z'}),
    ("{'a': 'it's late', 'b': 1}", {"a": "it's late", "b": 1}),
    ('{"a": "he said "hi" to me"}', {"a": 'he said "hi" to me'}),
    ('{"a": "he said "hi", then left", "b": 1}', {"a": 'he said "hi", then left', "b": 1}),
    ('{"a": "the word "x""}', {"a": 'the word "x"'}),
    ("{“a”: “x”, “b”: ‘y’}", {"a": "x", "b": "y"}),
    ('{"a": "two\nlines\tand"}', {"a": "two\nlines\tand"}),
    ('{"a": "C:\\dir \\u00e9 \\n"}', {"a": "C:\\dir é \n"}),
    # Bare keys, values and words
    ("{a: 1, b_c: x}", {"a": 1, "b_c": "x"}),
    ("{a: some words here, b: 2}", {"a": "some words here", "b": 2}),
    ("{'a': True, 'b': None, 'c': False}", {"a": True, "b": None, "c": False}),
    ("[.5, +1, 1e3, -2.50, 12ab]", [0.5, 1, 1000.0, -2.5, "12ab"]),
    ("{a: http://x.org/y, b: 1}", {"a": "http://x.org/y", "b": 1}),
    # Cut off, or closed the wrong way
    ('{"a": [1, 2', {"a": [1, 2]}),
    ('{"a": "hel', {"a": "hel"}),
    ('{"a": 1, "b":', {"a": 1}),
    ('{"a": 1, "b', {"a": 1}),
    ('{"a": 1, "b": tru', {"a": 1, "b": "tru"}),
    ('{"a": "x\\', {"a": "x"}),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('{"a": {"b": 1], "c": 2}', {"a": {"b": 1}, "c": 2}),
    ("{", {}),
    ("[", []),
    # Nothing to mend
    ("no JSON here", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize(("text", "value"), DAMAGED)
def test_damaged_texts(text, value):
    assert repaired(text) == value


def test_sound_json_comes_back_as_it_is():
    rng = random.Random(3)

    def some(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 4:
            return [some(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 5:
            return {f"k{i} ": some(depth - 1) for i in range(rng.randrange(4))}
        return [rng.randrange(-9, 9), rng.choice(["", "x, y", 'q "r"', "é\n\\ 🙂", "a: b", "{[", "//"]), None, rng.random() < 0.5][kind]

    for _ in range(300):
        value = [some(4)]
        text = json.dumps(value, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        assert repaired(text) == value
        # Words in front make the mending parser read it.
        assert repaired("Answer: " + text[:-1]) == value


def test_any_cut_gives_a_value_and_long_texts_end():
    text = json.dumps({"a": [1, "x \" y", {"b": None}], "c": "é", "d": {"e": [True, "z"]}})
    for cut in range(1, len(text)):
        assert isinstance(repaired(text[:cut]), dict)
    assert repaired("[" * 50_000) is None and repaired("[" * 50_000 + "]" * 50_000) is None
    assert repaired("[" * 150 + "1") is not None
    assert len(repaired("[" + '"a "b" c" ' * 20_000)) >= 1
