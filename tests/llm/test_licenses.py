import random

from hypothesis import given, settings
from hypothesis import strategies as st

from test_small import AWKWARD, docs_of
from threadloom.llm import licenses


@given(st.lists(st.sampled_from("abcdefgh"), max_size=30), st.lists(st.sampled_from("abcdefgh"), max_size=30))
@settings(max_examples=200, deadline=None)
def test_alignment_is_increasing_and_equal(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.align(a, a)) == len(a)


def brute_increasing(values):
    best = [1] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max([best[j] for j in range(i) if values[j] < v], default=0)
    return max(best, default=0)


@given(st.lists(st.integers(0, 50), max_size=30))
def test_longest_increasing(values):
    got = [values[i] for i in licenses.longest_increasing(values)]
    assert got == sorted(set(got)) and len(got) == brute_increasing(values)


def test_notices_are_found(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["under", "the", "license", "of", "river", "stone", "tree", "cloud"]) for _ in range(n))
    mit = licenses.TEMPLATES["mit-notice"][1]
    edited = mit.replace("free of charge", "at no cost").replace("merge, ", "")
    rows = [
        (100, f"{prose(3000)}\n{mit}\n{prose(3000)}\n{mit.upper()}"),
        (101, f"# {edited}"),
        (102, "Released under the MIT License. " + prose(20) + " Licensed under CC BY-NC 4.0."),
        (103, prose(5000)),
        (104, mit[:200]),
        *AWKWARD,
    ]
    got = {}
    for r in licenses.scan_licenses(docs_of(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r.matches)
    assert sum(map(len, got.values())) == len(rows)
    text = rows[0][1]
    assert [(m["name"], m.coverage) for m in got[100][0]] == [("mit-notice", 1.0)] * 2
    assert all(text[m.start : m.end].lower() == mit.lower() for m in got[100][0])
    assert [m["name"] for m in got[101][0]] == ["mit-notice"] and 0.8 <= got[101][0][0].coverage < 1
    assert [m["name"] for m in got[102][0]] == ["mit-line", "cc-by-nc-4.0-line"]
    assert got[103] == [[]] and got[104] == [[]] and got[1] == [[]] and got[6] == [[]]
    assert licenses.scan_licenses(docs_of(spark, rows).limit(0)).count() == 0


def test_prefilter_never_hides_a_match():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(5)
    for name, _, template, held in scanner.templates:
        for _ in range(50):
            kept = [w for w in template if rng.random() > 0.1]
            if len(licenses.align(template, kept)) >= 0.8 * len(template):
                assert any(w in kept for w in held), name


def test_occurrence_before_half_of_another():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(6)
    for name, _, template, _ in scanner.templates:
        n = len(template)
        for front in ([], ["river", "stone"] * 10):
            for _ in range(20):
                gone = set(rng.sample(range(n), int(n * 0.2)))
                edited = [w for i, w in enumerate(template) if i not in gone]
                alone = scanner.occurrences(template, edited)
                assert len(alone) == 1 and alone[0][0] == n - len(gone), name
                got = scanner.occurrences(template, front + edited + template[: n // 2])
                assert len(got) == 1 and got[0][0] >= 0.8 * n and got[0][1] >= len(front), name
                two = scanner.occurrences(template, front + edited + template)
                assert len(two) == 2 and two[1] == (n, len(front) + len(edited), len(front) + len(edited) + n - 1), name


@given(st.lists(st.sampled_from([*"abcdefgh", "abcde", "fgh", "abcdefghij", "xy"]), max_size=12), st.sampled_from([0.6, 0.8, 1.0]))
@settings(max_examples=200, deadline=None)
def test_occurrences_against_every_place(pieces, least):
    """Every window that covers the template overlaps an occurrence; occurrences cover it and differ in place."""
    template, doc = list("abcdefghij"), list("".join(pieces))
    got = licenses.Scanner({"t": ("T", " ".join(template))}, least).occurrences(template, doc)
    need, width = least * 10 - 1e-9, 10 + int(10 * (1 - least)) + 1
    for at in range(len(doc)):
        for end in range(at, min(len(doc), at + width) + 1):
            pairs = licenses.align(template, doc[at:end])
            if len(pairs) >= need:
                assert any(a <= at + pairs[-1][1] and at + pairs[0][1] <= b for _, a, b in got)
    for pairs, a, b in got:
        assert need <= pairs <= len(licenses.align(template, doc[a : b + 1])) + 1
    assert [a for _, a, _ in got] == sorted({a for _, a, _ in got})


def test_many_occurrences_take_linear_time():
    line = licenses.TEMPLATES["mit-line"][1]
    assert len(licenses.Scanner(licenses.TEMPLATES).scan(f"{line}\n" * 20_000)) == 20_000
