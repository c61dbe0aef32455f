"""Conversation tries against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from threadloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 string, m int"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[c].append(((turn is not None, turn or 0, key), role, text))
    seqs = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    cut = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - (abs(c) % 20) * (1 if c >= 0 else -1)
    return {c: seqs.get(base(c), [])[: cut(c)] + v[cut(c) :] for c, v in seqs.items()}


def by_hand(rows):
    members = defaultdict(list)
    seqs = rebuilt(rows)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
    out = set()
    for p, held in members.items():
        ends = ",".join(map(str, sorted(c for c in held if len(seqs[c]) == len(p))))
        out.add((min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2)[:7] for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in tries.rebuilt_trie(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == by_hand(rows)


def talks(seed, convs, longest, choices):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", None, ""]), pick.choice(choices)) for c in pick.sample(range(-40, 4 * convs), convs) for t in range(pick.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_random_talks(spark, seed):
    check(spark, talks(seed, 120, 6, ["a b", "", None, "é e  x\ty"]))


def test_trie_with_hot_groups_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    same = [(c, t, "user", f"turn {t}") for c in range(1000, 1160) for t in range(5)]
    ladder = [(c, t, "user", f"step {t}") for c in range(2000, 2040) for t in range(c - 1990)]
    long = [(7, t, "user", f"w{t} " * (t % 3)) for t in range(800)]
    check(spark, same + ladder + long)


def test_trie_of_odd_rows(spark):
    odd = [(None, 0, "user", "x"), (0, None, "u", "a"), (0, None, "u", "a"), (0, 1, "u", "b"), (0, 1, "u", "c"), (3, 5, None, None), (23, 0, "u", "x" * 50000), (-5, 0, "", ""), (2**62, 1, "u", "a")]
    check(spark, odd)
    check(spark, [])
    check(spark, [(None, None, None, None)])
