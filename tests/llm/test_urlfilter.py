"""URL rules against trying every rule on every URL."""

from __future__ import annotations

import random
import string

import numpy as np
import pytest

from threadloom.llm import urlfilter as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def by_hand(url, rules, default):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)]
        host = rest[: ends[0]].translate({ord(c): c.lower() for c in string.ascii_uppercase})
        path = rest[ends[0] :].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def check(spark, urls, rules, default="allow", **more):
    pages = spark.createDataFrame([(i, u, 1, "x", b"") for i, u in enumerate(urls)], "page_id long, url string, host int, digests string, rule binary").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, table, default=default, **more).collect()}
    assert got == {i: by_hand(u, rules, default) for i, u in enumerate(urls)}


ODD = [None, "", "no scheme", "://", "http://", "a://NET", "a://NET/", "a://x.NET/q?/en/", "a://Example.Net/en/b#c", "a://example.net/en", "a://notexample.com/de/", "a://m.example.com/de/?x",
    "a://b://c.org/fr/x", "http:// org/fr/", "a://.org/fr/", "a://o..org/fr/", "a://ÉX.org/fr/\n/x", "a://u@org:80/fr/", "a://org/fr/" + "y" * 100000, "a://" + "." * 5000 + "org/fr/", "x?://net/"]


@pytest.mark.parametrize("mapped", [1 << 20, 0])
def test_rules_and_odd_urls(spark, mapped):
    check(spark, ODD * 2, RULES, mapped=mapped)
    check(spark, ["a://b.c/d", None], [("b.c", "", "block"), ("c", "/dd", "allow")], mapped=mapped)


@pytest.mark.parametrize("mapped", [1 << 20, 0])
def test_many_rules(spark, mapped):
    pick = random.Random(8)
    labels, steps = ["a", "bb", "c-c", "é"], ["", "/", "/x", "/x/", "/x/yy", "/é/"]
    host = lambda most: ".".join(pick.choice(labels) for _ in range(pick.randint(1, most)))
    rules = list({(h, p): (h, p, pick.choice(["allow", "block"])) for h, p in ((host(3), pick.choice(steps)) for _ in range(60))}.values())
    urls = [f"http://{host(5)}{pick.choice(steps)}{pick.choice(['', 'z', '?q', '#f'])}" for _ in range(800)]
    check(spark, urls, rules, default="block", mapped=mapped)


def test_rules_are_cleaned(spark):
    rules = spark.createDataFrame([("A.b", None, "block"), ("a.b", "", "allow"), (None, "/", "block"), ("", "/", "block"), ("x", "y", "block"), ("z", "/", "maybe")], "host string, path string, verdict string")
    assert [tuple(r) for r in U.normalised(rules).collect()] == [("a.b", "", "block")]
    pages = spark.createDataFrame([(1, "q://w.a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in U.judge_urls(pages, rules).collect()] == [(1, "w.a.b", "/c", "a.b", "block")]
    assert [tuple(r) for r in U.judge_urls(pages, rules.limit(0), default="block").collect()] == [(1, "w.a.b", "/c", None, "block")]
    assert U.judge_urls(pages.limit(0), rules).collect() == []


def test_collisions_are_told_apart(tmp_path):
    """Two strings under one digest: both are found, the strings decide."""
    strings, (digests, ends) = [b"one", b"other", b"x"], (np.array([5, 5, 9], "<i8"), np.array([3, 8, 9], "<i8"))
    for part, data in (("digests", digests), ("ends", ends), ("numbers", np.array([1, 2, 3], "<i8")), ("strings", np.frombuffer(b"oneotherx", "u1"))):
        (tmp_path / f"t.{part}").write_bytes(data.tobytes())
    held = U.SortedDigests("t", lambda name: str(tmp_path / name))
    which, entries = held.find(np.array([9, 4, 5], "<i8"))
    assert which.tolist() == [0, 2, 2] and [held.string(e) for e in entries] == [strings[2], strings[0], strings[1]]
