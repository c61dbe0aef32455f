import json
import random

import pytest

from threadloom.operators import threads

COLUMNS = "id string, author string, link_id string, parent_id string, body string, created_utc long"
SUBMISSION = "id string, subreddit string, title string, selftext string, is_self boolean, author string, created_utc long"


def comment(id, parent, author, at, link="t3_s1"):
    return (id, author, link, parent, f"<{id}>", at)


WORKED = [
    comment("c1", "t3_s1", "bob", 100),
    comment("c2", "t1_c1", "alice", 200),
    comment("c3", "t1_c2", "carol", 300),
    comment("c4", "t1_c1", "dave", 150),
    comment("c5", "t1_zz", "erin", 400),
    comment("c6", "t1_c5", "alice", 500),
    comment("c7", None, "alice", 50),
]


def frames(spark, rows, subs=(("s1", "r", "T", "B", True, "bob", 0),), users=("alice",)):
    return (
        spark.createDataFrame(rows, COLUMNS),
        spark.createDataFrame(list(subs), SUBMISSION),
        spark.createDataFrame([(u,) for u in users], "user string"),
    )


def node(user, time, content, *replies):
    return {"user": user, "time": f"01-01-1970 {time}", "content": content, "replies": list(replies)}


def test_worked_thread(spark):
    got = threads.contexts(*frames(spark, WORKED)).collect()
    assert len(got) == 1 and got[0].submission_id == "s1" and got[0].user_comment_ids == ["c7", "c2", "c6"]
    expected = [
        node(
            "bob", "00:00", "Title: T\nSubreddit: r\nBody: B",
            node("SUBJECT", "00:00", "<c7>"),
            node("bob", "00:01", "<c1>", node("SUBJECT", "00:03", "<c2>")),
            node("erin", "00:06", "<c5>"),
            node("SUBJECT", "00:08", "<c6>"),
        )
    ]
    assert got[0].formatted_context == json.dumps(expected, indent=2)


def test_ancestors_exclude_start(spark):
    comments, _, users = frames(spark, WORKED)
    got = threads.ancestors(comments, threads.own_comments(comments, users), ["user"])
    assert {r.id for r in got.collect()} == {"c1", "c5"}


def test_cycle_terminates_and_lies_flat(spark):
    rows = [comment("x", "t1_y", "alice", 10), comment("y", "t1_x", "bob", 5)]
    comments, subs, users = frames(spark, rows)
    assert {r.id for r in threads.relevant(comments, users).collect()} == {"x", "y"}
    tree = json.loads(threads.contexts(comments, subs, users).first().formatted_context)
    assert [n["content"] for n in tree[0]["replies"]] == ["<y>", "<x>"]
    assert {r.depth for r in threads.layout(comments, threads.F.lit("alice")).collect()} == {None}


@pytest.mark.parametrize("parent", ["t2_abc", "abc"])
def test_malformed_parent_is_an_orphan(spark, parent):
    comments, subs, users = frames(spark, [comment("a", parent, "alice", 1), comment("b", "t3_s1", "alice", 2)])
    tree = json.loads(threads.contexts(comments, subs, users).first().formatted_context)
    assert [n["content"] for n in tree[0]["replies"]] == ["<b>", "<a>"]


def test_no_rows_for_absent_users_missing_submissions_and_other_links(spark):
    rows = [comment("a", "t3_s9", "alice", 1, "t3_s9"), comment("b", "t3_s1", "alice", 1, "s1")]
    out = threads.contexts(*frames(spark, rows))
    assert out.columns == ["user", "submission_id", "formatted_context", "user_comment_ids"] and out.count() == 0
    assert threads.contexts(*frames(spark, WORKED, users=("nobody",))).count() == 0


def test_repeated_id_keeps_first_and_null_time_is_unknown(spark):
    rows = [comment("a", "t3_s1", "alice", 5), ("a", "alice", "t3_s1", "t3_s1", "later", 9), comment("n", "t3_s1", "alice", None)]
    tree = json.loads(threads.contexts(*frames(spark, rows)).first().formatted_context)
    assert [(n["content"], n["time"]) for n in tree[0]["replies"]] == [("<a>", "01-01-1970 00:00"), ("<n>", "[unknown_time]")]


def test_deep_chain_in_few_rounds(spark):
    rows = [comment("c0", "t3_s1", "bob", 0)] + [comment(f"c{i}", f"t1_c{i - 1}", "bob", i) for i in range(1, 300)]
    rows[-1] = comment("c299", "t1_c298", "alice", 299)
    comments, subs, users = frames(spark, rows)
    assert threads.relevant(comments, users).count() == 300
    text = threads.contexts(comments, subs, users).first().formatted_context
    assert text.count('"user"') == 301
    assert {r.id: r.depth for r in threads.layout(comments, threads.F.lit("x")).collect()}["c299"] == 299


def test_missing_columns_are_named(spark):
    comments, subs, users = frames(spark, WORKED)
    with pytest.raises(ValueError, match="body"):
        threads.contexts(comments.drop("body"), subs, users)


def by_hand(rows, user="alice"):
    """Nested nodes of (id, parent id or None for a top-level row, at, author, content)."""
    rows = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    time = lambda at: "[unknown_time]" if at is None else f"01-01-1970 00:{at // 60:02}"
    nodes = {r[0]: {"user": "SUBJECT" if r[3] == user else r[3], "time": time(r[2]), "content": r[4], "replies": []} for r in rows}
    reached, todo = [], [r[0] for r in rows if r[1] is None]
    for i in todo:
        reached.append(i)
        below = [r[0] for r in rows if r[1] == i]
        nodes[i]["replies"] = [nodes[c] for c in below]
        todo += below
    return [nodes[r[0]] for r in rows if r[1] is None] + [nodes[r[0]] for r in rows if r[0] not in reached]


TEXTS = ["plain", "", 'q"b\\s', "é\n\r\t\b\f\x00\x1f\x7f", "😀 ü\u2028", None]


def test_random_forests_against_dictionaries(spark):
    """Threads with orphans, cycles, ties and any characters: all comments are the user's, so all are in the context."""
    rng, comments, wanted = random.Random(4), [], {}
    for t in range(60):
        n, held = rng.randint(1, 14), []
        for i in range(n):
            parent = rng.choice([None, *(f"n{j}" for j in range(-1, n))]) if rng.random() < 0.6 else None
            at, text = rng.choice([None, 5, 70, 130]), rng.choice(TEXTS)
            held.append((f"n{i}", parent, at, "alice", text or ""))
            comments.append((f"n{i}", "alice", f"t3_{t}", "t3_x" if parent is None else f"t1_{parent}", text, at))
        wanted[str(t)] = held
    subs = [(str(t), "r", "Tß", "", True, "alice", 0) for t in wanted]
    got = {r.submission_id: r for r in threads.contexts(*frames(spark, comments, subs)).collect()}
    assert set(got) == set(wanted)
    for t, held in wanted.items():
        tree = [{"user": "SUBJECT", "time": "01-01-1970 00:00", "content": "Title: Tß\nSubreddit: r", "replies": by_hand(held)}]
        text = json.loads(got[t].formatted_context)
        tree[0]["content"] = text[0]["content"]
        assert got[t].formatted_context == json.dumps(tree, indent=2)
        assert list(got[t].user_comment_ids) == [r[0] for r in sorted(held, key=lambda r: (r[2] is None, r[2] or 0, r[0]))]


def test_layout_places_siblings_across_tasks(spark):
    rows = [comment("top", "t3_s1", "bob", 0)] + [comment(f"r{i}", "t1_top", "bob", i % 50) for i in range(900)]
    random.Random(2).shuffle(rows)
    comments, _, _ = frames(spark, rows)
    got = {r.id: r.place for r in threads.layout(comments, threads.F.lit("x")).collect()}
    expected = sorted((i % 50, f"r{i}") for i in range(900))
    assert [got[i] for _, i in expected] == list(range(900)) and got["top"] == 0
