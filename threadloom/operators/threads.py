"""Thread operators: ancestor closures, thread layout, and the nested contexts of users as JSON.

Closures work on whole tables by path doubling: a jump table holds, for each comment, the ancestor 2**k replies up;
joining it with itself doubles the reach, so depth d takes log2(d) rounds. Every round is written to the shared folder.
Contexts hold the user's comments and their ancestors, not the thread; a context is one row, its JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import expr as E
from threadloom.operators import nested
from threadloom.operators.authors import keep_first
from threadloom.operators.ordered import ranked
from threadloom.schema import CONTEXT_COMMENT_COLUMNS, CONTEXT_SUBMISSION_COLUMNS, USER_CONTEXT, require_columns
from threadloom.tables import counted, stored


def user_links(comments: DataFrame, users: DataFrame) -> DataFrame:
    """Different (user, link_id) of the users' comments in submissions. users has a column `user`."""
    own = comments.where(F.col("link_id").startswith("t3_")).select(F.col("author").alias("user"), "link_id")
    return own.join(users.select("user").distinct(), "user", "left_semi").distinct()


def in_links(comments: DataFrame, links: DataFrame) -> DataFrame:
    """Comments of the links' threads (a semi join; nothing is collected)."""
    return comments.join(links.select("link_id").distinct(), "link_id", "left_semi")


def with_submissions(comments: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every comment with its submission's columns, prefixed submission_, null where the submission is missing."""
    prefixed = submissions.select(*(F.col(c).alias(f"submission_{c}") for c in submissions.columns))
    return comments.join(prefixed, E.submission_key(F.col("link_id")) == F.col("submission_id"), "left")


def reply_edges(comments: DataFrame) -> DataFrame:
    """(link_id, id, up): each comment's parent comment in the same thread; only parents that exist. First of an id counts."""
    unique = keep_first(comments.select("link_id", "id", "created_utc", "parent_id"), ["link_id", "id"], ["created_utc"])
    parent = F.when(E.id_kind(F.col("parent_id")) == "t1", E.id_key(F.col("parent_id")))
    edges = unique.select("link_id", "id", parent.alias("up")).where("up is not null")
    return edges.join(unique.select("link_id", F.col("id").alias("up")), ["link_id", "up"], "left_semi").select("link_id", "id", "up")


def _doubled(jumps: DataFrame) -> DataFrame:
    further = jumps.select("link_id", F.col("id").alias("up"), F.col("up").alias("top"))
    return jumps.join(further, ["link_id", "up"]).select("link_id", "id", F.col("top").alias("up"))


def closure(edges: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """start (by..., link_id, id) and all ancestors, for each value of `by`. Cycles are followed once round."""
    keys = [*by, "link_id", "id"]
    rows = {"n": F.count(F.lit(1))}
    reached, size = start.select(*keys).distinct(), None
    jumps, far = counted(edges, "jumps", **rows)
    while far["n"]:
        above = reached.join(jumps, ["link_id", "id"]).select(*by, "link_id", F.col("up").alias("id"))
        reached, grown = counted(reached.union(above).distinct(), "closure", **rows)
        if grown == size:
            break
        size, (jumps, far) = grown, counted(_doubled(jumps), "jumps", **rows)
    return reached


def ancestors(comments: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """Ancestors of a set of comments, those of the set itself left out."""
    return closure(reply_edges(comments), start, by).join(start.select(*by, "link_id", "id").distinct(), [*by, "link_id", "id"], "left_anti")


def own_comments(comments: DataFrame, users: DataFrame) -> DataFrame:
    """(user, link_id, id) of the users' comments in submissions."""
    own = comments.where(F.col("link_id").startswith("t3_")).select(F.col("author").alias("user"), "link_id", "id")
    return own.join(users.select("user").distinct(), "user", "left_semi")


def relevant(comments: DataFrame, users: DataFrame) -> DataFrame:
    """(user, link_id, id, own): the users' comments and all their ancestors; siblings and replies are left out."""
    threads = stored(in_links(comments, user_links(comments, users)).select("link_id", "id", "created_utc", "parent_id", "author"), "threads")
    own = stored(own_comments(threads, users).distinct(), "own")
    both = closure(reply_edges(threads), own, ["user"])
    mark = own.withColumn("own", F.lit(True))
    return both.join(mark, ["user", "link_id", "id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))


def is_root(parent_id: Column) -> Column:
    """Replies to the submission, and comments without a parent."""
    return parent_id.isNull() | (parent_id == "") | (E.id_kind(parent_id) == "t3")


def layout(comments: DataFrame, user: Column) -> DataFrame:
    """One row per comment: link_id, id, parent (null at the top), depth (0 at the top), place among its siblings by
    (created_utc, id), and the author masked for `user`. Comments in a reply cycle have no depth."""
    unique = stored(keep_first(comments.select(*CONTEXT_COMMENT_COLUMNS), ["link_id", "id"], ["created_utc"]), "layout")
    edges = stored(reply_edges(unique), "layout-edges")
    base = unique.select("link_id", "id").join(edges, ["link_id", "id"], "left")
    open_ = {"n": F.count("up")}
    hops, left = counted(base.select("link_id", "id", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth")), "hops", **open_)
    before = None
    while left["n"] and left != before:
        other = hops.select("link_id", F.col("id").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        hops = hops.join(other, ["link_id", "up"], "left").select(
            "link_id", "id", F.col("top").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        before, (hops, left) = left, counted(hops, "hops", **open_)
    depth = hops.select("link_id", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))
    rows = unique.join(depth, ["link_id", "id"]).join(edges.withColumnRenamed("up", "parent"), ["link_id", "id"], "left")
    slim = rows.select("link_id", "id", "parent", "depth", "created_utc", E.masked_author(F.col("author"), user).alias("user"))
    placed = ranked(slim, ["link_id", "parent"], [F.col("created_utc"), F.col("id")])
    return placed.select("link_id", "id", "parent", "depth", F.col("place").cast("int").alias("place"), "user")


def contexts(comments: DataFrame, submissions: DataFrame, users: DataFrame) -> DataFrame:
    """(user, submission_id, formatted_context, user_comment_ids) for every user and thread that they commented in.

    The context is the submission with the user's comments and their ancestors nested below it, the user masked as
    SUBJECT; threads without a known submission are dropped. Ids repeat at their first row only. user_comment_ids are in
    (created_utc, id) order. All users run in one plan.
    """
    require_columns(comments, CONTEXT_COMMENT_COLUMNS, "comments")
    require_columns(submissions, CONTEXT_SUBMISSION_COLUMNS, "submissions")
    wanted = relevant(comments, users)
    held = comments.select(*CONTEXT_COMMENT_COLUMNS).join(wanted.select("link_id", "id"), ["link_id", "id"], "left_semi")
    rows = wanted.join(keep_first(held, ["link_id", "id"], ["created_utc"]), ["link_id", "id"])
    rows = rows.select(
        "user",
        F.substring("link_id", 4, 1 << 30).alias("submission_id"),
        "id",
        F.when(E.id_kind(F.col("parent_id")) == "t1", E.id_key(F.col("parent_id"))).alias("parent"),
        is_root(F.col("parent_id")).alias("root"),
        F.col("created_utc").alias("at"),
        E.masked_author(F.col("author"), F.col("user")).alias("who"),
        E.epoch_text(F.col("created_utc")).alias("time"),
        F.coalesce("body", F.lit("")).alias("content"),
        "own",
    )
    in_time = [F.col("at").isNull().alias("late"), F.col("at"), F.col("id")]
    listed = nested.labelled(rows, ["user", "submission_id"], "id", "parent", "root", F.struct(*in_time))
    listed = listed.withColumn("depth", F.when(F.col("flat"), 1).otherwise(F.size("label")))
    node = F.struct("flat", "label", "depth", nested.opened("depth", "who", "time", "content").alias("text"))
    grouped = listed.groupBy("user", "submission_id").agg(
        F.transform(F.array_sort(F.collect_list(node)), lambda n: F.struct(n["depth"].alias("depth"), n["text"].alias("text"))).alias("nodes"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("own"), F.struct(*in_time)))), lambda c: c["id"]).alias("user_comment_ids"),
    )
    known = keep_first(submissions.select(*CONTEXT_SUBMISSION_COLUMNS).where(F.col("title").isNotNull()), ["id"], ["created_utc"])
    content = E.submission_content(F.col("title"), F.coalesce("subreddit", F.lit("")), F.coalesce("selftext", F.lit("")))
    heads = known.select(F.col("id").alias("submission_id"), "author", E.epoch_text(F.col("created_utc")).alias("time"), content.alias("content"), F.lit(0).alias("depth"))
    whole = grouped.join(heads, "submission_id").withColumn("who", E.masked_author(F.col("author"), F.col("user")))
    head = F.struct("depth", nested.opened("depth", "who", "time", "content").alias("text"))
    return whole.select("user", "submission_id", nested.document(F.concat(F.array(head), "nodes")).alias("formatted_context"), "user_comment_ids").to(USER_CONTEXT)
