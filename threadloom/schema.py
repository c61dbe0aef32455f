"""Table schemas of conversation dumps and of what the library makes of them."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}


def _struct(**columns: str) -> T.StructType:
    """`name="long!"` is a required column."""
    return T.StructType([T.StructField(name, _TYPES[kind.rstrip("!")], not kind.endswith("!")) for name, kind in columns.items()])


# Column names and types of the dumps.
COMMENTS = _struct(
    id="string", author="string", link_id="string", parent_id="string", created_utc="long!", subreddit="string", subreddit_id="string",
    body="string", score="long", distinguished="string", edited="string", stickied="boolean", retrieved_on="long!", gilded="long",
    controversiality="long", author_flair_css_class="string", author_flair_text="string",
)
SUBMISSIONS = _struct(
    id="string", url="string", permalink="string", author="string", created_utc="long!", subreddit="string", subreddit_id="string",
    selftext="string", title="string", num_comments="long", score="long", is_self="boolean", over_18="boolean", distinguished="string",
    edited="string", domain="string", stickied="boolean", locked="boolean", quarantine="boolean", score_hidden="boolean",
    retrieved_on="long!", author_flair_css_class="string", author_flair_text="string",
)

CONTEXT_COMMENT_COLUMNS = ("id", "author", "link_id", "parent_id", "body", "created_utc")
CONTEXT_SUBMISSION_COLUMNS = ("id", "subreddit", "title", "selftext", "is_self", "author", "created_utc")

USER_CONTEXT = T.StructType(
    [
        T.StructField("user", T.StringType()),
        T.StructField("submission_id", T.StringType()),
        T.StructField("formatted_context", T.StringType()),
        T.StructField("user_comment_ids", T.ArrayType(T.StringType())),
    ]
)


def require_columns(df, columns, what: str) -> None:
    """Raise ValueError naming the columns that df lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
