"""Column functions: ids, times, masks, token estimates, tagged results, vectors. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED = "[deleted]"
AUTO_MODERATOR = "AutoModerator"
SUBJECT = "SUBJECT"

#: White space as Python's str.split and str.strip know it.
_SPACE = r"\s\x1C-\x1F"
#: Seconds of the years 1 to 9999.
_SECONDS = (-62_135_596_800, 253_402_300_799)


def to_long(value: Column) -> Column:
    """Text to integer; what is no integer becomes null instead of an error."""
    return value.try_cast("bigint")


def epoch_timestamp(seconds: Column) -> Column:
    """Epoch seconds, text or number, as a timestamp; null for what is no integer or not within the years 1 to 9999."""
    number = to_long(seconds.cast("string"))
    return F.timestamp_seconds(F.when(number.between(*_SECONDS), number))


def epoch_text(seconds: Column) -> Column:
    """Epoch seconds as dd-MM-yyyy HH:mm in UTC; [unknown_time] for null, [invalid_time] where there is no such time."""
    # Days and minutes are taken from the number itself, so that the text is UTC whatever the session's time zone.
    at = F.unix_seconds(epoch_timestamp(seconds))
    day, minute = F.date_from_unix_date(F.floor(at / 86400).cast("int")), F.floor(F.pmod(at, F.lit(86400)) / 60)
    clock = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((minute % 60).cast("string"), 2, "0"))
    shown = F.coalesce(F.concat(F.date_format(day, "dd-MM-yyyy"), F.lit(" "), clock), F.lit("[invalid_time]"))
    return F.when(seconds.isNull(), F.lit("[unknown_time]")).otherwise(shown)


def approx_tokens(text: Column) -> Column:
    """A quarter of the code points."""
    return F.length(text) / F.lit(4)


def word_count(text: Column) -> Column:
    """Words between runs of white space."""
    return F.regexp_count(text, F.lit(f"(?U)[^{_SPACE}]+"))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def id_kind(full_id: Column) -> Column:
    """`t1` of `t1_abc`; null where there is no underscore."""
    return F.when(full_id.contains("_"), F.substring_index(full_id, "_", 1))


def id_key(full_id: Column) -> Column:
    """`abc` of `t1_abc`: all behind the first underscore."""
    return F.when(full_id.contains("_"), F.element_at(F.split(full_id, "_", 2), 2))


def submission_key(link_id: Column) -> Column:
    """The submission's id behind `t3_`; null for other links."""
    return F.when(link_id.startswith("t3_"), F.substring(link_id, 4, 1 << 30))


def masked_author(author: Column, user: Column) -> Column:
    """SUBJECT for the user, exactly matched; [unknown] for a null author."""
    return F.when(author == user, F.lit(SUBJECT)).otherwise(F.coalesce(author, F.lit("[unknown]")))


def submission_content(title: Column, subreddit: Column, selftext: Column) -> Column:
    return F.concat(F.lit("Title: "), title, F.lit("\nSubreddit: "), subreddit, F.lit("\nBody: "), selftext)


def community_line(subreddit: Column, body: Column) -> Column:
    return F.concat(F.lit("r/"), subreddit, F.lit(": "), body)


def said_line(author: Column, text: Column) -> Column:
    return F.concat(F.lit("User '"), author, F.lit("' said: "), text, F.lit("\n\n"))


def is_person(author: Column) -> Column:
    """Neither deleted nor the moderator, and no `bot` in any case; null for a null author, so filters drop it."""
    return ~author.isin(DELETED, AUTO_MODERATOR) & ~author.rlike("(?i)bot")


def is_person_by_case(author: Column) -> Column:
    """As is_person, but only `bot` and `Bot` count."""
    return ~author.isin(DELETED, AUTO_MODERATOR) & ~author.rlike("bot|Bot")


def is_target(author: Column) -> Column:
    """Authors worth sampling: present, not deleted, name not ending in Bot or bot."""
    return author.isNotNull() & (author != "") & (author != DELETED) & ~author.endswith("Bot") & ~author.endswith("bot")


def result_tag(text: Column) -> Column:
    """The last <result>...</result> in a text, trimmed of white space; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<result>(.*?)</result>"), F.lit(1))
    return F.regexp_replace(F.try_element_at(found, F.lit(-1)), f"(?U)^[{_SPACE}]+|[{_SPACE}]+$", "")


def json_keys(text: Column) -> Column:
    """Keys of a JSON object; null for other or broken JSON."""
    return F.json_object_keys(text)


def prompt_input(prompt: Column, data: Column, suffix: str = "") -> Column:
    return F.concat(prompt, F.lit("\n\nINPUT DATA:\n---\n"), data, F.lit("\n---"), F.lit(suffix))


def safe_name(name: Column) -> Column:
    """A name for files: all but letters and digits become underscores."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    """Replace every key by its value, the longest keys first."""
    return reduce(lambda t, k: F.replace(t, F.lit(k), F.lit(pairs[k])), sorted(pairs, key=len, reverse=True), text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


# Scores of similarity labels.
SIMILARITY_SCORES = {"Most Similar": 4, "Highly Similar": 3, "Somewhat Similar": 2, "Not Similar": 1}


def label_score(label: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SIMILARITY_SCORES.items() for x in pair))[label]
