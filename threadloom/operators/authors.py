"""Author analytics: activity, bot filters, token-budgeted histories, texts, histograms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions import expr as E
from threadloom.operators.ordered import ranked
from threadloom.operators.selection import summaries


def counts(rows: DataFrame, author: str = "author") -> DataFrame:
    return rows.groupBy(author).agg(F.count("*").alias("count"))


def token_totals(rows: DataFrame, author: str = "author", tokens: str = "token_count_approx") -> DataFrame:
    """Count and token sum per author, a sum of nothing being 0; bots and deleted authors are left out first."""
    return rows.where(E.is_person(F.col(author))).groupBy(author).agg(F.count("*").alias("count"), F.coalesce(F.sum(tokens), F.lit(0.0)).alias("tokens"))


def active(counted: DataFrame, least: int) -> DataFrame:
    return counted.where(F.col("count") >= least)


def budget_prefix(
    rows: DataFrame, budget: float, order: list[str], author: str = "author", tokens: str = "token_count_approx", slices: int = 32
) -> DataFrame:
    """Each author's longest prefix, in `order`, whose running token sum stays within the budget.

    Rows without a token count drop out first, as a running sum would carry on over them. Token counts are not negative.

    An author's rows are first trimmed in `slices` slices: to what lies within the budget there and the first row that
    goes beyond it, which carries the excess on into the sum over all slices. So an author with a third of all rows is
    spread over many tasks, and what meets in one task is `slices` budgets and rows at most.
    """
    known = rows.where(F.col(tokens).isNotNull()).withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))

    def running(df: DataFrame, *keys: str) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("running_tokens", F.sum(tokens).over(window))

    trimmed = running(known, author, "_slice").where(F.col("running_tokens") - F.col(tokens) <= budget)
    return running(trimmed.drop("running_tokens", "_slice"), author).where(F.col("running_tokens") <= budget)


def texts(rows: DataFrame, line: Column, order: list[str], author: str = "author", separator: str = "\n") -> DataFrame:
    """One text per author: its lines in order. Null lines are left out; an author without lines has an empty text."""
    gathered = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(*order, line.alias("_line")))))
    return rows.groupBy(author).agg(F.array_join(F.transform(gathered, lambda s: s["_line"]), separator).alias("formatted_comment"))


def text_parts(rows: DataFrame, line: Column, order: list[str], author: str = "author", separator: str = "\n", size: int = 1 << 20) -> DataFrame:
    """(author, part, formatted_comment): each author's lines in order, split into parts of about `size` characters.

    A part ends with the line that reaches its end, so it is longer than `size` by one line at most, and joining an
    author's parts with the separator gives texts(). Lines are laid out by running lengths over range-sorted rows, so an
    author of any size is spread over tasks and no part meets another. Null lines are left out, as are authors without
    lines. The order should be total.
    """
    lines = rows.select(author, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), line.alias("_line")).where("_line is not null")
    wide = F.length("_line") + len(separator)
    laid = ranked(lines, [author], [F.col(f"_o{i}") for i in range(len(order))], {"_until": wide}, place="_place")
    part = F.floor((F.col("_until") - wide) / size).cast("int")
    gathered = F.array_sort(F.collect_list(F.struct("_place", "_line")))
    return laid.groupBy(author, part.alias("part")).agg(F.array_join(F.transform(gathered, lambda s: s["_line"]), separator).alias("formatted_comment"))


def histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (from 0), low, high, freq, share: equal-width bins over the range, the last one closed.

    A range of one value is widened by a half on either side. Empty bins are left out.
    """
    binned = with_bins(values, value, bins)
    out = binned.groupBy("bin", "lo", "step").agg(F.count("*").alias("freq"))
    total = binned.agg(F.count("*").alias("total"))
    return out.join(F.broadcast(total)).select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("step")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"),
        "freq",
        (F.col("freq") / F.col("total")).alias("share"),
    )


def with_bins(values: DataFrame, value: str, bins: int) -> DataFrame:
    """values with lo, step and bin; the extent is a single row."""
    extent = values.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"))
    flat = F.col("a") == F.col("b")
    extent = extent.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), (F.when(flat, 1.0).otherwise(F.col("b") - F.col("a")) / bins).alias("step"))
    place = F.floor((F.col(value) - F.col("lo")) / F.col("step"))
    return values.where(F.col(value).isNotNull()).join(F.broadcast(extent)).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))


def top_members(counted: DataFrame, bins: int, listed: int = 10, author: str = "author") -> DataFrame:
    """Per bin of the counts: how many authors, and the first `listed` of them by count, then name; `, ...` marks more.

    Only each task's first `listed` rows of a bin are shuffled (a top-k per bin), besides its counts.
    """
    binned = with_bins(counted, "count", bins).select("bin", author, "count")
    first = Window.partitionBy("bin").orderBy(F.desc("count"), author)
    named = binned.withColumn("place", F.row_number().over(first)).where(F.col("place") <= listed)
    names = named.groupBy("bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", author))), lambda s: s[author]), ", ").alias("names"))
    sizes = binned.groupBy("bin").agg(F.count("*").alias("freq"))
    return sizes.join(names, "bin").select("bin", "freq", F.concat("names", F.when(F.col("freq") > listed, ", ...").otherwise("")).alias("members"))


def token_ratios(rows: DataFrame, text: str, tokens: Column) -> DataFrame:
    """Mean and exact median of characters and of words per token, one row; the medians by radix selection."""
    measured = rows.select(E.ratio(F.length(text), tokens).alias("chars"), E.ratio(E.word_count(F.col(text)), tokens).alias("words"))
    found = summaries(measured, ["chars", "words"])
    row = tuple(x for pair in found.values() for x in pair)
    return rows.sparkSession.createDataFrame([row], "mean_chars double, median_chars double, mean_words double, median_words double")


def sample_targets(rows: DataFrame, order: list[str], window: int, users: int, author: str = "author") -> DataFrame:
    """The first `users` different authors worth sampling among the first `window` rows in the stated order."""
    head = rows.orderBy(*order).limit(window).select(author, *order)
    firsts = head.where(E.is_target(F.col(author))).groupBy(author).agg(F.min(F.struct(*order)).alias("at"))
    return firsts.orderBy("at").limit(users).select(author)


def seeded_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows by the least MD5 of seed and key: the same for any partitioning and engine; fewer rows are all taken."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in key))), *key).limit(n)


def last_row(rows: DataFrame, order: str) -> DataFrame:
    """The row that comes last in a stated order."""
    return rows.orderBy(F.desc(order)).limit(1)


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order. Rows shrink to the first of a key in each task before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    picked = rows.groupBy(*key).agg(F.min(F.struct(*order, *(c for c in others if c not in order))).alias("_first"))
    return picked.select(*key, "_first.*").select(*rows.columns)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """All rows of frames with the same columns, types widened to a common one."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
