"""Leaderboards, length terciles and violation reports over long tables (sample, model, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.tables import stored

LOW, HIGH = 0.333, 0.667


def _scores() -> list[Column]:
    """Mean rank and count over ranked rows (rank > 0); share of correct ones among rows that were judged."""
    ranked, judged = F.col("rank") > 0, F.col("correct").isNotNull()
    return [
        F.avg(F.when(ranked, F.col("rank"))).alias("avg_rank"),
        F.count_if(ranked).alias("n_ranked"),
        F.try_divide(100.0 * F.count_if(F.col("correct")), F.count_if(judged)).alias("correct_pct"),
        F.count_if(judged).alias("n_judged"),
    ]


def leaderboard(verdicts: DataFrame, *by: str) -> DataFrame:
    """Scores per model (within `by`), the best mean rank first and unranked models last."""
    return verdicts.groupBy(*by, "model").agg(*_scores()).orderBy(*by, F.col("avg_rank").asc_nulls_last(), "model")


def terciles(lengths: DataFrame, length: str) -> DataFrame:
    """One row (q1, q2, low, high, n): the values at the nearest places to a third and two thirds, truncated to integers.

    Values are counted first, so the order is one over different values; the two that are wanted are found by running
    counts within value ranges, whose totals are the only thing brought together.
    """
    counted = lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("v")).agg(F.count("*").alias("c"))
    counted = stored(counted, "terciles")
    extent = counted.agg(F.min("v"), F.max("v"), F.sum("c")).first()
    low, high, n = extent
    spark = lengths.sparkSession
    schema = "q1 long, q2 long, low long, high long, n long"
    if not n:
        return spark.createDataFrame([], schema)
    picks = [_value_at(counted, round(q * (n - 1)), low, high) for q in (LOW, HIGH)]
    return spark.createDataFrame([(int(picks[0]), int(picks[1]), int(low), int(high), n)], schema)


def _value_at(counted: DataFrame, place: int, low, high, bins: int = 256):
    """The value at a place (from 0) of the sorted multiset: narrow down by histograms of `bins` rows."""
    before = 0
    while True:
        part = counted.where(F.col("v").between(low, high))
        if part.count() <= bins:
            for v, c in sorted(part.collect()):
                before += c
                if before > place:
                    return v
        width = (high - low) / bins
        spread = sorted(part.groupBy(F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("b")).agg(F.sum("c"), F.min("v"), F.max("v")).collect())
        for _, c, a, b in spread:
            if before + c > place:
                low, high = a, b
                break
            before += c


def tercile_of(length: Column, q1: Column, q2: Column) -> Column:
    """Short, Medium, Long; Equal for the middle where both bounds are the same."""
    by_two = F.when(length <= q1, "Short").when(length <= q2, "Medium").otherwise("Long")
    by_one = F.when(length < q1, "Short").when(length == q1, "Equal").otherwise("Long")
    return F.when(length.isNotNull(), F.when(q1 == q2, by_one).otherwise(by_two))


def leaderboard_by_tercile(verdicts: DataFrame, length: str = "input_length", least: int = 3) -> DataFrame:
    """Scores per length tercile and model; empty with fewer than `least` lengths. The bounds are a single row."""
    bounds = terciles(verdicts, length).where(F.col("n") >= least)
    bucketed = verdicts.where(F.col(length).isNotNull()).join(F.broadcast(bounds.select("q1", "q2")))
    return leaderboard(bucketed.withColumn("bucket", tercile_of(F.col(length), F.col("q1"), F.col("q2"))), "bucket")


def violation_summary(rows: DataFrame, count: str = "violation_count") -> DataFrame:
    """judged (count 0 or more), violations in all, their mean over judged rows; -1 marks rows that could not be judged."""
    n = F.col(count)
    return rows.agg(
        F.count_if(n >= 0).alias("judged"),
        F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).cast("long").alias("total"),
        F.avg(F.when(n >= 0, n)).alias("average"),
    )


def top_violations(rows: DataFrame, violations: str, n: int = 10) -> DataFrame:
    """The n most frequent keys of JSON objects; texts that are no objects count nothing. A top-k report."""
    keys = rows.select(F.explode(F.json_object_keys(violations)).alias("violation"))
    return keys.groupBy("violation").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "violation").limit(n)


def null_audit(rows: DataFrame, *columns: str) -> DataFrame:
    """Per column: how many values there are, and whether all are null."""
    row = rows.agg(*(F.count(c).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return row.selectExpr(f"stack({len(columns)}, {pairs}) as (column, present)").withColumn("all_null", F.col("present") == 0)


def unmask(rankings: DataFrame, masks: DataFrame) -> DataFrame:
    """(sample_id, model, rank): ranks from masked rankings.

    rankings has sample_id and ranking (an array of masks, or null), masks has sample_id, mask and model. Unknown masks
    drop out and later places move up; a mask that comes twice keeps its last place; models not named get -1.
    """
    placed = rankings.select("sample_id", F.posexplode("ranking").alias("at", "mask")).join(masks, ["sample_id", "mask"])
    ordered = placed.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "model"))), lambda s: s["model"]).alias("order"))
    ranks = ordered.select("sample_id", F.posexplode("order").alias("at", "model")).groupBy("sample_id", "model").agg((F.max("at") + 1).alias("rank"))
    return masks.select("sample_id", "model").distinct().join(ranks, ["sample_id", "model"], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
