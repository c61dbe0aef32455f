"""User similarity by nearest neighbours and two text models: a teacher labels candidates, a judge checks the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import expr as E
from threadloom.operators.similarity import top_k
from threadloom.sources.clients import TextClient, completed


def label_candidates(
    queries: DataFrame, users: DataFrame, k: int, teacher: TextClient, judge: TextClient, teacher_model: str, judge_model: str
) -> DataFrame:
    """(query, candidates, teacher_output, judge_output, error) for each query row.

    users has vec_id, author, formatted_comment and embedding. Candidates are the k nearest by cosine, nearest first.
    """
    near = top_k(queries, users, k)
    named = near.join(users.select(F.col("vec_id").alias("neighbour"), "author", "formatted_comment"), "neighbour")
    line = E.said_line(F.col("author"), F.col("formatted_comment"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "similarity", "author", line.alias("line"))))
    grouped = named.groupBy("query").agg(ordered.alias("c")).select(
        "query",
        F.transform("c", lambda s: F.struct(s["author"].alias("author"), s["similarity"].alias("distance"))).alias("candidates"),
        F.array_join(F.transform("c", lambda s: s["line"]), "").alias("shown"),
    )
    own = queries.select(F.col("vec_id").alias("query"), E.said_line(F.col("author"), F.col("formatted_comment")).alias("own"))
    labels = ", ".join(E.SIMILARITY_SCORES)
    ask = F.concat(F.lit(f"Label how similar each candidate is to the user ({labels}).\n\nUSER:\n"), "own", F.lit("CANDIDATES:\n"), "shown")
    asked = grouped.join(own, "query").withColumn("prompt_text", ask).withColumn("model", F.lit(teacher_model))
    taught = completed(asked, teacher).withColumnRenamed("raw", "teacher_output").withColumnRenamed("error", "teacher_error")
    check = F.concat(F.lit("Check these labels.\n\n"), "prompt_text", F.lit("\nLABELS:\n"), "teacher_output")
    judged = completed(taught.withColumn("prompt_text", check).withColumn("model", F.lit(judge_model)), judge)
    return judged.select("query", "candidates", "teacher_output", F.col("raw").alias("judge_output"), F.coalesce("teacher_error", "error").alias("error"))
