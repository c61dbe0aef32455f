"""Benchmark decontamination as a prefix-filtered set join, in DataFrame and SQL functions alone.

A window is WINDOW consecutive words of a benchmark item (an item of fewer words is one window). Its tokens are its
shingles of SHINGLE consecutive words (of a shorter window: all its words). A document holds the window only if it holds
every token, so one token is a sufficient prefix. A first pass over the texts counts the benchmark's tokens, which orders
them by rarity over the corpus; each window's rarest token is its prefix, and windows with a token that no document
holds drop out. The second pass joins the texts on prefix tokens alone. A token's place in the window then gives the one
position and length where the window could stand (positional and length bounds), and the words there are compared with
the window's, exactly, before anything leaves the pass. Each pass serves windows of all lengths; tokenising twice costs
less than a table of the words' hashes, which is twice as large as the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lower_ascii, materialize, unused

WINDOW = 13
SHINGLE = 5
#: Bytes of tokens or windows that one broadcast holds, about; a larger benchmark is joined block after block.
BLOCK = 1 << 25

# After A-Z have become small, the characters of words: digits, a-z and all beyond ASCII. (A class that names its members
# is matched about ten times as fast as one that names the others.)
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]++"


def words_of(text: Column) -> Column:
    """The words of a text, in order; of a null text none."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _places(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """Rows (keep..., at, n, token) for every place of the array column `words`, `at` from 0, and every length n: the
    token of the n words there, null where fewer are left. A row at -1, without a token, stands for the row itself.

    Shifted copies of the array of hashes are zipped and exploded, so tokens are formed inside generated code.
    """
    hashed = df.select(*keep, F.concat(F.array(F.lit(None).cast("long")), F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))
    # Shift i is the array without its first i entries; zipping pads with nulls.
    shifts = [F.slice("hashes", F.lit(i + 1), F.greatest(F.size("hashes") - i, F.lit(0))).alias(f"h{i}") for i in range(max(lengths))]
    rows = hashed.select(*keep, F.posexplode(F.arrays_zip(*shifts)).alias("place", "h")).withColumn("at", F.col("place") - 1)
    whole = lambda n: (F.col("at") >= 0) & F.col(f"h.h{n - 1}").isNotNull()
    tokens = [F.when(whole(n), F.xxhash64(F.lit(n), *(F.col(f"h.h{i}") for i in range(n)))) for n in lengths]
    if len(lengths) == 1:
        return rows.select(*keep, "at", F.lit(lengths[0]).alias("n"), tokens[0].alias("token"))
    named = F.array(*(F.struct(F.lit(n).alias("n"), t.alias("token")) for n, t in zip(lengths, tokens, strict=True)))
    return rows.select(*keep, "at", F.explode(named).alias("t")).select(*keep, "at", "t.n", "t.token")


def windows(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """Different windows of all items: win (words), items (of all items that hold it, `=` and the id as string, or nothing for the items
    without an id), len."""
    name = F.coalesce(F.concat(F.lit("="), F.col(item_col).cast("string")), F.lit(""))
    words = benchmark.select(name.alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("win"))
    return cut.groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("len", F.size("win"))


def _parts(df: DataFrame, size: Column) -> list[DataFrame]:
    """df, whose rows take `size` bytes, in blocks of about BLOCK bytes, by token: each is bounded, together they are df."""
    n = -(-(df.agg(F.sum(size)).first()[0] or 0) // BLOCK)
    return [df.where(F.pmod(F.xxhash64("token"), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_hit (words inside any occurrence of any window), n_items
    (items with occurring windows), items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    Null texts and texts without words have no hits and are clean. Items without words are ignored.
    Items without an id contaminate as others do; together they count as one item, and items_sha256 leaves them out. An empty benchmark leaves all documents clean; an empty table gives no rows. Rows are told apart by (id, text
    hash), so repeated rows each get their row. Other columns are dropped.
    """
    key = F.xxhash64(F.col(text_col))
    words = words_of(F.col(text_col))
    own = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), words.alias("words"))
    wins = materialize(windows(benchmark, window, item_col, item_text_col), "decon-windows")
    lengths = sorted(r[0] for r in wins.select(F.least("len", F.lit(shingle)).alias("n")).distinct().collect())  # at most `shingle` values
    if not lengths:
        none = own.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"))
        return _report(none.withColumn("spans", F.array().cast("array<struct<a:int,b:int>>")).withColumn("items", F.array().cast("array<string>")))
    size = F.least("len", F.lit(shingle))
    tokens = _places(wins.withColumn("words", F.col("win")), lengths, "win", "items", "len")
    tokens = materialize(tokens.where((F.col("n") == size) & F.col("token").isNotNull()), "decon-tokens")

    # First pass: how often the corpus holds each token.
    asked = _parts(tokens.select("token").distinct(), F.lit(16))
    seen = [_places(own, lengths).select("token").join(F.broadcast(block), "token").groupBy("token").agg(F.count("*").alias("often")) for block in asked]
    counts = materialize(reduce(DataFrame.unionAll, seen), "decon-counts")

    # The prefix: of each window its rarest token; windows with a token that no document holds drop out.
    complete = tokens.join(counts, "token").groupBy("win").agg(
        F.min(F.struct("often", "token", "at")).alias("p"), F.count("*").alias("k"), F.first("items").alias("items"), F.first("len").alias("len"), F.first("n").alias("n")
    )
    anchors = complete.where(F.col("k") == F.col("len") - F.col("n") + 1)
    anchors = materialize(anchors.select(F.col("p.token").alias("token"), F.col("p.at").alias("off"), "win", "items", "len"), "decon-anchors")

    # Second pass: every place that holds a prefix token and the whole window around it. One more row for each document
    # carries its number of words.
    weight = 64 + F.length(F.array_join("win", "  ")) + F.length(F.array_join("items", "  "))
    found = []
    for i, block in enumerate(_parts(anchors, weight)):
        at = _places(own, lengths, "doc_id", "text_key", "words").join(F.broadcast(block.withColumnRenamed("token", "t")), F.col("token") == F.col("t"), "left")
        start = F.col("at") - F.col("off")
        same = (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")) == F.col("win"))
        at = at.withColumn("held", F.col("t").isNotNull() & same).withColumn("base", (F.col("at") == -1) & (F.col("n") == (lengths[0] if i == 0 else 0)))
        span = F.when(F.col("held"), F.struct(start.alias("a"), (start + F.col("len")).alias("b")))
        found.append(at.where("held or base").select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), "base", span.alias("span"), "items"))
    places = materialize(reduce(DataFrame.unionAll, found), "decon-places")
    by_doc = places.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("base").cast("int")).cast("int").alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    return _report(by_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def _report(df: DataFrame) -> DataFrame:
    """Covered words from sorted spans (a, b), in one pass over each document's spans, and the items' digest."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        state,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["end"]), F.lit(0))).cast("long").alias("n"), F.greatest(s["end"], x["b"]).alias("end")
        ),
        lambda s: s["n"],
    )
    n_hit = F.coalesce(covered, F.lit(0).cast("long"))
    items = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    out = df.select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), items.alias("items"))
    return out.select(
        "doc_id",
        "text_key",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.transform(F.filter("items", lambda i: i != ""), lambda i: F.substring(i, 2, 1 << 30)), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **kwargs).where("contaminated")
    doc, own = unused(docs, "_d", "_k")
    bad = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(own)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(text_col)) == F.col(own)), "left_anti")
