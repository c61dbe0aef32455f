"""Document fingerprints: Merkle trees over paragraphs and sections, in DataFrame functions alone.

A text is cut into paragraphs (after newlines and after sentence ends, and longer ones after every PIECE characters),
so its leaves follow its content and an edit moves the leaves of its own paragraph at most; a section ends after a
paragraph whose own hash falls into one of eight classes, or at the end. Leaves are SHA-256 of paragraphs, a section is
the SHA-256 of its leaves and the root that of its sections, all over whole digests. The fingerprint is
`root:section.section...:leaf.leaf...`, shortened on output alone, so roots test equality. Where roots differ, leaves are
aligned in order by a longest rising run of shared leaves, and the branches that hold the others locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import materialize, partitions, unused
from threadloom.llm.ranges import range_of, splitters

ROOT, BRANCH, LEAF = 32, 16, 8
PIECE = 32
#: After a newline, or after a sentence's end and the white space behind it.
BREAK = r"(?<=\n)|(?<=[.!?]\x20)"
_OPEN = "\x1f"


def paragraphs(text: Column) -> Column:
    """The pieces of a text, in order; together they are the text."""
    pieces = F.lit(f"(?s).{{1,{PIECE}}}")
    return F.flatten(F.transform(F.split(text, BREAK), lambda p: F.regexp_extract_all(p, pieces, F.lit(0))))


def leaves(text: Column) -> Column:
    return F.transform(paragraphs(text), lambda p: F.sha2(p, 256))


def _marked(hashes: Column) -> Column:
    """Leaves as one string in which a mark ends each section; whole digests or those of a fingerprint."""
    return F.array_join(F.transform(hashes, lambda h: F.when(F.substring(h, LEAF, 1).isin("0", "8"), F.concat(h, F.lit(_OPEN))).otherwise(h)), ".")


def _groups(hashes: Column) -> Column:
    """The leaves of each section, joined by dots."""
    return F.filter(F.split(_marked(hashes), rf"{_OPEN}\.?"), lambda g: g != "")


def sections(hashes: Column) -> Column:
    return F.transform(_groups(hashes), lambda g: F.sha2(g, 256))


def _printed(sections_: Column, leaves_: Column) -> Column:
    short = lambda hashes, n: F.array_join(F.transform(hashes, lambda h: F.substring(h, 1, n)), ".")
    return F.concat_ws(":", F.substring(F.sha2(F.array_join(sections_, "."), 256), 1, ROOT), short(sections_, BRANCH), short(leaves_, LEAF))


def with_fingerprints(df: DataFrame, **texts: str) -> DataFrame:
    """df with a fingerprint column, named by the keyword, of each non-null text column; the empty text has a root and
    nothing else. Leaves and sections are columns of their own on the way, so that each is made once."""
    kept = df.columns
    df = df.select(*kept, *(leaves(F.col(t)).alias(f"_l_{name}") for name, t in texts.items()))
    df = df.select("*", *(sections(F.col(f"_l_{name}")).alias(f"_s_{name}") for name in texts))
    return df.select(*kept, *(_printed(F.col(f"_s_{name}"), F.col(f"_l_{name}")).alias(name) for name in texts))


def fingerprint(text: Column) -> Column:
    """root:sections:leaves of a non-null text column, as one expression."""
    hashes = leaves(text)
    return _printed(sections(hashes), hashes)


def level(print_: Column, n: int) -> Column:
    """The hashes of level n of a fingerprint: 1 the sections, 2 the leaves."""
    return F.filter(F.split(F.element_at(F.split(print_, ":"), n + 1), r"\."), lambda h: h != "")


def _same(a: str, b: str) -> Column:
    return F.substring_index(F.col(a), ":", 1) == F.substring_index(F.col(b), ":", 1)


#: Bits of a leaf's place; above them one bit for the tree and 32 of the leaf.
_BITS = 30
_MASK = (1 << _BITS) - 1


def _with_pairs(df: DataFrame, **of: tuple[str, str]) -> DataFrame:
    """df with arrays of long, named by the keywords, of the leaves that two fingerprint columns share: (place in the first
    tree, place in the second) in one number, by the first place. The k-th occurrence of a leaf is paired with the k-th.

    Both trees' leaves are sorted as one array of longs, in which equal leaves of a tree stand together and those of the
    second tree follow those of the first; so this takes n log n for n leaves, however often one repeats.
    """
    kept = df.columns
    number = lambda h: F.shiftleft(F.conv(h, 16, 10).cast("long"), _BITS + 1)
    merged = lambda a, b: F.sort_array(
        F.concat(
            F.transform(level(F.col(a), 2), lambda h, i: number(h) + i.cast("long")),
            F.transform(level(F.col(b), 2), lambda h, i: number(h) + F.lit(1 << _BITS) + i.cast("long")),
        )
    )
    group = lambda x: F.shiftright(x, _BITS)
    starts = lambda c: F.filter(F.transform(c, lambda x, p: F.when((p == 0) | (group(x) != group(F.get(c, p - 1))), p)), lambda p: p.isNotNull())

    def paired(c: Column, s: Column) -> Column:
        def of_group(p: Column, m: Column) -> Column:
            q, r = F.get(s, m + 1), F.coalesce(F.get(s, m + 2), F.size(c))
            both = group(F.get(c, q)) == group(F.get(c, p)) + 1
            first_tree = group(F.get(c, p)).bitwiseAND(F.lit(1)) == 0
            pair = lambda t: F.shiftleft(F.get(c, p + t).bitwiseAND(F.lit(_MASK)), _BITS) + F.get(c, q + t).bitwiseAND(F.lit(_MASK))
            return F.when(first_tree & both, F.transform(F.sequence(F.lit(0), F.least(q - p, r - q) - 1), pair)).otherwise(F.array().cast("array<long>"))

        return F.sort_array(F.flatten(F.transform(s, of_group)))

    all_, firsts = ({n: unused(df, f"{mark}_{n}")[0] for n in of} for mark in ("_c", "_g"))
    df = df.select(*kept, *(merged(a, b).alias(all_[n]) for n, (a, b) in of.items()))
    df = df.select("*", *(starts(F.col(all_[n])).alias(firsts[n]) for n in of))
    return df.select(*kept, *(paired(F.col(all_[n]), F.col(firsts[n])).alias(n) for n in of))


def _aligned(pairs: Column) -> Column:
    """The number of pairs in a longest run that rises in both trees: the least last places of rising runs of each length."""

    def step(tails: Column, pair: Column) -> Column:
        j = pair.bitwiseAND(F.lit(_MASK))
        longer = (F.size(tails) == 0) | (F.get(tails, F.size(tails) - 1) < j)
        put = F.transform(tails, lambda t, k: F.when((t > j) & ((k == 0) | (F.get(tails, k - 1) < j)), j).otherwise(t))
        return F.when(longer, F.concat(tails, F.array(j))).otherwise(put)

    return F.size(F.aggregate(pairs, F.array().cast("array<long>"), step))


def with_likeness(df: DataFrame, **of: tuple[str, str]) -> DataFrame:
    """df with the likeness of two fingerprint columns, from 0 to 1, named by the keyword: 1 for equal roots, else twice the
    leaves aligned in order over the leaves of both trees, repeats included, and always less than 1."""
    kept = df.columns
    leaves_ = lambda a, b: F.size(level(F.col(a), 2)) + F.size(level(F.col(b), 2))
    held = dict(zip(of, unused(df, *(f"_p_{n}" for n in of)), strict=True))
    df = _with_pairs(df, **{held[n]: ab for n, ab in of.items()})
    # Trees of different roots have a leaf at least; the bound is met only where shortened leaves collide.
    share = lambda n, a, b: F.least(2.0 * _aligned(F.col(held[n])), leaves_(a, b) - 1.0) / leaves_(a, b)
    return df.select(*kept, *(F.when(_same(a, b), F.lit(1.0)).otherwise(share(n, a, b)).alias(n) for n, (a, b) in of.items()))


def first_edit(a: Column, b: Column) -> Column:
    """The place (from 0) of the first leaf in which two fingerprints differ; null for equal leaves."""
    place = F.array_position(F.zip_with(level(a, 2), level(b, 2), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(place > 0, place - 1)


def _section_places(print_: Column) -> Column:
    """Of each leaf, the place of its section."""
    return F.flatten(F.transform(_groups(level(print_, 2)), lambda g, i: F.transform(F.split(g, r"\."), lambda _: i)))


def with_edits(df: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """df with a struct of where two fingerprint columns differ: sections and leaves of a, then other_sections and
    other_leaves of b, all places from 0.

    Equal roots end it. Else leaves are aligned in order; those left over are the edits, and the sections that hold them
    the branches that differ. So moved, swapped, repeated and dropped pieces are found in one tree or in both.
    """
    # A user's columns wait in a struct, so that none of their names meets one in use here.
    df = df.select(F.struct(*df.columns).alias("_row"), F.col(a).alias("_x"), F.col(b).alias("_y"))
    a, b = "_x", "_y"
    state = "struct<tails: array<long>, piles: array<int>>"

    def step(s: Column, pair: Column) -> Column:
        j = pair.bitwiseAND(F.lit(_MASK))
        pile = F.size(F.filter(s["tails"], lambda t: t < j))
        tails = F.when(pile == F.size(s["tails"]), F.concat(s["tails"], F.array(j))).otherwise(F.transform(s["tails"], lambda t, k: F.when(k == pile, j).otherwise(t)))
        return F.struct(tails.alias("tails"), F.concat(s["piles"], F.array(pile)).alias("piles")).cast(state)

    # Backwards, the nearest pair of the pile before is the one on which the last one was put.
    chain = "struct<want: int, pairs: array<long>>"

    def back(s: Column, x: Column) -> Column:
        hit = x["pile"] == s["want"]
        pairs = F.when(hit, F.concat(s["pairs"], F.array(x["pair"]))).otherwise(s["pairs"])
        return F.struct((s["want"] - F.when(hit, 1).otherwise(0)).alias("want"), pairs.alias("pairs")).cast(chain)

    empty = lambda kind: F.array().cast(f"array<{kind}>")
    df = _with_pairs(df, _pairs=(a, b))
    df = df.withColumn("_runs", F.aggregate("_pairs", F.struct(empty("long").alias("tails"), empty("int").alias("piles")).cast(state), step))
    rows = F.reverse(F.zip_with("_pairs", F.col("_runs.piles"), lambda p, k: F.struct(p.alias("pair"), k.alias("pile"))))
    start = F.struct((F.size("_runs.tails") - 1).alias("want"), empty("long").alias("pairs")).cast(chain)
    df = df.withColumn("_kept", F.aggregate(rows, start, back, lambda s: s["pairs"]))

    def missed(print_: Column, place) -> Column:
        n = F.size(level(print_, 2))
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(empty("int"))
        return F.array_except(every, F.transform("_kept", lambda p: place(p).cast("int")))

    df = df.withColumn("_a", missed(F.col(a), lambda p: F.shiftright(p, _BITS))).withColumn("_b", missed(F.col(b), lambda p: p.bitwiseAND(F.lit(_MASK))))
    df = df.withColumn("_sa", _section_places(F.col(a))).withColumn("_sb", _section_places(F.col(b)))
    of = lambda places, sections_: F.array_distinct(F.transform(places, lambda i: F.get(sections_, i)))
    fields = {"sections": of("_a", F.col("_sa")), "leaves": F.col("_a"), "other_sections": of("_b", F.col("_sb")), "other_leaves": F.col("_b")}
    return df.select("_row.*", F.struct(*(F.when(_same(a, b), empty("int")).otherwise(c).alias(f) for f, c in fields.items())).alias(name))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; null text is empty text. A narrow pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprints(rows, fingerprint="text").select("doc_id", "fingerprint")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text against itself with its last floor(n/2) code points replaced by as many first ones of the next
    document in descending id order (after the last comes the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and first_edit, the place
    of the first leaf that the edit changed (null if none did). Null text is empty
    text; null ids come last in descending order; rows that repeat an id follow by text hash, descending, and equal
    rows in any order; a lone document is its own next one; an empty table gives no rows; other columns are dropped.

    Rows are dealt once, by ranges of ids of about equal bytes; each range also gets the first row
    of the range behind it, found by id, and the next row is a window's lead.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    size = F.octet_length("text").cast("long") + 64
    sizes = materialize(rows.select("doc_id", size.alias("size")), "merkle-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    bounds = splitters(sizes, "doc_id", F.col("size"), max(1, min(1 << 14, max(total // (24 << 20), min(partitions(spark), total // (1 << 20))))))

    # The first row of each range: ids are compared first, so that a text is looked at for one id a range alone.
    # What the driver holds is a number a range.
    ranged = rows.withColumn("range", range_of(F.col("doc_id"), bounds).cast("int"))
    tops = sizes.groupBy(range_of(F.col("doc_id"), bounds).cast("int").alias("r")).agg(F.max("doc_id").alias("top"))
    tied = ranged.join(F.broadcast(tops), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = tied.groupBy("range").agg(F.max(F.struct(F.sha2("text", 256).alias("h"), "text")).alias("t")).select(F.col("range").alias("then"), "t.text")
    falling = sorted((r[0] for r in tops.select("r").collect()), reverse=True)
    succession = spark.createDataFrame(list(zip(falling, falling[1:] + falling[:1], strict=True)), "range int, then int")
    behind = heads.join(F.broadcast(succession), "then").select(F.lit(None).cast("long").alias("doc_id"), "text", "range", F.lit(True).alias("behind"))

    # Each range is a task of its own and ends with the row that follows it, so texts are dealt once and never joined. A text
    # is fingerprinted once, behind the exchange; its predecessor takes both over.
    all_rows = ranged.withColumn("behind", F.lit(False)).unionByName(behind)
    dealt = with_fingerprints(all_rows.repartitionById(len(bounds) + 1, F.col("range")), fingerprint="text")
    order = [F.col("behind"), F.col("doc_id").desc_nulls_last(), F.sha2("text", 256).desc()]
    following = dealt.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(Window.partitionBy("range").orderBy(*order)))
    open_ = following.where(~F.col("behind"))

    half = F.shiftright("n_chars", 1).cast("int")
    own = open_.select("doc_id", "text", "next", "fingerprint", F.length("text").cast("long").alias("n_chars"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half))
    own = own.select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), edited.alias("edited"))
    printed = with_fingerprints(own, edited_fingerprint="edited")
    judged = with_likeness(printed, near_edited=("fingerprint", "edited_fingerprint"), near_next=("fingerprint", "next_fingerprint"))
    return judged.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        first_edit(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_edit"),
    )
