"""Nested threads as JSON in column functions: pre-order labels give the order, differences in depth the brackets.

A comment's label lists what orders siblings, along the path from its top-level comment down to itself.
Labels are built by path doubling, so a thread of depth d takes log2(d) rounds, and sorting by them lists a tree in the
order of its JSON text. Each comment then writes its own fields and closes as many levels as the next one is higher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.tables import counted

#: JSON escapes of single characters (fixed values).
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
#: Characters that stand for themselves.
_PLAIN = r"[\x20\x21\x23-\x5B\x5D-\x7E]"


def quoted(text: str) -> str:
    """SQL of a JSON string in ASCII, as Python's json.dumps writes it, of a column; `null` for null."""
    unit = lambda n: f"concat(char(92), 'u', lpad(lower(hex({n})), 4, '0'))"
    code = "ascii(x)"
    short = " ".join(f"WHEN {ord(char)} THEN concat(char(92), char({ord(escape[1])}))" for char, escape in SHORT.items())
    wide = f"concat({unit(f'55296 + shiftright({code} - 65536, 10)')}, {unit(f'56320 + (({code} - 65536) & 1023)')})"
    other = f"CASE {code} {short} ELSE CASE WHEN {code} >= 65536 THEN {wide} ELSE {unit(code)} END END"
    each = f"transform(regexp_extract_all({text}, r'{_PLAIN}+|(?s).', 0), x -> CASE WHEN x RLIKE r'^{_PLAIN}' THEN x ELSE {other} END)"
    body = f"CASE WHEN {text} RLIKE r'^{_PLAIN}*$' THEN {text} ELSE array_join({each}, '') END"
    return f"coalesce(concat(char(34), {body}, char(34)), 'null')"


def labelled(rows: DataFrame, group: list[str], id_col: str, parent: str, root: str, order: Column) -> DataFrame:
    """rows with `label` and `flat`: sorting by (flat, label) within a group lists its trees in pre-order.

    `root` marks top-level rows, whatever their parent. Rows that no root reaches, in cycles or below a parent that is
    missing, are flat: they follow the trees, each on its own. (group, id) must be unique; siblings lie in `order`, which
    should be total, nulls first. A label is an array of the orders along the path, as long as the row is deep.
    """
    key = [*group, id_col]
    top = F.coalesce(F.col(root), F.lit(False))
    open_ = {"n": F.count("_up")}
    rows, left = counted(rows.withColumn("_up", F.when(~top, F.col(parent))).withColumn("_by", F.array(order)), "labels-rows", **open_)
    paths, before = rows.select(*key, "_up", F.col("_by").alias("label"), top.alias("_top")), None
    while left["n"] and left != before:
        above = paths.select(*group, F.col(id_col).alias("_up"), F.col("_up").alias("_next"), F.col("label").alias("_over"), F.col("_top").alias("_grounded"))
        longer = F.when(F.col("_over").isNotNull(), F.concat("_over", "label")).otherwise(F.col("label"))
        joined = paths.join(above, [*group, "_up"], "left")
        before = left
        paths, left = counted(joined.select(*key, F.col("_next").alias("_up"), longer.alias("label"), F.coalesce("_grounded", "_top").alias("_top")), "labels", **open_)
    flat = F.col("_up").isNotNull() | ~F.col("_top")
    labels = paths.select(*key, "label", flat.alias("flat"))
    joined = rows.drop("_up").join(labels, key)
    return joined.withColumn("label", F.when(F.col("flat"), F.col("_by")).otherwise(F.col("label"))).drop("_by")


def _pad(level: Column) -> Column:
    return F.repeat(F.lit("  "), level)


def _level(depth: Column) -> Column:
    """Indentation of an object `depth` replies below the submission."""
    return (1 + 2 * depth).cast("int")


def opened(depth: str, user: str, time: str, content: str) -> Column:
    """The fields of a node, up to its replies, from columns."""
    inner = f"repeat('  ', 2 + 2 * {depth})"
    field = lambda name, value: f"""{inner}, '"{name}": ', {quoted(value)}, ',', char(10)"""
    return F.expr(f"""concat(repeat('  ', 1 + 2 * {depth}), '{{', char(10), {field("user", user)}, {field("time", time)}, {field("content", content)}, {inner}, '"replies": [')""")


def closed(depth: Column, following: Column) -> Column:
    """What follows a node's fields: replies open if the next node is deeper; else this node and its ancestors end, down to
    the depth of the next one; `following` is null behind the last node."""
    upto = F.coalesce(following, F.lit(0))
    last = following.isNull()
    ends = F.transform(
        F.sequence(depth, F.least(upto, depth), F.lit(-1)),
        lambda d: F.concat(
            F.when(d == depth, F.lit("")).otherwise(F.concat(_pad(_level(d) + 1), F.lit("]\n"))),
            _pad(_level(d)),
            F.when((d == upto) & ~last, F.lit("},\n")).otherwise("}\n"),
        ),
    )
    return F.when(F.coalesce(following > depth, F.lit(False)), F.lit("\n")).otherwise(F.concat(F.lit("]\n"), F.array_join(ends, "")))


def document(nodes: Column) -> Column:
    """One-element JSON list of a tree, two spaces of indentation, from an array of (depth, text) in pre-order, text being
    opened()."""
    depths = F.transform(nodes, lambda n: n["depth"])
    following = F.concat(F.slice(depths, 2, F.size(nodes)), F.array(F.lit(None).cast("int")))
    pieces = F.zip_with(nodes, following, lambda n, f: F.concat(n["text"], closed(n["depth"], f)))
    return F.concat(F.lit("[\n"), F.array_join(pieces, ""), F.lit("]"))
