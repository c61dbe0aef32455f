"""Secret scans: fixed base patterns plus corpus-wide ownership frequency.

Base spans come from three patterns. Candidates are the values of base spans and further opaque, mixed-class tokens.
Their hashes are counted over the whole corpus by distinct repositories and distinct owners: a value that EXAMPLE_OWNERS
owners hold, or EXAMPLE_REPOS repositories of whatever owners, is a widely copied example; one below both is
owner-specific and looks live. The values of owner-specific candidates, base or not, become spans of kind `live`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, unused

KINDS = ("assign", "access", "hex", "live")

# Fixed patterns of the base scan. A hex or access run is maximal, so its least length can stand in the pattern;
# an assignment's cannot, as a short match still consumes its text.
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

LEAST_ENTROPY = 3.5
#: A value is a widely copied example from so many distinct owners on, or from so many distinct repositories on.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 1000

_SCAN = (
    "doc_id string, owner string, repo string, text_key string, n_assign long, n_access long, n_hex long, base string, "
    "cands array<struct<kind:string,start:long,stop:long,at:long,hash:string>>"
)


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the three base kinds, in code points, unordered between kinds.

    An assignment's span is its whole match; its value (the part after the sign) ends the match.
    """
    out = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return out


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def opaque_spans(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Tokens of 20 characters or more with a digit, both cases and high entropy that touch no base span."""
    out = []
    spans, at, reach = sorted(s[:2] for s in taken), 0, 0
    for m in OPAQUE.finditer(text):
        value = m[0]
        if not (any(c.isdigit() for c in value) and value.lower() != value and value.upper() != value):
            continue
        # Both lists are in order and reach is the farthest end of the base spans that start before this token's end.
        while at < len(spans) and spans[at][0] < m.end():
            reach, at = max(reach, spans[at][1]), at + 1
        if reach <= m.start() and entropy(value) >= LEAST_ENTROPY:
            out.append((m.start(), m.end(), value))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind as listed in KINDS, comma-joined."""
    return ",".join(f"{kind}:{start}:{stop}" for start, stop, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, owner, repo, text in zip(frame.doc_id, frame.owner, frame.repo, frame.text, strict=True):
            text = text or ""
            base = base_spans(text)
            kinds = Counter(kind for _, _, kind, _ in base)
            found = [*base, *((a, b, "live", value) for a, b, value in opaque_spans(text, base))]
            cands = [{"kind": kind, "start": a, "stop": b, "at": b - len(value), "hash": _digest(value)} for a, b, kind, value in found]
            rows.append((doc_id, owner, repo, _digest(text), kinds["assign"], kinds["access"], kinds["hex"], joined([s[:3] for s in base]), cands))
        yield pd.DataFrame(rows, columns=["doc_id", "owner", "repo", "text_key", "n_assign", "n_access", "n_hex", "base", "cands"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per document with base counts, base spans and all candidates (a table in the shared folder)."""
    rows = docs.select(
        F.col(id_col).cast("string").alias("doc_id"),  # numbers with nulls would come to pandas as floats
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        F.col(text_col).alias("text"),
    )
    return materialize(rows.mapInPandas(_scan, _SCAN).withColumn("doc_id", F.col("doc_id").cast("long")), "secrets-scan")


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, repos, owners, occurrences: distinct repositories and owners per candidate value over the whole corpus.

    Three nested aggregations, each with map-side partials, so that a value in a third of all documents never meets
    in one task as rows. A null owner or repository counts as one of its own.
    """
    spans = scanned.select("owner", "repo", F.explode("cands").alias("c")).select("owner", "repo", F.col("c.hash").alias("hash"))
    by_repo = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.sum("n").alias("occurrences"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None, keyed: bool = False, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, owned (candidates that are
    owner-specific), examples (those whose value example_owners owners or example_repos repositories hold, or more).

    Null text is empty text; an empty table gives no rows; repeated rows each get their row; null ids are kept.
    Rows are matched by (id, text hash), so rows that share an id but not a text stay apart.
    Without a repository column every document counts as a repository. Other columns are dropped; keyed adds text_key, the
    first half of the text's SHA-256.
    """
    scanned = scan(docs, id_col, text_col, owner_col, repo_col)
    spans = scanned.select("doc_id", "text_key", F.explode("cands").alias("c")).distinct().select("doc_id", "text_key", "c.*")
    known = spans.join(ownership(scanned), "hash")
    owned = (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    by_doc = known.groupBy("doc_id", "text_key").agg(
        F.array_union(
            F.collect_set(F.when(F.col("kind") != "live", F.struct("start", "stop", "kind"))),
            F.collect_set(F.when(owned, F.struct(F.col("at").alias("start"), "stop", F.lit("live").alias("kind")))),
        ).alias("kept"),
        F.sum(owned.cast("long")).alias("owned"),
        F.sum((~owned).cast("long")).alias("examples"),
    )
    order = F.transform(
        F.array_sort(F.transform("kept", lambda s: F.struct(s["start"].alias("a"), _rank(s["kind"]).alias("r"), s["stop"].alias("b"), s["kind"].alias("k")))),
        lambda s: F.concat_ws(":", s["k"], s["a"], s["b"]),
    )
    per_doc = by_doc.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.array_join(order, ",").alias("spans"), "owned", "examples")
    joined_back = scanned.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    return joined_back.select(
        "doc_id",
        *(["text_key"] if keyed else []),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("owned", F.lit(0)).cast("long").alias("owned"),
        F.coalesce("examples", F.lit(0)).cast("long").alias("examples"),
    )


def _rank(kind):
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


MASK = "[SECRET]"


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """text with each maximal run of overlapping or touching spans replaced by MASK."""
    out, at = [], 0
    for start, stop in sorted(spans):
        if start > at or not out:
            out += [text[at:start], MASK]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def mask_live(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """docs, all rows and columns, with owner-specific values in texts replaced by MASK; copied examples stay.

    Rows find their spans by (id, text hash); texts without such values come through unchanged, nulls as nulls.
    """
    doc, own, named = unused(docs, "_d", "_k", "_spans")
    found = find_secrets(docs, id_col, text_col, owner_col, repo_col, keyed=True).where(F.col("owned") > 0)
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(own), F.col("spans").alias(named)).distinct()
    key = F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), 1, 32)
    hit = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (key == F.col(own)), "left")

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            out = []
            for text, named in zip(texts, spans, strict=True):
                live = [tuple(map(int, s.split(":")[1:])) for s in named.split(",") if s.startswith("live:")] if named else []
                out.append(mask(text, live) if live else text)
            yield pd.Series(out, dtype=object)

    return hit.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col), F.col(named))).drop(doc, own, named)
