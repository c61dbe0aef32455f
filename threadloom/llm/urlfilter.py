"""URL filters: rules for hosts and paths in arrays of sorted 64-bit digests, which tasks map into memory.

The rules' hosts and their host-and-path strings are two arrays. A URL's host suffixes are looked up in the first with a
binary search over a whole batch, and where a host is found, the path's prefixes of that host's rule lengths in the
second. Digests only find candidates: the stored strings are compared. The arrays are shipped as files, once an
executor, whose workers share the mapped pages; a list beyond a stated size is joined by digest instead.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import drop_table, lower_ascii, materialize, shared_dir

ALLOW, BLOCK = "allow", "block"
#: Bytes of rules, strings and numbers together, that are mapped into memory; longer lists are joined.
MAPPED = 256 << 20
#: Spark's seed for xxhash64.
SEED = 42


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both are empty for null and where `://` is missing."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def normalised(rules: DataFrame) -> DataFrame:
    """Different (host, path, verdict): hosts lower-cased, null paths empty; of two verdicts on one rule, block counts.

    Rules with a null or empty host, another verdict, or a path that no URL has (neither empty nor with a leading slash)
    drop out.
    """
    cleaned = rules.select(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    fit = (F.col("host") != "") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("verdict").isin(ALLOW, BLOCK)
    return cleaned.where(fit).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


class SortedDigests:
    """Sorted digests with their strings and a number each, mapped from files."""

    PARTS = (("digests", "<i8"), ("ends", "<i8"), ("numbers", "<i8"), ("strings", "u1"))

    def __init__(self, name: str, where) -> None:
        for part, kind in self.PARTS:
            path = where(f"{name}.{part}")
            with open(path, "rb") as f:
                size = f.seek(0, 2)
            setattr(self, part, np.memmap(path, kind, "r") if size else np.zeros(0, kind))

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (place in digests, entry) of equal digests."""
        low, high = np.searchsorted(self.digests, digests), np.searchsorted(self.digests, digests, "right")
        counts = high - low
        before = np.cumsum(counts) - counts
        return np.repeat(np.arange(len(digests)), counts), np.repeat(low - before, counts) + np.arange(counts.sum())

    def string(self, entry: int) -> bytes:
        return self.strings[self.ends[entry - 1] if entry else 0 : self.ends[entry]].tobytes()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        strings = [s.encode() for s in batch.column("string").to_pylist()]
        columns = [batch.column("digest").to_numpy(), np.array([len(s) for s in strings], dtype="<i8"), batch.column("number").to_numpy()]
        packed = [pa.array([c.astype("<i8").tobytes()], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([*packed, pa.array([b"".join(strings)], pa.binary())], names=[p for p, _ in SortedDigests.PARTS])


def ship(entries: DataFrame, name: str) -> str:
    """Sort entries (string, number) by digest and add them to the session's files; the size must be checked before.

    Batches pass through the driver one at a time, into the shared folder, from where executors fetch the files, those
    that come later included.
    """
    spark, name = entries.sparkSession, f"{name}-{uuid.uuid4().hex}"
    rows = entries.select(F.xxhash64("string").alias("digest"), F.col("number").cast("long").alias("number"), "string").orderBy("digest", "string", "number")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = {part: spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}.{part}") for part, _ in SortedDigests.PARTS}
    outs = {part: files.create(path) for part, path in paths.items()}
    total = 0
    try:
        for row in rows.mapInArrow(_packed, "digests binary, ends binary, numbers binary, strings binary").toLocalIterator():
            ends = np.cumsum(np.frombuffer(row["ends"], "<i8")) + total
            total = int(ends[-1])
            for part, data in (row.asDict() | {"ends": ends.astype("<i8").tobytes()}).items():
                if data:
                    outs[part].write(bytearray(data))
    finally:
        for out in outs.values():
            out.close()
    for path in paths.values():
        spark.sparkContext.addFile(files.makeQualified(path).toString())
    return name


@functools.lru_cache(maxsize=8)
def _mapped(name: str) -> SortedDigests:
    return SortedDigests(name, SparkFiles.get)


def best_rules(hosts: SortedDigests, rules: SortedDigests, host: list[str], path: list[str], digests: pa.ListArray, kinds: list[int]) -> tuple[list[str | None], list[str | None]]:
    """Rule and verdict of each URL. digests holds those of its host's suffixes, one for each number of labels in `kinds`
    (null where the host has fewer)."""
    flat = digests.flatten()
    there = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    width = len(kinds)
    which, entries = hosts.find(flat.take(pa.array(there)).to_numpy(zero_copy_only=False))
    urls, keys, sizes = [], [], []
    for place, entry in zip(there[which].tolist(), entries.tolist(), strict=True):
        url, size = place // width, int(hosts.numbers[entry])
        suffix = ".".join(host[url].rsplit(".", kinds[place % width])[-kinds[place % width] :])
        if len(path[url]) >= size and hosts.string(entry) == suffix.encode():
            urls.append(url)
            keys.append((suffix + path[url][:size]).encode())
            sizes.append((len(suffix) + size, len(suffix)))
    which, entries = rules.find(np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], dtype=np.uint64).view(np.int64))
    best: dict[int, tuple] = {}
    for place, entry in zip(which.tolist(), entries.tolist(), strict=True):
        if rules.string(entry) == keys[place]:
            found = (*sizes[place], keys[place], int(rules.numbers[entry]))
            best[urls[place]] = max(best.get(urls[place], found), found)
    names, verdicts = [None] * len(host), [None] * len(host)
    for url, (*_, key, number) in best.items():
        names[url], verdicts[url] = key.decode(), BLOCK if number else ALLOW
    return names, verdicts


def _suffix(host: Column, kind: int) -> Column:
    """The last `kind` labels of a host, null if it has fewer."""
    return F.when(F.size(F.split(host, r"\.")) >= kind, F.substring_index(host, ".", -kind))


def _probe(urls: DataFrame, rules: DataFrame, kinds: list[int], default: str) -> DataFrame:
    hosts = ship(rules.select(F.col("host").alias("string"), F.length("path").alias("number")).distinct(), "hosts")
    keyed = ship(rules.select(F.concat("host", "path").alias("string"), (F.col("verdict") == BLOCK).cast("long").alias("number")), "rules")
    id_type = urls.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, verdicts = best_rules(_mapped(hosts), _mapped(keyed), batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column("digests"), kinds)
            columns = [batch.column(c) for c in ("page_id", "host", "path")]
            made = [pa.array(names, pa.string()), pa.array([v or default for v in verdicts], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=["page_id", "host", "path", "rule", "verdict"])

    digest = lambda k: F.when(_suffix(F.col("host"), k).isNotNull(), F.xxhash64(_suffix(F.col("host"), k)))
    rows = urls.select("page_id", "host", "path", F.array(*map(digest, kinds)).alias("digests"))
    return rows.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string")


def _join(urls: DataFrame, rules: DataFrame, kinds: list[int], default: str) -> DataFrame:
    """The same by joins on the digests, for lists of any size. URLs of one host and path are looked up once."""
    pairs = materialize(urls.select("host", "path").distinct(), "urls-pairs")
    hosts = rules.select("host", F.length("path").alias("size")).distinct().select(F.xxhash64("host").alias("d"), F.col("host").alias("held"), "size")
    keyed = rules.select(F.concat("host", "path").alias("rule"), "verdict").select(F.xxhash64("rule").alias("d"), "rule", "verdict")
    suffixes = pairs.select("host", "path", F.explode(F.array_compact(F.array(*(_suffix(F.col("host"), k) for k in kinds)))).alias("suffix"))
    near = suffixes.withColumn("d", F.xxhash64("suffix")).join(hosts, "d").where((F.col("suffix") == F.col("held")) & (F.length("path") >= F.col("size")))
    asked = near.select("host", "path", F.length("suffix").alias("n"), F.concat("suffix", F.expr("substring(path, 1, size)")).alias("key")).withColumn("d", F.xxhash64("key"))
    found = asked.join(keyed, "d").where(F.col("key") == F.col("rule"))
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "n", "rule", "verdict")).alias("best"))
    judged = pairs.join(best, ["host", "path"], "left").select("host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return urls.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, mapped: int = MAPPED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages; rules has host, path and verdict (see normalised()).

    A rule fits its host and the hosts below it where the URL's path starts with the rule's; the longest (of as long ones
    that with the longer host) decides, and `default` where none fits. Null URLs and ids, repeated rows, empty tables and
    URLs of any length are fine; other columns are dropped. Rules of more than `mapped` bytes are joined, not mapped.
    """
    spark: SparkSession = pages.sparkSession
    host, path = parts(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    held = materialize(normalised(rules), "url-rules")
    size = held.agg(F.coalesce(F.sum(F.octet_length("host") * 2 + F.octet_length("path") + 64), F.lit(0))).first()[0]
    kinds = sorted(r[0] for r in held.select(F.size(F.split("host", r"\."))).distinct().collect())
    if not kinds:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if size > mapped:
        return _join(urls, held, kinds, default)
    out = _probe(urls, held, kinds, default)
    drop_table(held)
    return out
