"""WARC archives: deterministic sharded writer and reader.

Records are range-sorted by page id into shards whose bounds come from a histogram of ids (so they depend on the rows
alone, not on how files or partitions lie), written as one gzip member each, and files roll by compressed size. HTTP
and WARC headers and all digests are made anew. A task writes under temporary names and reports them in a manifest
table; only files that the committed manifest names are renamed to their final names, so lost or repeated tasks leave
no duplicate records. Records with equal payloads are written once, as the response with the largest page id; the
others become revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, count, groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import materialize, workdir
from threadloom.llm.ranges import range_of, splitters

VERSION = b"WARC/1.1"
NAMESPACE = uuid.UUID("6f0d7f0e-6a53-4c3f-9f0e-7d3c5a1b2c4d")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Ids go through pandas as text: a column of numbers with nulls would come as floats there.
BUILT = "page_id string, url string, sha string, payload_bytes long, member binary"
MANIFEST = "shard int, file_no int, tmp_name string, name string, records long, bytes long, sha256 string"
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "block_digest string, intact boolean, payload binary, file string"
)


def filesystem(uri: str):
    """A pyarrow file system and path for a shared folder: local, HDFS, S3 or another that pyarrow knows by its URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, sha: str, turn: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{sha}/{turn}')}>"


def record(page_id: int | None, url: str | None, turn: int, sha: str, size: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """One WARC record as a gzip member. payload None: a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, sha, turn)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("X-Payload-Length", str(size)),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c > " " else "%" + format(ord(c), "02X") for c in url)))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if payload is None:
        head.append(("WARC-Profile", PROFILE))
        head.append(("WARC-Refers-To", record_id(refers_to, sha, 0)))
        if refers_to is not None:
            head.append(("X-Refers-To-Page-Id", str(refers_to)))
    head.append(("Content-Length", str(len(block))))
    lines = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return gzip.compress(lines + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _responses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Build each row's response record where it is read, so that only compressed bytes are shuffled."""
    for frame in frames:
        ids = [_int(x) for x in frame.page_id]
        frame["member"] = [record(i, u, 0, h, len(p), p) for i, u, h, p in zip(ids, frame.url, frame.sha, frame.payload, strict=True)]
        yield frame.drop(columns="payload")


def _decide(rows) -> Iterator[tuple[int, bytes]]:
    """(shard, record) of sorted rows; a decision (kind 0) comes before the rows with its id, url and hash."""
    rule, key, seen = None, None, 0
    for row in rows:
        now = (_int(row.page_id), row.url, row.sha)
        if row.kind == 0:
            rule, key, seen = row, now, 0
            continue
        if now != key:
            rule, key, seen = None, now, 0
        page_id, url, sha = now
        member = row.member
        if rule is not None and not (rule.may_respond and seen == 0):
            member = record(page_id, url, seen, sha, int(row.payload_bytes), None, _int(rule.response_id))
        elif seen:  # an equal row that is a response of its own needs a record id of its own
            member = record(page_id, url, seen, sha, int(row.payload_bytes), parse(gzip.decompress(member))["payload"])
        seen += 1
        yield int(row.shard), member


def _writer(out: str, roll_bytes: int):
    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(out)
        rows = (row for frame in frames for row in frame.itertuples(index=False))
        for shard, group in groupby(_decide(rows), key=lambda r: r[0]):
            yield pd.DataFrame(list(_files(store, root, shard, (member for _, member in group), roll_bytes)))

    return write


def _files(store, root: str, shard: int, members_: Iterator[bytes], roll_bytes: int) -> Iterator[dict]:
    """Write a shard's records to files of about roll_bytes under temporary names; a manifest row for each file."""
    store.create_dir(f"{root}/tmp", recursive=True)
    for file_no in count():
        first = next(members_, None)
        if first is None:
            return
        name = f"shard-{shard:05d}-{file_no:05d}.warc.gz"
        tmp, sha, records, size = f"tmp/{name}.{uuid.uuid4().hex}", hashlib.sha256(), 0, 0
        with store.open_output_stream(f"{root}/{tmp}") as sink:
            for member in chain([first], members_):
                sink.write(member)
                sha.update(member)
                records, size = records + 1, size + len(member)
                if size >= roll_bytes:
                    break
        yield {"shard": shard, "file_no": file_no, "tmp_name": tmp, "name": name, "records": records, "bytes": size, "sha256": sha.hexdigest()}


def _commit(out: str):
    def rename(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = filesystem(out)
        for frame in frames:
            for tmp, name in zip(frame.tmp_name, frame.name, strict=True):
                there, final = store.get_file_info([f"{root}/{tmp}", f"{root}/{name}"])
                if there.type.name != "NotFound":  # a repeated commit finds the file already moved
                    store.move(there.path, final.path)
                elif final.type.name == "NotFound":
                    raise FileNotFoundError(f"{root}/{tmp} is in the manifest but gone")
            yield frame

    return rename


def write_warc(
    pages: DataFrame,
    out: str | None = None,
    shards: int | None = None,
    roll_bytes: int = 64 << 20,
    least_revisit_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Write one record per row under `out` (a folder of its own in the shared folder by default); returns the manifest.

    Of rows with equal payloads of at least least_revisit_bytes, that with the largest id is the response. Null html
    is an empty payload, a null url leaves out the target header, a null id sorts first and is never preferred as
    response. Rows that repeat an id are written each; among equal rows one is the response and the rest revisit it.
    An empty table gives an empty manifest. Other columns are dropped.
    """
    spark = pages.sparkSession
    out = out or workdir(spark, "warc")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"),
    )
    size = F.octet_length("payload").cast("long")
    sizes = materialize(rows.select("page_id", "url", size.alias("payload_bytes"), F.sha1("payload").alias("sha")), "warc-sizes")
    if shards is None:
        total = sizes.agg(F.sum("payload_bytes")).first()[0] or 0
        shards = max(1, min(12, total // (1 << 20)), min(1 << 14, total // (32 << 20)))
    bounds = splitters(sizes, "page_id", F.col("payload_bytes") + 400, shards)

    # Who is the response: the first of its payload by (id descending, url). Only hashes and ids are shuffled.
    rank = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("a"), F.coalesce("url", F.lit("")).alias("u"))
    large = sizes.where(F.col("payload_bytes") >= least_revisit_bytes)
    firsts = large.groupBy("sha", "payload_bytes").agg(F.max(rank).alias("best"), F.max("page_id").alias("response_id"), F.count("*").alias("n"))
    shared = firsts.where("n > 1").select(F.col("sha").alias("s"), F.col("payload_bytes").alias("b"), "best", "response_id")
    revisits = (
        sizes.join(shared, (F.col("sha") == F.col("s")) & (F.col("payload_bytes") == F.col("b")))
        .select("page_id", "url", "sha", "response_id", (rank == F.col("best")).alias("may_respond"))
        .distinct()
    )
    shard = range_of(F.col("page_id"), bounds).cast("int")
    rules = revisits.select(
        shard.alias("shard"), "page_id", "url", "sha", F.lit(0).alias("kind"), "response_id", "may_respond",
        F.lit(None).cast("long").alias("payload_bytes"), F.lit(None).cast("binary").alias("member"),
    )
    built = rows.select(F.col("page_id").cast("string"), "url", F.sha1("payload").alias("sha"), size.alias("payload_bytes"), "payload").mapInPandas(_responses, BUILT)
    built = built.withColumn("page_id", F.col("page_id").cast("long"))
    records = built.select(
        shard.alias("shard"), "page_id", "url", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("response_id"),
        F.lit(None).cast("boolean").alias("may_respond"), "payload_bytes", "member",
    )
    n = len(bounds) + 1
    dealt = records.union(rules).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "sha", "kind")
    dealt = dealt.withColumn("page_id", F.col("page_id").cast("string")).withColumn("response_id", F.col("response_id").cast("string"))
    manifest = materialize(dealt.mapInPandas(_writer(out, roll_bytes), MANIFEST), "warc-manifest")
    committed = manifest.repartition(min(64, n), "name").mapInPandas(_commit(out), MANIFEST)
    done = materialize(committed.withColumn("root", F.lit(out)), "warc-committed")
    _remove(spark, f"{out}/tmp")
    return done


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Inflated gzip members of a stream, one at a time."""
    inflater, parts = zlib.decompressobj(31), []
    data = stream.read(chunk)
    while data:
        parts.append(inflater.decompress(data))
        if inflater.eof:
            yield b"".join(parts)
            data = inflater.unused_data or stream.read(chunk)
            inflater, parts = zlib.decompressobj(31), []
        else:
            data = stream.read(chunk)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(member: bytes) -> dict:
    """Headers, block digest check and payload of one record."""
    raw, _, rest = member.partition(b"\r\n\r\n")
    lines = raw.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a record: {lines[0][:40]}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(head["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2] if head["WARC-Type"] == "response" else None
    block_digest = base32_sha1(block)
    stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
    digest = base32_sha1(payload) if payload is not None else stated
    number = lambda k: int(head[k]) if k in head else None
    return {
        "page_id": number("X-Page-Id"),
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "payload_bytes": len(payload) if payload is not None else number("X-Payload-Length"),
        "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page-Id"),
        "block_digest": block_digest,
        "intact": head["WARC-Block-Digest"] == f"sha1:{block_digest}" and digest == stated,
        "payload": payload,
    }


def read_warc(manifest: DataFrame, batch: int = 256) -> DataFrame:
    """Records of the manifest's files, streamed member by member; digests are computed from the bytes read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, name in zip(frame.root, frame.name, strict=True):
                store, path = filesystem(root)
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows = []
                    for member in members(stream):
                        rows.append(parse(member) | {"file": name})
                        if len(rows) == batch:
                            yield _frame(rows)
                            rows = []
                    if rows:
                        yield _frame(rows)

    spread = manifest.select("root", "name").repartition(max(1, min(1 << 14, manifest.count())), "name")
    return spread.mapInPandas(read, RECORD)


def _frame(rows: list[dict]) -> pd.DataFrame:
    whole = ("page_id", "refers_to", "payload_bytes")
    return pd.DataFrame({k: pd.array([r[k] for r in rows], dtype="Int64") if k in whole else [r[k] for r in rows] for k in rows[0]})
