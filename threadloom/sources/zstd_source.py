"""A Spark data source for zstd-compressed lines with windows beyond what the built-in codec takes (up to 2 GiB).

Files are cut into splits of bytes. A split's task looks for the first frame that starts in it and reads all frames that
do, so a file of many frames is read by many tasks; a file of one frame is read by one. No index is needed: a frame
start is its magic number with a header and a chain of blocks behind it. Lines may cross frames: a split leaves what
comes before its first line break to the split before, which reads on until it has met that break.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WINDOW = 1 << 31
BATCH = 4096
SPLIT = 128 << 20
READ = 1 << 17
SCAN = 1 << 20
CHAIN = 64  # blocks that are followed to tell a frame start from bytes that look like one

#: Fixed values of the zstd format: magic numbers, the largest block, and sizes of header fields by flag.
MAGIC = bytes([0x28, 0xB5, 0x2F, 0xFD])
SKIPPABLE = bytes([0x2A, 0x4D, 0x18])  # behind a byte of 0x50 to 0x5F
BLOCK_BYTES = 1 << 17
DICT_ID_BYTES = (0, 1, 2, 4)
CONTENT_SIZE_BYTES = (0, 2, 4, 8)


class _Split(InputPartition):
    def __init__(self, path: str, low: int, high: int | None):
        super().__init__((path, low, high))
        self.path, self.low, self.high = path, low, high


class ZstdLines(DataSource):
    """Options: `paths`, newline-separated, and `split`, the bytes of a split (SPLIT by default)."""

    @classmethod
    def name(cls) -> str:
        return "zstdlines"

    def schema(self) -> str:
        return "line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["paths"].split("\n"), int(self.options.get("split", SPLIT)))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            store, at = _opened(path)
            size = store.get_file_info(at).size or 1
            starts = [*range(0, size, self.split)]
            out += [_Split(path, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        batch: list[str] = []
        for line in stream_lines(partition.path, partition.low, partition.high):
            batch.append(line)
            if len(batch) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(batch)], names=["line"])
                batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(batch)], names=["line"])


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1) if ":" in path else f"file://{path}")


#: Fixed start of the line that stands for what a broken frame would have held.
BROKEN = "broken zstd stream in"


def stream_lines(path: str, low: int = 0, high: int | None = None) -> Iterator[str]:
    """Non-blank lines of a .zst file, bad bytes replaced; of the frames that start at bytes from low to high alone, if given.

    What a broken frame gives up to its break is kept, then a line, which is no JSON, tells of the break, and reading
    goes on at the next frame. The lines of all splits together do not depend on where splits end.
    """
    store, at = _opened(path)
    with store.open_input_file(at) as source:
        held: list[bytes] = []
        skipping = low > 0
        for own, piece in _pieces(source, low, high):
            if not own and skipping:
                return
            if isinstance(piece, str):
                if not skipping:
                    yield from _lines([b"".join(held)])
                held = []
                if own:
                    yield f"{BROKEN} {path}: {piece}"
                continue
            first, *rest = piece.split(b"\n")
            held.append(first)
            if not rest:
                if skipping:
                    held = []
                continue
            if not skipping:
                yield from _lines([b"".join(held)])
            if not own:
                return
            skipping, held = False, [rest.pop()]
            yield from _lines(rest)
        if not skipping:
            yield from _lines([b"".join(held)])


def _lines(raw: list[bytes]) -> Iterator[str]:
    for line in raw:
        if text := line.decode("utf-8", "replace").strip():
            yield text


def _pieces(source, low: int, high: int | None) -> Iterator[tuple[bool, bytes | str]]:
    """Decompressed bytes of the frames from the first that starts at low or later on, with whether their frame starts
    before high; a string says why a frame broke off. Bytes behind the last frame that no split would take for a frame
    count as before high, too."""
    import zstandard

    make = zstandard.ZstdDecompressor(max_window_size=WINDOW).decompressobj
    size, foreign = source.size(), False
    at = 0 if not low else _next_frame(source, low, size if high is None else high)
    while at is not None and at < size:
        head = _bytes(source, at, 8)
        if head[1:4] == SKIPPABLE and head[0] >> 4 == 5:
            at += 8 + int.from_bytes(head[4:8], "little")
            continue
        own = high is None or at < high or not (foreign or (head[:4] == MAGIC and _is_frame(source, at)))
        frame, here, why, foreign = make(), at, None, foreign or not own
        while not frame.eof:
            raw = _bytes(source, here, READ)
            if not raw:
                why = "the last frame is cut off"
                break
            try:
                out = frame.decompress(raw)
            except zstandard.ZstdError as error:
                why = str(error)
                break
            here += len(raw) - len(frame.unused_data if frame.eof else b"")
            if out:
                yield own, out
        if why:
            yield own, why
            here = _next_frame(source, at + 1, size)
        at = here


def _bytes(source, at: int, n: int) -> bytes:
    source.seek(at)
    return source.read(n)


def _next_frame(source, low: int, high: int) -> int | None:
    """The first frame start from low up to high, if there is one."""
    at = low
    while at < high:
        part = _bytes(source, at, SCAN + len(MAGIC) - 1)
        found = part.find(MAGIC)
        while found >= 0:
            if at + found >= high:
                return None
            if _is_frame(source, at + found):
                return at + found
            found = part.find(MAGIC, found + 1)
        at += SCAN
    return None


def _is_frame(source, at: int) -> bool:
    """Whether the magic number at `at` has a header and blocks behind it, CHAIN of them or up to another frame or the end."""
    size, flags = source.size(), _bytes(source, at + 4, 1)
    if not flags:
        return True
    single, content = flags[0] >> 5 & 1, CONTENT_SIZE_BYTES[flags[0] >> 6]
    if flags[0] & 8:
        return False
    at += 5 + (1 - single) + DICT_ID_BYTES[flags[0] & 3] + (content or single)
    for _ in range(CHAIN):
        head = int.from_bytes(_bytes(source, at, 3), "little")
        if at + 3 > size:
            return True
        last, kind, length = head & 1, head >> 1 & 3, head >> 3
        if kind == 3 or length > BLOCK_BYTES:
            return False
        at += 3 + (1 if kind == 1 else length)
        if last:
            after = _bytes(source, at + (4 if flags[0] & 4 else 0), 4)
            return len(after) < 4 or after == MAGIC or (after[1:4] == SKIPPABLE and after[0] >> 4 == 5)
    return True


def read_zst_lines(spark: SparkSession, paths: list[str], split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(ZstdLines)
    return spark.read.format("zstdlines").option("paths", "\n".join(paths)).option("split", split).load()
