"""Exact removal of repeated substrings by a partitioned, sparse suffix array.

Every string of LENGTH bytes contains, at a place that its content alone decides, the least-hashed GRAM bytes in it (a
minimizer); so two equal strings have their minimizer at the same place. Suffixes are therefore taken at minimizers
only, about one in 35 bytes. A suffix is read as tokens: the hash of its first GRAM bytes, then the hash of its
surroundings, which hold all LENGTH-byte strings around that minimizer.

Sampled splitters range-partition suffixes by these leading tokens, into as many buckets as the texts' size asks for.
Each map task ships one sorted, packed run for each bucket, after settling repeats it sees itself, so a string in a
third of all documents arrives once a task. A bucket keeps its runs packed and sorts PASS suffixes of them at a time by
a multikey quicksort over the tokens. Suffixes with equal tokens throughout repeat the first of them. Suffixes with an
equal first token but different surroundings come again with their bytes: they are compared string by string, within a
first token or, for crowded tokens and those that a splitter cuts, spread by the strings themselves, again through
sorted buckets. Documents equal as a whole are settled by their hash before all this.

Hashes are 64-bit polynomial sums over a random byte table; equality is decided on 96 bits or more.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import drop_folder, materialize, number_rows, partitions, workdir

LENGTH = 100
GRAM = 32
SIDE = LENGTH - GRAM
CONTEXT = LENGTH + SIDE
CHUNK = 1 << 19
RUN = 1 << 21
CROWDED = 2048
SAMPLE = 1 << 12  # texts that splitters are taken from, about; more where there are more buckets
BUCKET_BYTES = 1 << 29  # of texts whose suffixes are one bucket's, about: 16 million suffixes
PASS = 1 << 22  # suffixes that a bucket holds unpacked, about
SMALL = 1 << 12  # rows that quicksort leaves to numpy

_MIX, _BASE = np.uint64(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D
_PLACE = (1 << 20) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MIX)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a chunk reaches."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 2 * CONTEXT)
            steps = np.repeat(np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], dtype=np.uint64), size + 1, axis=1)
            steps[:, 0] = 1
            cls.up, cls.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return cls.up, cls.down


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums along the last axis; the hash of [i, j) is (sums[j] - sums[i]) * down[i]."""
    up, _ = _Powers.reach(data.shape[-1] + 1)
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(_TABLE[data] * up[: data.shape[-1]], axis=-1, dtype=np.uint64, out=out[..., 1:])
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    m = -(-n // width)
    padded = np.full(m * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    blocks = padded.reshape(m, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """(offset, first token, surroundings' token, bytes before, bytes after the gram) of a text's minimizers."""
    n, parts = len(text), []
    data = np.frombuffer(text, dtype=np.uint8)
    for first in range(0, n - LENGTH + 1, CHUNK):
        low, high = max(0, first - SIDE), min(n, first + CHUNK + CONTEXT)
        sums = _sums(data[low:high])
        _, down = _Powers.reach(high - low + 1)
        a, b = first - low, min(first + CHUNK + SIDE, n - GRAM + 1) - low  # grams of the windows that start in this chunk
        tokens = _mix((sums[a + GRAM : b + GRAM] - sums[a:b]) * down[a:b])
        place = np.arange(len(tokens), dtype=np.uint64)
        keyed = (tokens & ~np.uint64(_PLACE)) | (np.uint64(_PLACE) - place)
        least = _sliding_min(keyed, SIDE + 1)
        at = _PLACE - (least & np.uint64(_PLACE)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        off = at + first
        before, after = np.minimum(off, SIDE), np.minimum(n - off - GRAM, SIDE)
        i, j = off - before - low, off + GRAM + after - low
        around = _mix((sums[j] - sums[i]) * down[i] + (before * 251 + after).astype(np.uint64) * _MIX)
        parts.append((off, tokens[at], around, before, after))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    off, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    keep = np.concatenate([[True], off[1:] != off[:-1]])
    return off[keep], *(x[keep] for x in rest)


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order of rows by keys, the first key first, found by multikey quicksort.

    A segment is parted in three by a pivot of one key; only the middle part, equal in it, goes on to the next key. Parts
    of SMALL rows or fewer are finished by numpy, over the keys that are left. Equal rows come in any order.
    """
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        low, high, depth = todo.pop()
        part = order[low:high]
        if len(part) <= SMALL:
            order[low:high] = part[np.lexsort([k[part] for k in reversed(keys[depth:])])]
            continue
        key = keys[depth][part]
        pivot = np.sort(key[:: len(key) // 31])[16]
        less, more = key < pivot, key > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(low, a, depth), (b, high, depth)]
        if depth + 1 < len(keys):
            todo.append((a, b, depth + 1))
    return order


_HIGH = np.uint64(0xFFFFFFFFFFFF0000)


class Run:
    """Columns of suffixes: two tokens (48 bits each), the document, the offset, and bytes before and after its gram."""

    def __init__(self, token, around, order, off, before, after):
        self.columns = [token & _HIGH, around & _HIGH, order, off, before, after]

    @classmethod
    def join(cls, runs: list[Run]) -> Run:
        return cls(*(np.concatenate(x) for x in zip(*(r.columns for r in runs), strict=True)))

    def take(self, rows: np.ndarray) -> Run:
        return Run(*(c[rows] for c in self.columns))

    def sorted(self) -> Run:
        """By tokens, document and offset; a row that comes twice (a string around two crowded suffixes) stays once."""
        token, around, order, off, *_ = self.columns
        by = multikey_order(token, around, order, off)
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = np.any([c[by][1:] != c[by][:-1] for c in (token, around, order, off)], axis=0)
        return self.take(by[fresh])

    def pack(self) -> bytes:
        token, around, order, off, before, after = self.columns
        six = [c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for c in (token, around)]
        rest = [order.astype("<i8").tobytes(), off.astype("<i8").tobytes(), before.astype("u1").tobytes(), after.astype("u1").tobytes()]
        planes = [np.frombuffer(x, dtype=np.uint8).reshape(-1, 8).T.tobytes() if n < 2 else x for n, x in enumerate(rest)]
        return zstandard.compress(b"".join([*six, *planes]), 1)

    @staticmethod
    def rows_of(blob: bytes) -> int:
        return zstandard.frame_content_size(blob) // 30

    @classmethod
    def unpack(cls, blob: bytes) -> Run:
        raw = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8)
        n = len(raw) // 30
        cut = np.cumsum([0, 6 * n, 6 * n, 8 * n, 8 * n, n, n])
        part = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        wide = np.zeros((2, n, 8), dtype=np.uint8)
        wide[0, :, 2:], wide[1, :, 2:] = part[0].reshape(n, 6), part[1].reshape(n, 6)
        token, around = wide[0].reshape(-1).view("<u8"), wide[1].reshape(-1).view("<u8")
        order, off = (np.ascontiguousarray(p.reshape(8, n).T).reshape(-1).view("<i8") for p in part[2:4])
        return cls(token, around, order, off, part[4].astype(np.int64), part[5].astype(np.int64))

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a sorted run: whether a row has the first token, and both tokens, of the row before it."""
        token, around = self.columns[:2]
        same = np.concatenate([[False], token[1:] == token[:-1]]) if len(token) else np.zeros(0, dtype=bool)
        return same, same & np.concatenate([[False], around[1:] == around[:-1]])[: len(same)]

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document and byte range of the surroundings."""
        _, _, order, off, before, after = self.columns
        return order, off - before, off + GRAM + after


_SHIPPED = "bucket int, blob binary, ord array<long>, low array<long>, high array<long>"
_SETTLED = "kind int, ord long, low long, high long, token long"


def _shipped(run: Run, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settle what repeats within the run; ship the rest by bucket, packed. Settled ranges travel along."""
    run = run.sorted()
    _, again = run.repeats()
    order, low, high = run.take(again).ranges()
    rest = run.take(~again)
    bounds = np.searchsorted(_composite(rest.columns[0], rest.columns[1]), splitters, side="left")
    edges = [0, *bounds.tolist(), len(rest.columns[0])]
    out = [(n, rest.take(slice(a, b)).pack(), [], [], []) for n, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
    if len(order):
        out.append((int(order[0]) % (len(splitters) + 1), None, order.tolist(), low.tolist(), high.tolist()))
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 3), strict=True)],
            names=["bucket", "blob", "ord", "low", "high"],
        )


def _composite(token: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Both tokens as one sortable value each: fixed-width big-endian byte strings."""
    both = np.empty((len(token), 2), dtype=">u8")
    both[:, 0], both[:, 1] = token, around
    return np.ascontiguousarray(both).view("S16").reshape(-1) if len(token) else np.zeros(0, dtype="S16")


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    held, size = [], 0
    for batch in batches:
        for order, z in zip(batch.column("ord").to_pylist(), batch.column("z"), strict=True):
            off, token, around, before, after = anchors(zstandard.decompress(z.as_py()))
            if len(off):
                held.append(Run(token, around, np.full(len(off), order, dtype=np.int64), off, before, after))
                size += len(off)
            if size >= RUN:
                yield Run.join(held)
                held, size = [], 0
    if held:
        yield Run.join(held)


def _first_tokens(bounds: np.ndarray) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(s.ljust(16, b"\0")[:8] for s in bounds.tolist()), dtype=">u8").astype(np.uint64))


def _passes(blobs: list[bytes], size: int) -> Iterator[tuple[Run, np.ndarray]]:
    """A bucket's packed, sorted runs joined and sorted, in ranges of about `size` suffixes, and the first tokens that the
    ranges' bounds cut. Every range unpacks the runs again, one by one, and takes its slice."""
    rows = sum(map(Run.rows_of, blobs))
    count, bounds = -(-rows // size), np.zeros(0, dtype="S16")
    if count > 1:
        step = max(1, size // 1024)
        some = np.sort(np.concatenate([_composite(*Run.unpack(b).columns[:2])[::step] for b in blobs]))
        bounds = np.unique(some[[len(some) * i // count for i in range(1, count)]])
    cut = _first_tokens(bounds)
    for n in range(len(bounds) + 1):
        held = []
        for blob in blobs:
            run = Run.unpack(blob)
            if len(bounds):
                edges = [0, *np.searchsorted(_composite(*run.columns[:2]), bounds, side="left").tolist(), len(run.columns[0])]
                run = run.take(slice(edges[n], edges[n + 1]))
            held.append(run)
        yield Run.join(held).sorted(), cut


def _merge(splitters: np.ndarray):
    """Merge a bucket's runs; kind 0: a settled range; 1: a suffix to compare; 2: one to compare that is crowded."""
    between, size = _first_tokens(splitters), PASS

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed: dict[int, list[bytes]] = {}
        for batch in batches:
            ord_, low, high = (batch.column(c).flatten().to_numpy() for c in ("ord", "low", "high"))
            if len(ord_):
                yield _rows(0, ord_, low, high, np.zeros(len(ord_), dtype=np.int64))
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob"), strict=True):
                if blob.is_valid:
                    packed.setdefault(bucket, []).append(blob.as_py())
        for bucket in sorted(packed):
            for run, within in _passes(packed.pop(bucket), size):
                same, again = run.repeats()
                order, low, high = run.take(again).ranges()
                yield _rows(0, order, low, high, np.zeros(len(order), dtype=np.int64))
                lead = ~again
                group = np.cumsum(~same) - 1
                leads = np.bincount(group, weights=lead).astype(np.int64)[group]
                token = run.columns[0]
                crossing = np.isin(token, between) | np.isin(token, within)
                for kind, rows in ((1, lead & (leads > 1) & (leads <= CROWDED) & ~crossing), (2, lead & ((leads > CROWDED) | crossing))):
                    _, _, order, off, _, _ = run.take(rows).columns
                    yield _rows(kind, order, off, off, token[rows].view(np.int64))

    return merge


def _rows(kind: int, order, low, high, token) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(order), kind, dtype=np.int32)), *(pa.array(np.asarray(c, dtype=np.int64)) for c in (order, low, high, token))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "ord", "low", "high", "token"])


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        z = [squeeze.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(z, type=pa.binary())], names=["ord", "z"])


_COMPARED = "token long, ord long, off long, before int, after int, ctx binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each suffix to compare, padded to CONTEXT bytes."""
    for batch in batches:
        for n in range(batch.num_rows):
            text = zstandard.decompress(batch.column("z")[n].as_py())
            off, token = (np.array(batch.column(c)[n].as_py(), dtype=np.int64) for c in ("off", "token"))
            padded = np.frombuffer(bytes(SIDE) + text + bytes(SIDE), dtype=np.uint8)
            ctx = padded[off[:, None] + np.arange(CONTEXT)]
            before, after = np.minimum(off, SIDE), np.minimum(len(text) - off - GRAM, SIDE)
            order = np.full(len(off), batch.column("ord")[n].as_py(), dtype=np.int64)
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CONTEXT), len(off), [None, pa.py_buffer(np.ascontiguousarray(ctx))]).cast(pa.binary())
            columns = [pa.array(token), pa.array(order), pa.array(off), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), fixed]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "ord", "off", "before", "after", "ctx"])


def _second(ctx: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """A second, independent hash of the strings at (row, col): each byte's place in the table is another."""
    turned = _sums(255 - ctx)
    _, down = _Powers.reach(CONTEXT + 1)
    return _mix((turned[row, col + LENGTH] - turned[row, col]) * down[col])


def _repeated_windows(token, order, off, before, after, ctx) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of all strings around suffixes that an earlier suffix with the same first token has too."""
    m, starts = len(token), np.arange(SIDE + 1)
    sums = _sums(ctx)
    _, down = _Powers.reach(CONTEXT + 1)
    strings = _mix((sums[:, LENGTH : LENGTH + SIDE + 1] - sums[:, : SIDE + 1]) * down[: SIDE + 1])
    valid = (starts >= SIDE - before[:, None]) & (starts <= after[:, None])
    salt = _mix(token.view(np.uint64) * _MIX + np.uint64(1))[:, None] + starts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    keys = _mix(strings + _mix(salt))
    rank = np.empty(m, dtype=np.int64)
    rank[multikey_order(order, off)] = np.arange(m)
    row, col = np.nonzero(valid)
    key = keys[row, col]
    by = np.argsort(key)
    equal = np.concatenate([[False], key[by[1:]] == key[by[:-1]], [False]])
    shared = np.sort(by[equal[1:] | equal[:-1]]) if len(by) else by
    row, col, key = row[shared], col[shared], key[shared]
    second = _second(ctx, row, col)  # only strings whose first hash is shared need it
    by = multikey_order(key, second, rank[row])
    later = np.zeros(len(key), dtype=bool)
    later[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (second[by[1:]] == second[by[:-1]])
    hit = np.zeros((m, SIDE + 3), dtype=np.int8)
    hit[row[later], col[later] + 1] = 1
    change = np.diff(hit, axis=1)
    r, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    return order[r], off[r] - SIDE + a, off[r] - SIDE + b - 1 + LENGTH


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by token: compare suffixes with an equal first token. A group is held whole (CROWDED at most)."""

    def settle(rows):
        for part in _blocks(rows):
            order, low, high = _repeated_windows(*part)
            yield _rows(0, order, low, high, np.zeros(len(order), dtype=np.int64))

    held = None
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in ("token", "ord", "off", "before", "after")]
        ctx = np.frombuffer(b"".join(batch.column("ctx").to_pylist()), dtype=np.uint8).reshape(-1, CONTEXT)
        rows = [*columns, ctx]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        first = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        yield from settle([c[:first] for c in rows])
        held = [c[first:] for c in rows]
    if held is not None:
        yield from settle(held)


def _blocks(rows, size: int = 4096):
    """Sorted rows in blocks of at least `size` rows that keep tokens together."""
    token, a = rows[0], 0
    while a < len(token):
        b = min(len(token), a + size)
        b = int(np.searchsorted(token, token[b - 1], side="right"))
        yield [c[a:b] for c in rows]
        a = b


def _window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """All strings around crowded suffixes as rows of their own, keyed by two hashes of the string."""
    for batch in _contexts(batches):
        token, order, off, before, after = (batch.column(c).to_numpy() for c in ("token", "ord", "off", "before", "after"))
        ctx = np.frombuffer(b"".join(batch.column("ctx").to_pylist()), dtype=np.uint8).reshape(-1, CONTEXT)
        sums, starts = _sums(ctx), np.arange(SIDE + 1)
        _, down = _Powers.reach(CONTEXT + 1)
        strings = (sums[:, LENGTH : LENGTH + SIDE + 1] - sums[:, : SIDE + 1]) * down[: SIDE + 1]
        row, col = np.nonzero((starts >= SIDE - before[:, None]) & (starts <= after[:, None]))
        second = _second(ctx, row, col)
        zero = np.zeros(len(row), dtype=np.int64)
        yield Run(_mix(strings[row, col]), second, order[row], off[row] - SIDE + col, zero, zero + SIDE)


def _batched(runs: Iterator[Run]) -> Iterator[Run]:
    held, size = [], 0
    for run in runs:
        held.append(run)
        size += len(run.columns[0])
        if size >= RUN:
            yield Run.join(held)
            held, size = [], 0
    if held:
        yield Run.join(held)


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join a document's ranges, take them out and report."""
    for batch in batches:
        rows = []
        for n in range(batch.num_rows):
            text = zstandard.decompress(batch.column("z")[n].as_py())
            low, high = (np.array(batch.column(c)[n].as_py(), dtype=np.int64) for c in ("low", "high"))
            by = np.argsort(low, kind="stable")
            low, high = low[by], np.maximum.accumulate(high[by])
            new = np.concatenate([[True], low[1:] > high[:-1]])
            first, last = low[new], high[np.concatenate([new[1:], [True]])]
            keep, at = hashlib.sha256(), 0
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                keep.update(text[at:a])
                at = b
            keep.update(text[at:])
            rows.append((batch.column("ord")[n].as_py(), int((last - first).sum()), len(first), keep.hexdigest(), first.tolist(), last.tolist()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        names = ["ord", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _ship(source: DataFrame, runs, splitters: np.ndarray) -> DataFrame:
    """Runs of a table's suffixes, dealt to buckets by the splitters and merged there."""
    n = len(splitters) + 1

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            yield from _shipped(run, splitters)

    return source.mapInArrow(ship, _SHIPPED).repartitionById(n, F.col("bucket")).mapInArrow(_merge(splitters), _SETTLED)


def _splitters(source: DataFrame, runs, buckets: int, texts: int) -> np.ndarray:
    """Quantiles of the leading tokens of texts that a hash of their number chose from the whole table; 256 tokens or so
    of each run of theirs, 16 a bucket at most, come to the driver. They set bucket bounds alone, never results."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            keys = _composite(run.columns[0], run.columns[1])
            keys = keys[:: max(1, len(keys) // 256)]
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(16, b"\0") for k in keys.tolist()], type=pa.binary())], names=["key"])

    wanted = max(SAMPLE, 4 * buckets)
    some = source.where(F.pmod(F.xxhash64("ord"), F.lit(max(1, texts // wanted))) == 0)
    got = sorted(bytes(r[0]) for r in some.mapInArrow(sample, "key binary").limit(max(1 << 14, 16 * buckets)).collect())
    picks = [got[len(got) * i // buckets] for i in range(1, buckets)] if got else []
    return np.unique(np.array(picks, dtype="S16"))


class _Texts(NamedTuple):
    """The texts to compare, compressed and bucketed by ord, their number, and the buckets of suffixes that they need."""

    table: DataFrame
    count: int
    buckets: int


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (of removed byte ranges).

    Removed is each byte that a LENGTH-byte string covers which also starts earlier: in a document with a smaller id or
    in the same one. Null text is empty text. Where ids repeat or are null, rows count as ordered by (id, text hash),
    null ids first, equal rows in any order. An empty table gives no rows; other columns are dropped.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        rows = rows.withColumn("ord", F.col("doc_id"))
    else:
        rows, _ = number_rows(rows, [F.col("doc_id").asc_nulls_first(), F.sha2("text", 256)], "ord")
    facts = rows.select("ord", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    facts = materialize(facts, "suffix-facts")
    first = facts.groupBy("sha").agg(F.min("ord").alias("lead"), F.first("n_bytes").alias("n_bytes"))
    first = materialize(first.where(F.col("n_bytes") >= LENGTH).select("lead", "n_bytes"), "suffix-first")
    count, size = first.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()

    # Texts are compressed where they are read and dealt once, into a bucketed table that later steps join in place.
    n = partitions(spark)
    table, folder = f"threadloom_suffixes_{uuid.uuid4().hex}", workdir(spark, "suffix-texts")
    try:
        squeezed = rows.where(F.octet_length("text") >= LENGTH).select("ord", "text").mapInArrow(_pack_texts, "ord long, z binary")
        unique = squeezed.join(first.select("lead"), F.col("ord") == F.col("lead"), "left_semi").repartition(n, "ord")
        unique.write.bucketBy(n, "ord").format("parquet").option("path", folder).saveAsTable(table)
        cut = _cut(_Texts(spark.table(table), count, max(n, -(-size // BUCKET_BYTES))))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_folder(spark, folder)

    # Rows find by their own number whether they are the first of their text, so that a text in many rows is no hot key.
    known = facts.join(first.select("lead"), F.col("ord") == F.col("lead"), "left").join(cut.withColumnRenamed("ord", "o"), F.col("ord") == F.col("o"), "left")
    copy = F.col("lead").isNull() & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<long>")
    return known.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(copy, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
    )


def _cut(held: _Texts) -> DataFrame:
    """ord, n_removed, n_spans, kept_sha256, starts and ends of the texts that lose something."""
    texts, n = held.table, partitions(held.table.sparkSession)
    splitters = _splitters(texts, _text_runs, held.buckets, held.count)
    merged = materialize(_ship(texts, _text_runs, splitters), "suffix-merged")
    found = [merged.where("kind = 0").select("ord", "low", "high")]
    kinds = {r[0] for r in merged.select("kind").distinct().collect()}

    def with_texts(kind: int) -> DataFrame:
        edges = merged.where(F.col("kind") == kind).groupBy("ord").agg(F.collect_list("low").alias("off"), F.collect_list("token").alias("token"))
        return texts.join(edges, "ord").select("ord", "z", "off", "token")

    if 1 in kinds:
        compared = with_texts(1).mapInArrow(_contexts, _COMPARED).repartition(n, "token").sortWithinPartitions("token")
        found.append(compared.mapInArrow(_compare, _SETTLED).select("ord", "low", "high"))
    if 2 in kinds:
        strings = lambda batches: _batched(_window_runs(batches))
        spread = np.array([(int(2**64) * i // held.buckets).to_bytes(8, "big") + bytes(8) for i in range(1, held.buckets)], dtype="S16")
        found.append(_ship(with_texts(2), strings, spread).where("kind = 0").select("ord", "low", "high"))
    ranges = found[0]
    for other in found[1:]:
        ranges = ranges.union(other)
    by_doc = ranges.groupBy("ord").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    schema = "ord long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return materialize(texts.join(by_doc, "ord").select("ord", "z", "low", "high").mapInArrow(_cut_out, schema), "suffix-cut")
