"""SentencePiece encoding and decoding by suffix-array matching.

A batch's different segments are concatenated and indexed by a suffix array (sorted as far as the longest piece
reaches). Every piece of the vocabulary is binary-searched for its range of suffixes, whose positions are the edges of
a lattice. Edges are sorted by position and relaxed from left to right.

The vocabulary is a byte-pair one (merges by score, then leftmost), so relaxing keeps, for each position, the last
piece of the prefix's encoding: an edge extends the encoding at its start if its piece and the last piece there encode
to just themselves when joined. Exactly one edge into each position does. Pieces that merging never yields make no
edges. Characters without a piece become their UTF-8 bytes' pieces.

Segments start at white space (no piece holds white space behind another character) and at line ends, so encoding a
text's segments one by one, each different one once, is encoding the text.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of new segments that one suffix array indexes, and segments that a worker remembers between batches.
INDEX_CHARS = 1 << 18
REMEMBERED = 150_000
#: Segments of which so few are left in a batch are followed one by one.
FEW = 32
#: Characters of whole texts that are encoded together.
TEXT_CHARS = 1 << 19
_SEGMENT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


@dataclass
class Vocabulary:
    """Pieces by id with scores; byte_ids[b] is the id of byte b's piece, or -1; special ids never come out of a text."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: set[int]

    @cached_property
    def by_text(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if i not in self.special}

    @cached_property
    def as_bytes(self) -> list[bytes]:
        out = [b"" if i in self.special else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                out[i] = bytes([b])
        return out

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Pieces by merging order: 0 has the best score, equal scores have equal ranks."""
        place = {x: n for n, x in enumerate(sorted({self.scores[i] for i in self.by_text.values()}, reverse=True))}
        return {p: place[self.scores[i]] for p, i in self.by_text.items()}

    def merge(self, text: str, last: list[tuple[str, str]] | None = None) -> list[str]:
        """Plain byte-pair merging of one segment: the best score first, then the leftmost. The parts of the last merge
        are put into `last`."""
        parts, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        heap: list[tuple[int, int, str, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(parts) and (found := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (found, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] == left else len(parts)
            if not left or j >= len(parts) or parts[j] != right:
                continue
            if last is not None:
                last[:] = [(left, right)]
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p]


class Pairs:
    """Tells of many pairs of pieces at once whether their joined text encodes to just the two.

    It does unless a merge across the border comes before those that complete both pieces. So the merges of both are
    undone, the last one first, and at each step the pieces that meet at the border are looked up. That the last merge
    is the one of the worst rank holds for pieces none of whose parts has a worse rank than what it becomes; pairs with
    any other piece are merged instead.
    """

    def __init__(self, vocabulary: Vocabulary, able: list[str]):
        self.v, self.size = vocabulary, len(vocabulary.pieces) + 1
        ids, ranks = vocabulary.by_text, vocabulary.ranks
        self.rank = np.full(self.size, -1, dtype=np.int64)  # of pieces that a merge makes
        self.left, self.right = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        self.odd = np.zeros(self.size, dtype=bool)
        for p in sorted(able, key=len):
            if len(p) > 1:
                last: list[tuple[str, str]] = []
                vocabulary.merge(p, last)
                i, a, b = ids[p], *(ids[x] for x in last[0])
                self.rank[i], self.left[i], self.right[i] = ranks[p], a, b
                self.odd[i] = self.odd[a] or self.odd[b] or max(self.rank[a], self.rank[b]) >= ranks[p]
        joins = {ids[p[:k]] * self.size + ids[p[k:]]: r for p, r in ranks.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.keys = np.array(sorted(joins) or [-1], dtype=np.int64)
        self.made = np.array([joins[k] for k in sorted(joins)] or [0], dtype=np.int64)

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.ones(len(left), dtype=bool)
        strange = self.odd[left] | self.odd[right]
        for n in np.flatnonzero(strange).tolist():
            x, y = self.v.pieces[left[n]], self.v.pieces[right[n]]
            out[n] = self.v.merge(x + y) == [x, y]
        live = np.flatnonzero(~strange)
        a, b = left[live], right[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            across = (self.keys[at] == key) & (self.made[at] < limit)
            out[live[across]] = False
            p, q = self.rank[a], self.rank[b]
            go = ~across & ((p >= 0) | (q >= 0))
            live, a, b, p, q = live[go], a[go], b[go], p[go], q[go]
            # Of two merges of one rank the left one comes first, so it is undone last, and a merge across the border
            # comes before the right one but not before the left one.
            first = p > q
            limit = np.where(first, p, q + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out


def load(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    byte_ids = [-1] * 256
    for i in range(n):
        if m.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i)}
    return Vocabulary(pieces, [m.get_score(i) for i in range(n)], byte_ids, special)


class Encoder:
    """Encodes texts with one vocabulary; keeps what it learns about segments and pairs of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        able = [(p, i) for p, i in vocabulary.by_text.items() if len(p) == 1 or vocabulary.merge(p) == [p]]
        self.ids = np.array([i for _, i in able], dtype=np.int64)
        self.lengths = np.zeros(len(vocabulary.pieces) + 1, dtype=np.int64)
        self.texts = [p for p, _ in able]
        self.lengths[self.ids] = [len(p) for p in self.texts]
        self.reach = max(map(len, self.texts), default=1)
        self.alphabet = np.unique(np.frombuffer("".join(self.texts).encode("utf-32-le"), dtype=np.uint32))
        bits = max(1, int(len(self.alphabet) + 1).bit_length())
        self.per_word = 63 // bits
        self.bits = bits
        self.low, self.high = self._piece_keys()
        self.pairs = Pairs(vocabulary, self.texts)
        self._forget_pairs()
        self.known: dict[str, bytes] = {}
        self.unknown = len(vocabulary.pieces)  # stands for a character without a piece; never merges
        self.lengths[self.unknown] = 1

    def _words(self, codes: np.ndarray) -> list[np.ndarray]:
        """Keys of all suffixes: their first `reach` codes, packed into 63-bit words, the first word first."""
        n = len(codes)
        padded = np.concatenate([codes, np.zeros(self.reach + self.per_word, dtype=np.int64)])
        out = []
        for first in range(0, self.reach, self.per_word):
            word = np.zeros(n, dtype=np.int64)
            for d in range(first, first + self.per_word):
                word = (word << self.bits) | (padded[d : d + n] if d < self.reach else 0)
            out.append(word)
        return out

    def _piece_keys(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The least and the greatest suffix key that starts with each piece."""
        codes = np.zeros((len(self.texts), self.reach), dtype=np.int64)
        for row, p in enumerate(self.texts):
            codes[row, : len(p)] = np.searchsorted(self.alphabet, np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)) + 2
        inside = np.arange(self.reach) < np.array([len(p) for p in self.texts])[:, None]
        top = np.where(inside, codes, (1 << self.bits) - 1)
        low, high = [], []
        for first in range(0, self.reach, self.per_word):
            a = np.zeros(len(self.texts), dtype=np.int64)
            b = a.copy()
            for d in range(first, first + self.per_word):
                a = (a << self.bits) | (codes[:, d] if d < self.reach else 0)
                b = (b << self.bits) | (top[:, d] if d < self.reach else 0)
            low.append(a)
            high.append(b)
        return low, high

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search of many multi-word keys at once: the first suffix at or above (right: above) each."""
        n = len(keys[0])
        low, high = np.zeros(len(wanted[0]), dtype=np.int64), np.full(len(wanted[0]), n, dtype=np.int64)
        for _ in range(int(n).bit_length()):
            live = low < high
            mid = np.minimum((low + high) // 2, n - 1)
            below, equal = np.zeros(len(mid), dtype=bool), np.ones(len(mid), dtype=bool)
            for k, w in zip(keys, wanted, strict=True):
                here = k[mid]
                below |= equal & (here < w)
                equal &= here == w
            go = live & (below | (equal & right))
            low, high = np.where(go, mid + 1, low), np.where(live & ~go, mid, high)
        return low

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece id) of every occurrence of every piece, by way of the suffix array."""
        words = self._words(codes)
        suffixes = np.lexsort(words[::-1]).astype(np.int32)
        keys = [w[suffixes] for w in words]
        del words
        first, last = self._search(keys, self.low, False), self._search(keys, self.high, True)
        many = last - first
        offset = np.repeat((first - np.concatenate([[0], np.cumsum(many)[:-1]])).astype(np.int32), many) + np.arange(many.sum(), dtype=np.int32)
        return suffixes[offset], np.repeat(self.ids.astype(np.int32), many)

    def _forget_pairs(self) -> None:
        self.pair_keys, self.pair_agrees = np.array([np.iinfo(np.int64).max]), np.zeros(1, dtype=bool)
        self.new_keys: list[np.ndarray] = []
        self.new_agrees: list[np.ndarray] = []

    def _agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbouring pieces is what their joined text encodes to; -1 on the left is the start."""
        key = left * (self.unknown + 1) + right
        different, back = np.unique(key, return_inverse=True)
        at = np.minimum(np.searchsorted(self.pair_keys, different), len(self.pair_keys) - 1)
        verdict, settled = self.pair_agrees[at], self.pair_keys[at] == different
        fresh = np.flatnonzero(~settled)
        if len(fresh):
            a, b = np.divmod(different[fresh], self.unknown + 1)
            found = np.ones(len(fresh), dtype=bool)
            real = (a >= 0) & (a != self.unknown) & (b != self.unknown)
            found[real] = self.pairs.agree(a[real], b[real])
            verdict[fresh] = found
            self.new_keys.append(different[fresh])
            self.new_agrees.append(found)
        return verdict[back]

    def _settle_pairs(self) -> None:
        """Move what was learnt about pairs into sorted arrays, where many are looked up at once, when enough is new."""
        if 8 * sum(map(len, self.new_keys)) < len(self.pair_keys):
            return
        keys, first = np.unique(np.concatenate([self.pair_keys, *self.new_keys]), return_index=True)
        self.pair_keys, self.pair_agrees = keys, np.concatenate([self.pair_agrees, *self.new_agrees])[first]
        self.new_keys, self.new_agrees = [], []

    def _index(self, segments: list[str]) -> None:
        """Encode new segments together and remember them."""
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), dtype=np.uint32)
        inside = np.ones(len(points), dtype=bool)
        inside[starts + sizes] = False
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(inside, np.where(self.alphabet[at] == points, at + 2, 1), 0).astype(np.int64)

        begin, piece = self.edges(codes)
        lone = np.flatnonzero(codes == 1).astype(np.int32)
        begin, piece = np.concatenate([begin, lone]), np.concatenate([piece, np.full(len(lone), self.unknown, dtype=np.int32)])
        base = np.zeros(len(points), dtype=np.int32)
        base[starts[1:]] = np.diff(starts)
        base = np.cumsum(base, dtype=np.int32)  # where the segment of each place starts
        depth = begin + self.lengths[piece].astype(np.int32) - base[begin]
        order = np.argsort(depth, kind="stable").astype(np.int32)
        begin, piece, depth = begin[order], piece[order], depth[order]
        last = np.full(len(points) + 1, -1, dtype=np.int32)
        cuts = np.flatnonzero(np.diff(depth)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(depth)], strict=True):
            if a == b:
                continue
            at, through = begin[a:b], piece[a:b]
            before = np.where(at == base[at], -1, last[at])
            fits = self._agree(before.astype(np.int64), through.astype(np.int64))
            last[at[fits] + self.lengths[through[fits]]] = through[fits]
        self._settle_pairs()
        self.known.update(zip(segments, self._traced(last, starts, starts + sizes, points), strict=True))

    def _traced(self, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> list[bytes]:
        """The piece ids of every segment, packed: all are followed back from their ends at once."""
        at, segment = ends.copy(), np.arange(len(ends))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at) > FEW:
            piece = last[at]
            found.append((segment, piece, at))
            at = at - self.lengths[piece]
            inside = at > starts[segment]
            at, segment = at[inside], segment[inside]
        for n, q in zip(segment.tolist(), at.tolist(), strict=True):  # what is longer than all others, one by one
            start, trail = int(starts[n]), []
            while q > start and last[q] >= 0:
                trail.append(q)
                q -= int(self.lengths[last[q]])
            found += [(np.full(1, n), last[q : q + 1], np.full(1, q))] * (q > start)
            if trail:
                places = np.array(trail)
                found.append((np.full(len(places), n), last[places], places))
        if not found:
            return [b""] * len(ends)
        segment, piece, place = (np.concatenate([f[k] for f in found]) for k in range(3))
        if (piece < 0).any():
            raise ValueError("a segment without an encoding")
        order = np.lexsort((place, segment))
        segment, piece, place = segment[order], piece[order], place[order]
        ids, many = piece.astype(np.int32), np.ones(len(piece), dtype=np.int64)
        strange = np.flatnonzero(piece == self.unknown)
        if len(strange):
            raw = [chr(int(points[q - 1])).encode("utf-8", "replace") for q in place[strange]]
            many[strange] = [len(r) for r in raw]
            ids = np.repeat(ids, many)
            spots = np.cumsum(many) - many
            for n, r in zip(strange.tolist(), raw, strict=True):
                ids[spots[n] : spots[n] + len(r)] = [self.v.byte_ids[b] for b in r]
        ends = np.cumsum(np.bincount(segment, weights=many, minlength=len(ends)).astype(np.int64)) * 4
        blob, cuts = ids.tobytes(), [0, *ends.tolist()]
        return [blob[a:b] for a, b in itertools.pairwise(cuts)]

    def encode(self, texts: list[str | None]) -> list[array]:
        """Piece ids of each whole text; null and empty texts have none."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.pair_keys) > 12 * REMEMBERED:
            self._forget_pairs()
        cut = [_SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh: dict[str, None] = {}
        room = INDEX_CHARS
        for segments in cut:
            new = dict.fromkeys(itertools.filterfalse(self.known.__contains__, segments))
            if new:
                room -= sum(map(len, new)) + len(new)
                fresh |= new
            if room <= 0:
                self._index(list(fresh))
                fresh, room = {}, INDEX_CHARS
        if fresh:
            self._index(list(fresh))
        return [array("i", b"".join(map(self.known.__getitem__, segments))) for segments in cut]


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(name: str, vocabulary: Vocabulary) -> Encoder:
    """A worker's one encoder for a vocabulary: what it has learnt serves the worker's later tasks too."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def decode(vocabulary: Vocabulary, ids) -> str:
    """The text of piece ids, without the space that encoding put first; broken UTF-8 becomes U+FFFD."""
    pieces = vocabulary.as_bytes
    return b"".join([pieces[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _batches(part: pa.Array) -> Iterator[list[str | None]]:
    held, size = [], 0
    for text in part:
        held.append(text.as_py())
        size += len(held[-1] or "")
        if size >= TEXT_CHARS:
            yield held
            held, size = [], 0
    yield held


def encoded(docs: DataFrame, text: Column, model: str = MODEL, back: bool = False) -> Column:
    """Column array<int>: the piece ids of a text column. The vocabulary (bounded by the model file) is broadcast.

    With back, a struct of ids and back, the text that they decode to, from the same worker.
    """
    loaded = load(model)
    name = hashlib.sha256(repr((loaded.pieces, loaded.scores)).encode()).hexdigest()
    vocabulary = docs.sparkSession.sparkContext.broadcast(loaded)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_for(name, vocabulary.value)
        for part in parts:
            blobs, sizes, texts = [], [0], []
            for held in _batches(part):
                coded = encoder.encode(held)
                sizes += map(len, coded)
                blobs.append(b"".join(coded))
                if back:
                    texts.append(pa.array([decode(encoder.v, ids) for ids in coded], type=pa.string()))
            ids = pa.ListArray.from_arrays(np.cumsum(sizes, dtype=np.int64).astype(np.int32), np.frombuffer(b"".join(blobs), dtype=np.int32))
            yield pa.StructArray.from_arrays([ids, pa.concat_arrays(texts)], names=["ids", "back"]) if back else ids
        encoder.known.clear()  # what is learnt about pairs serves later tasks; segments are many and take memory

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "ids array<int>, back string" if back else "array<int>")(text)


def decoded(docs: DataFrame, ids: Column, model: str = MODEL) -> Column:
    """Column string: the text of a column of piece ids."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([decode(vocabulary.value, x.values.to_pylist() if x.is_valid else []) for x in part], type=pa.string())

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, back: bool = False) -> DataFrame:
    """doc_id, text, ids (array of piece ids) for every row: a narrow pass over whole texts. back adds the decoded text.

    Null and empty texts have no ids; a text's own U+2581 counts as a space. Null and repeated ids are ordinary rows;
    an empty table gives no rows; other columns are dropped.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if back:
        return rows.withColumn("_c", encoded(docs, F.col("text"), model, True)).select("doc_id", "text", "_c.ids", "_c.back")
    return rows.withColumn("ids", encoded(docs, F.col("text"), model))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, comma-joined), decoded_sha256, exact (decoding gives the text back)."""
    return encode_documents(docs, id_col, text_col, model, back=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("back", 256).alias("decoded_sha256"),
        (F.col("back") == F.coalesce("text", F.lit(""))).alias("exact"),
    )
