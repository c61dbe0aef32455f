"""Record batches in small pieces: what a task's Python holds at once does not grow with Spark's batches, nor so with the input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

Batches = Iterator[pa.RecordBatch]
Step = Callable[[Batches], Batches]

#: Rows and bytes of a piece at most. A row that is longer is a piece of its own.
ROWS, BYTES = 256, 4 << 20


def pieces(batches: Batches, rows: int = ROWS, size: int = BYTES) -> Batches:
    """Slices of batches, in order and without copies, each of `rows` rows and `size` bytes at most, one row at least."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _within(batch.slice(at, rows), size)


def _within(piece: pa.RecordBatch, size: int) -> Batches:
    if piece.num_rows < 2 or piece.nbytes <= size:
        yield piece
        return
    half = piece.num_rows // 2
    yield from _within(piece.slice(0, half), size)
    yield from _within(piece.slice(half), size)


def chained(*steps: Step) -> Step:
    """The steps one after the other in one pass, hence in one Python worker a task, in place of one for each step."""

    def run(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as a record batch."""
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
