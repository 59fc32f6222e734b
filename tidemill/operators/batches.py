"""Rows to rows by a plain Python generator, over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a batch that is sent on, at most, and rows that are Python objects at a time.
ROWS, SLICE = 10_000, 200
#: Characters of a batch that is sent on, about.
CHARS = 4 << 20


def slices(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """A batch in pieces of SLICE rows, without copies."""
    return (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE))


def give_back() -> None:
    """Returns memory that a Python worker no longer uses to the system; workers live on, and would keep what the largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def _size(x) -> int:
    return len(x) if isinstance(x, (str, bytes)) else 8 + sum(map(_size, x)) if isinstance(x, (list, tuple)) else 8


def flat_map(df: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples of schema that rows_of(*row) gives for each row of df; a task holds one input batch, SLICE rows of it as objects, and an output batch of about CHARS, and nothing is shuffled."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for piece in slices(b):
                for row in zip(*(c.to_pylist() for c in piece.columns)):
                    for out in rows_of(*row):
                        held.append(out)
                        size += _size(out)
                        if size >= CHARS or len(held) >= ROWS:
                            yield batch(held)
                            held, size = [], 0
        if held:
            yield batch(held)
        held = []
        give_back()

    return df.mapInArrow(run, kind)
