"""Column functions over Arrow arrays that hold little at once.

Spark sends batches by number of rows, whatever their size.  A function here gets
them cut by bytes, and its results leave piece by piece, so that a Python worker
holds one batch of input and the results of one piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once.
PIECE_BYTES = 1 << 20

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, as Spark keeps a Python worker for later stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """The column of texts or bytes cut so that each piece has about ``limit`` bytes; a longer value is a piece of its own."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield column.slice(at, stop - at)
        at = stop


def function(make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str):  # noqa: ANN201
    """A column function of type ``kind``; ``make`` is called once a task for what works on a piece."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for column in columns:
            if not len(column):
                yield work(column)
            for piece in pieces(column):
                yield work(piece)
        give_back()

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts or bytes, and where its values begin and end; null is empty."""
    kind = column.type
    flat = column.cast(pa.large_binary() if pa.types.is_large_string(kind) or pa.types.is_large_binary(kind) else pa.binary())
    flat = pc.fill_null(flat, b"") if flat.null_count else flat
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_binary(flat.type) else np.int32
    _, ends, data = flat.buffers()
    bounds = np.frombuffer(ends, width)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def nulls(column: pa.Array) -> pa.Array | None:
    """A mask of the nulls, if there are any."""
    return pc.is_null(column) if column.null_count else None


def lists(values: pa.Array, bounds: np.ndarray, mask: pa.Array | None) -> pa.Array:
    """Lists of ``values`` between ``bounds``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values, mask=mask)
