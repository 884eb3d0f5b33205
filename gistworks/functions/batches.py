"""Arrow batches cut by bytes.

Spark bounds a batch by rows and by tens of MB; as Python objects its values take
several times that, and more for what a function makes of them. Functions over
texts therefore see a part at a time, so that a worker's memory does not grow
until its batches are full.

Workers are used again by later tasks and stages. What a function has freed stays
with its process, scattered over the heap, so that a worker grows to the sum of
what several steps needed; heavy functions therefore hand it back at their end.
"""

from __future__ import annotations

import ctypes
import inspect
import sys
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of values that are made Python objects at once; a larger row stands alone.
PART_BYTES = 1 << 20
#: What a row, and an entry of a list, count for besides.
_ROW, _ENTRY = 64, 8


def _weights(values: pa.Array) -> np.ndarray:
    """About how many bytes each row has."""
    kind = values.type
    if pa.types.is_struct(kind):
        return sum((_weights(f) for f in values.flatten()), np.zeros(len(values), np.int64))
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        # Entries count alike, so that none of them needs a number of its own.
        inner = values.flatten()
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return sizes * (_ENTRY + inner.nbytes // max(len(inner), 1))
    if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.zeros(len(values), np.int64)


def parts(batch: pa.Array | pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.Array | pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes, in order; an empty batch has none."""
    columns = batch.columns if isinstance(batch, pa.RecordBatch) else [batch]
    weights = sum((_weights(c) for c in columns), np.full(len(batch), _ROW, np.int64))
    run = (np.cumsum(weights) - weights) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def values(column: pa.Array) -> Iterator:
    """The column's values, made Python objects a part at a time."""
    for part in parts(column):
        yield from part.to_pylist()


@cache
def _trim() -> Callable | None:
    """The C library's call that frees unused heap; only glibc has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def hand_back() -> None:
    """Gives the system the memory that this process has freed."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def handing_back(f: Callable) -> Callable:
    """The function, or the generator, after whose end a worker hands back its memory; arguments by position."""

    @wraps(f)
    def returned(*args):
        try:
            return f(*args)
        finally:
            hand_back()

    @wraps(f)
    def generated(*args):
        try:
            yield from f(*args)
        finally:
            hand_back()

    return generated if inspect.isgeneratorfunction(f) else returned


def frame_parts(frame: pd.DataFrame, most: int = PART_BYTES) -> Iterator[pd.DataFrame]:
    """The same of a frame; an empty one is its own part."""
    weights = np.full(len(frame), _ROW, np.int64)
    for name in frame.columns[frame.dtypes == object]:
        weights += np.fromiter((len(v) if hasattr(v, "__len__") else 0 for v in frame[name]), np.int64, len(frame))
    run = (np.cumsum(weights) - weights) // most
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(frame)]
    for a, b in zip(edges, edges[1:]):
        yield frame.iloc[a:b]
