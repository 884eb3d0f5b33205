"""Sides of joins that are small in bytes, and keys that frames share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

#: What may be shipped whole to every executor.
BROADCAST_BYTES = 64 << 20
#: Columns that tell rows apart: corpora number their rows each by itself.
KEYS = ("dataset", "id")


def keys_of(*frames: DataFrame, keys: Sequence[str] | None = None) -> list[str]:
    """``keys``, or those of KEYS that every frame has."""
    if keys is not None:
        return list(keys)
    found = [k for k in KEYS if all(k in f.columns for f in frames)]
    if not found:
        raise ValueError(f"none of {KEYS} is in every frame")
    return found


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows' strings and a fixed part per other value fit ``max_bytes``. Give a stored table."""
    sizes = [F.octet_length(f.name) + 8 if isinstance(f.dataType, T.StringType) else F.lit(16) for f in df.schema.fields]
    total = df.agg(F.sum(sum((F.coalesce(s, F.lit(8)) for s in sizes), F.lit(0)))).first()[0]
    return (total or 0) <= max_bytes
