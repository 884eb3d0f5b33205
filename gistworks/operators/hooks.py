"""Applying a user's Python functions to a corpus."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gistworks.functions.batches import frame_parts


def _schema(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def map_rows(df: DataFrame, fn: Callable[[dict], dict], adds: str | T.StructType, reads: tuple[str, ...]) -> DataFrame:
    """Add the columns ``fn`` computes from one row; it is given ``reads`` only.

    Existing columns of the same name are replaced.
    """
    added = _schema(adds)
    names = added.fieldNames()

    @F.pandas_udf(added)
    def apply(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([fn(r) for r in rows.to_dict("records")], columns=names)

    mapped = df.withColumn("_mapped", apply(F.struct(*reads)))
    return mapped.withColumns({n: F.col(f"_mapped.{n}") for n in names}).drop("_mapped")


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], gives: str | T.StructType, reads: tuple[str, ...]
) -> DataFrame:
    """Replace rows batch by batch, each bounded in bytes; ``fn`` may return more or fewer rows than it got."""
    given = _schema(gives)

    def run(frames):
        for frame in (p for whole in frames for p in frame_parts(whole)):
            result = fn({c: frame[c].tolist() for c in frame.columns})
            yield pd.DataFrame({n: result[n] for n in given.fieldNames()})

    return df.select(*reads).mapInPandas(run, given)
