"""Gapless positions inside groups, however large a single group is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gistworks.llm.common import Stored, prepare, task_number


def _changes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _number(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n = task_number(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            column = batch.column(group)
            starts = np.concatenate(([0], np.flatnonzero(_changes(column)) + 1))
            first = column.slice(0, 1)
            same = held is not None and not _changes(pa.concat_arrays([held, first]))[0]
            sizes = np.diff(np.concatenate((starts, [len(batch)])))
            at = np.arange(len(batch)) - np.repeat(starts, sizes)
            if same:
                at[: sizes[0]] += n
            n, held = int(at[-1]) + 1, column.slice(len(batch) - 1, 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(batch), part), pa.int32()), pa.array(at, pa.int64())],
                [*batch.schema.names, "part", "at"],
            )

    return run


def ranked(df: DataFrame, group: str, order: list, label: str) -> tuple[DataFrame, Stored]:
    """``df`` with ``at``, the position of a row inside its group (from 0), and ``size``, the group's rows.

    Rows are range-partitioned by group, order and row, so one group may span
    any number of tasks; each task numbers its rows and the counts of (task,
    group), at most tasks + groups rows, are summed over the tasks before. Rows
    equal in ``order`` take positions in an arbitrary but stored order. Nulls
    come first and form a group of their own. The second value is the stored
    table behind the frame, to be dropped once nothing reads it.
    """
    prepare(df.sparkSession)
    keys = [F.col(group), *order, F.col("__row")]
    dealt = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__row")
    schema = StructType([*dealt.schema.fields, StructField("part", IntegerType()), StructField("at", LongType())])
    table = Stored(dealt.mapInArrow(_number(group), schema), label)
    rows = table.read()
    counts = rows.groupBy("part", group).agg(F.count("*").alias("n"))
    tasks = Window.partitionBy(group)
    counts = counts.select(
        F.col("part").alias("__part"), F.col(group).alias("__group"), F.sum("n").over(tasks).alias("size"),
        F.coalesce(F.sum("n").over(tasks.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    joined = rows.join(counts, (F.col("part") == F.col("__part")) & F.col(group).eqNullSafe(F.col("__group")))
    return joined.select(*df.columns, (F.col("at") + F.col("__before")).alias("at"), "size"), table
