"""Bootstrap intervals of means by Poisson weights (Efron 1979; Lin 2004, section 5).

Resample b gives a row the weight w, Poisson-distributed with mean 1. The weight
comes from a pairwise independent hash of the row's key, (a_b * key + c_b) mod a
prime, so it does not depend on partitioning, order or retries, and any engine
can make the same. All resamples are summed at once in an Arrow pass, rows by
resamples in a matrix, with partial sums before the shuffle: what moves is one
row per task, run and resample. Resample 0 has weight 1 everywhere and is the
plain mean.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gistworks.session import ship_package

PRIME = 2**31 - 1
#: Rows whose weights are made at once, so that they stay in a core's cache.
_BLOCK = 64
#: Bytes of sums that a task holds before it passes them on.
_HELD = 32 << 20


def _digits(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def coefficients(resamples: int, seed: str) -> tuple[list[int], list[int]]:
    """(a, c) of resamples 1 to ``resamples``."""
    numbers = range(1, resamples + 1)
    return [1 + _digits(f"{seed}:a:{b}") % (PRIME - 1) for b in numbers], [_digits(f"{seed}:c:{b}") % PRIME for b in numbers]


def thresholds() -> list[int]:
    """A draw below the k-th has a weight of at most k: PRIME times the Poisson distribution function."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if int(total * PRIME) >= PRIME - 1:
            return out
        out.append(int(total * PRIME))
        k += 1


def key_number(keys: Sequence[str]) -> Column:
    """A row's key as a number below the prime; a null part counts as an empty one."""
    spelled = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(spelled), 1, 15), 16, 10).cast("long") % PRIME


def _weights(keys: np.ndarray, a: np.ndarray, c: np.ndarray, steps: Sequence[int]) -> np.ndarray:
    """(rows, resamples and the plain one before them): each row's weight."""
    draw = np.multiply.outer(keys, a)
    draw += c
    for _ in range(2):  # 2**31 leaves 1 beside the prime: both halves add up to the same remainder
        draw = (draw & PRIME) + (draw >> 31)
    draw[draw >= PRIME] -= PRIME
    draw = draw.astype(np.int32)
    drawn = np.zeros(draw.shape, np.uint8)
    for step in steps:
        drawn += draw >= step
    return np.concatenate([np.ones((len(keys), 1)), drawn], axis=1)


def _sums(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """(values, resamples): weighted sums over the rows; a weight of 0 leaves out infinite values too."""
    odd = ~np.isfinite(values).all(1)
    if not odd.any():
        return values.T @ weights
    total = values[~odd].T @ weights[~odd]
    for w, row in zip(weights[odd], values[odd]):
        total += np.array([np.multiply(w, x, out=np.zeros_like(w), where=w > 0) for x in row])
    return total


def _summed(resamples: int, seed: str, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (run, key, values): (run, resample, weight, weighted sums), a row for each run and resample that drew any."""
    a, c = (np.array(x, np.int64) for x in coefficients(resamples, seed))
    steps = thresholds()

    def rows(held: dict[str, tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for run, (weight, *sums) in held.values():
            at = np.flatnonzero(weight > 0)
            columns = [run.take(pa.array(np.zeros(len(at), np.int64))), pa.array(at.astype(np.int32)), pa.array(weight[at].astype(np.int64)), *[pa.array(x[at]) for x in sums]]
            yield pa.RecordBatch.from_arrays(columns, list(names))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for batch in batches:
            values = np.column_stack([np.ones(len(batch)), *[x.to_numpy(zero_copy_only=False) for x in batch.columns[2:]]])
            whole = np.flatnonzero(~np.isnan(values).any(1))
            run = batch.column(0).take(pa.array(whole))
            named = pa.array([repr(r) for r in run.to_pylist()], pa.string()) if pa.types.is_nested(run.type) else run
            code = named.dictionary_encode("encode").indices.to_numpy()
            order = np.argsort(code, kind="stable")
            code, values, keys = code[order], values[whole][order], batch.column(1).to_numpy()[whole][order]
            for at in range(0, len(order), _BLOCK):
                block = slice(at, at + _BLOCK)
                weights = _weights(keys[block], a, c, steps)
                edges = np.flatnonzero(np.diff(code[block], prepend=-1, append=-1))
                for first, end in zip(edges, edges[1:]):
                    own = run.take(pa.array(order[at + first : at + first + 1]))
                    found = _sums(weights[first:end], values[block][first:end])
                    name = repr(own[0].as_py())
                    if name in held:
                        held[name][1][:] += found
                    else:
                        held[name] = own, found
                if len(held) * (resamples + 1) * values.shape[1] * 8 > _HELD:
                    yield from rows(held)
                    held = {}
        yield from rows(held)

    return sum_up


def bootstrap_means(scores: DataFrame, values: Sequence[str], run: str, keys: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """(run, resample, values): each resample's weighted means; those that drew nothing are absent.

    Rows with a null value or NaN are left out here, by the pass that reads them
    anyway: as a condition, Spark would move it below the scores and have them
    made twice.
    """
    ship_package(scores.sparkSession)
    numbered = scores.select(run, key_number(keys).alias("key"), *[F.col(v).cast("double").alias(v) for v in values])
    kinds = [T.StructField(run, numbered.schema[0].dataType), T.StructField("resample", T.IntegerType()), T.StructField("weight", T.LongType())]
    kinds += [T.StructField(v, T.DoubleType()) for v in values]
    drawn = numbered.mapInArrow(_summed(resamples, seed, [k.name for k in kinds]), T.StructType(kinds))
    sums = drawn.groupBy(run, "resample").agg(F.sum("weight").alias("weight"), *[F.sum(v).alias(v) for v in values])
    return sums.select(run, "resample", *[(F.col(v) / F.col("weight")).alias(v) for v in values])


def bootstrap_intervals(
    scores: DataFrame, values: Sequence[str], run: str = "run_id", keys: Sequence[str] = ("id",), resamples: int = 1000, level: float = 0.95, seed: str = "bootstrap"
) -> DataFrame:
    """(run, variant, low, mean, high, resamples): the mean of each value and the middle ``level`` of its resampled means.

    Bounds are order statistics by nearest rank, tails in thousandths. ``scores``
    is read once. Null values count in no mean of theirs: rows that have any are
    left out. A run of one row has an interval of one point; a run without
    rows does not appear.
    """
    tail = round((1 - level) * 500)
    if not 0 < tail < 500:
        raise ValueError("level must leave at least a thousandth at each end")
    means = bootstrap_means(scores, values, run, keys, resamples, seed)
    long = means.select(run, "resample", F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("value")) for v in values])))
    # At most ``resamples`` numbers to a group.
    each = long.groupBy(run, "variant").agg(
        F.max(F.when(F.col("resample") == 0, F.col("value"))).alias("mean"),
        F.sort_array(F.collect_list(F.when(F.col("resample") > 0, F.col("value")))).alias("drawn"),
    )
    n = F.size("drawn")
    rank = lambda part: F.greatest(F.expr("1"), F.ceil(n * part / 1000)).cast("int")
    at = lambda part: F.coalesce(F.get("drawn", rank(part) - 1), F.col("mean"))
    return each.select(run, "variant", at(tail).alias("low"), "mean", at(1000 - tail).alias("high"), n.cast("long").alias("resamples"))
