"""Token-length distributions of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gistworks.functions.tokenizer import RUNS, Tokenizer

CUTOFF = 18000


def token_lengths(df: DataFrame, sides: tuple[str, ...] = ("text", "summary"), tokenizer: Tokenizer = RUNS) -> DataFrame:
    """``<side>_tokens`` per row; the strings are left behind."""
    counts = [tokenizer.count(F.col(s)).alias(f"{s}_tokens") for s in sides]
    return df.select("id", "dataset", "split", *counts)


def length_cutoff(lengths: DataFrame, column: str = "num_tok", cutoff: int = CUTOFF) -> DataFrame:
    return lengths.where(F.col(column) < cutoff)


def length_histogram(lengths: DataFrame, column: str = "num_tok", width: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per half-open bin [width·i, width·(i+1)), in each group of ``by``.

    Every row is counted, the longest too; a plot over edges that stop below
    the maximum would lose it.
    """
    start = F.floor(F.col(column) / width) * width
    return lengths.groupBy(*by, start.cast("long").alias("bin_start")).agg(F.count(F.lit(1)).alias("n"))


def length_summary(lengths: DataFrame, column: str = "num_tok", by: tuple[str, ...] = ()) -> DataFrame:
    return lengths.groupBy(*by).agg(
        F.max(column).alias("longest"),
        F.min(column).alias("shortest"),
        F.round(F.avg(column), 6).alias("average"),
    )


def length_top(lengths: DataFrame, column: str = "num_tok", n: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` most common lengths, shorter first among equals; with ``by``, of each group."""
    counted = lengths.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    order = (F.desc("n"), F.asc(column))
    if not by:
        return counted.orderBy(*order).limit(n)
    # Ranks below a constant are cut in each task before the counts are shuffled by group.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counted.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def length_by_side(
    df: DataFrame, sides: tuple[str, ...] = ("text", "summary"), by: tuple[str, ...] = (), tokenizer: Tokenizer = RUNS
) -> DataFrame:
    """Longest, shortest and mean length of each side from one scan.

    Both sides are counted in the same pass; only the finished figures are
    turned into rows.
    """
    lengths = df.select(*by, *[tokenizer.count(F.col(s)).alias(s) for s in sides])
    figures = lengths.groupBy(*by).agg(
        *[
            F.struct(
                F.lit(s).alias("side"),
                F.max(s).alias("longest"),
                F.min(s).alias("shortest"),
                F.round(F.avg(s), 6).alias("average"),
            ).alias(s)
            for s in sides
        ]
    )
    return figures.select(*by, F.inline(F.array(*sides)))
