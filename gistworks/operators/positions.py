"""Rows numbered in order inside their groups, and outputs that know only their place joined to references.

A group may hold most of all rows: rows are dealt out by ranges of group and
order, numbered where they lie, and stored; the counts of (task, group) give
each task's start. No task sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gistworks.session import materialize

#: monotonically_increasing_id holds the row's place in its task in the low bits.
_PLACE_BITS = 33


def number_rows(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], into: str = "position") -> DataFrame:
    """``df`` with each row's position in its group by ``order``, from 0 and without gaps; a stored table.

    Nulls come first; null groups are groups. Rows equal in ``order`` take
    positions in any order, which is kept as stored.
    """
    keys = [*[F.col(g) for g in groups], *[F.col(o) if isinstance(o, str) else o for o in order]]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    stored = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_at", _PLACE_BITS)
    counts = stored.groupBy(*groups, task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{k}") for k, g in enumerate(groups)], F.col("_task").alias("_of"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    same = task == F.col("_of")
    for k, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return stored.join(starts, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias(into))


def position_report(outputs: DataFrame, references: DataFrame, group: str = "dataset") -> DataFrame:
    """(run_id, group, outputs, references, aligned): rows on both sides of every run, and whether they are as many."""
    runs = outputs.groupBy("run_id", group).agg(F.count(F.lit(1)).alias("outputs"))
    known = references.groupBy(group).agg(F.count(F.lit(1)).alias("references"))
    both = runs.join(known, group, "left").withColumn("references", F.coalesce("references", F.lit(0)))
    return both.select("run_id", group, "outputs", "references", (F.col("outputs") == F.col("references")).alias("aligned"))


def align_positions(
    outputs: DataFrame, references: DataFrame, group: str = "dataset", order: Sequence[str] = ("id",), carried: Sequence[str] = ("id",)
) -> tuple[DataFrame, DataFrame]:
    """Pairs of outputs without identifiers and references, by place; and the report of all runs.

    ``outputs`` are (run_id, group, position, prediction), ``references`` have
    the group, the order and ``summary``. A run is aligned only if it has as
    many outputs as its group has references: behind a gap every pair would be
    wrong. Pairs are (run_id, group, carried, prediction, reference).
    """
    numbered = number_rows(references.select(group, *dict.fromkeys([*order, *carried]), F.col("summary").alias("reference")), [group], order)
    report = materialize(position_report(outputs, references, group), "report")
    whole = report.where("aligned").select("run_id", group)
    kept = outputs.join(whole, ["run_id", group], "left_semi")
    pairs = kept.select("run_id", group, F.col("position").cast("long").alias("position"), "prediction").join(numbered, [group, "position"])
    return pairs.select("run_id", group, *carried, "prediction", "reference"), report
