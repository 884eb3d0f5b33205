"""Joining predictions to references and setting runs side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gistworks.operators.joins import keys_of

MISSING = "{Summary missing}"


def align_pairs(predictions: DataFrame, references: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """(run_id, keys, prediction, reference) for every prediction with a reference.

    Keys are dataset and id unless given, where both frames have them. A plain
    keyed join: the planner picks its form by size, and a document with very
    many predictions is split at run time.
    """
    keys = keys_of(predictions, references, keys=keys)
    keyed = references.select(*keys, F.col("summary").alias("reference"))
    return predictions.select("run_id", *keys, "prediction").join(keyed, keys)


def align_report(predictions: DataFrame, references: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """How many predictions and references match, and how many stand alone. Keys only."""
    keys = keys_of(predictions, references, keys=keys)
    left = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    right = references.select(*keys, F.lit(True).alias("known"))
    n = F.coalesce("n", F.lit(0))
    known = F.col("known").isNotNull()
    return left.join(right, keys, "full_outer").agg(
        F.sum(F.when(known, n).otherwise(0)).alias("matched_predictions"),
        F.sum(F.when(known, F.lit(0)).otherwise(n)).alias("predictions_without_reference"),
        F.count_if(known & F.col("n").isNull()).alias("references_without_prediction"),
    )


def side_by_side(
    pairs: DataFrame, predictions: DataFrame, runs: Sequence[str], run: str = "model", keys: Sequence[str] | None = None
) -> DataFrame:
    """The rows of ``pairs`` and one column per run, gaps spelled out.

    Predictions are reduced per document before and after one shuffle, which the join reuses.
    """
    keys = keys_of(pairs, predictions, keys=keys)
    per_id = (
        predictions.where(F.col(run).isin(list(runs)))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col(run) == r, F.col("prediction"))).alias(r) for r in runs])
    )
    shown = [F.coalesce(F.col(f"`{r}`"), F.lit(MISSING)).alias(r) for r in runs]
    return pairs.join(per_id, keys, "left").select(*pairs.columns, *shown)
