"""Writing predictions, scores and the leaderboard, and reading them back.

Predictions are stored by key, never as bare lines: a prediction may hold line
breaks, and position alone does not say which document it belongs to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistworks.sources.runs import SCORE_SCHEMA, VARIANTS, either_shape

PREDICTION_SCHEMA = "id LONG, prediction STRING, run_id STRING"
LEADERBOARD_SCHEMA = "Folder STRING, RougeAvg DOUBLE, Rouge1 DOUBLE, Rouge2 DOUBLE, RougeL DOUBLE"


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per run. Rebalancing splits a large run over several files."""
    own = [c for c in ("dataset",) if c in predictions.columns]
    (
        predictions.select(*own, "id", "prediction", "run_id")
        .hint("rebalance", F.col("run_id"))
        .write.mode(mode)
        .partitionBy("run_id")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str, by_dataset: bool = False) -> DataFrame:
    schema = f"dataset STRING, {PREDICTION_SCHEMA}" if by_dataset else PREDICTION_SCHEMA
    return spark.read.schema(schema).parquet(path)


def write_metrics(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per run, scores nested under the metric's name."""
    nested = scores.select("folder", F.struct(*VARIANTS).alias("rouge"))
    nested.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Reads both score shapes."""
    stored = spark.read.schema(f"folder STRING, {SCORE_SCHEMA}").json(path)
    return stored.select("folder", *either_shape())


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per run: {"run_id": ..., "scores": {metric: {variant: value}}}.

    A report holds a few values per run, so a run's map is small.
    """
    entry = F.struct("variant", "value")
    metrics = report.groupBy("run_id", "metric").agg(F.map_from_entries(F.collect_list(entry)).alias("values"))
    nested = metrics.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "values"))).alias("scores"))
    nested.write.mode(mode).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, metric, variant, value) from nested scores."""
    stored = spark.read.schema("run_id STRING, scores MAP<STRING, MAP<STRING, DOUBLE>>").json(path)
    each = stored.select("run_id", F.explode("scores").alias("metric", "values"))
    return each.select("run_id", "metric", F.explode("values").alias("variant", "value"))


def write_leaderboard(board: DataFrame, path: str, mode: str = "errorifexists") -> None:
    board.write.mode(mode).option("header", True).csv(path)


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEADERBOARD_SCHEMA).option("header", True).csv(path)
