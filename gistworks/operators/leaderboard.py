"""Scores of many runs in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def rouge_avg(scores: DataFrame) -> DataFrame:
    """The arithmetic mean of ROUGE-1, -2 and -L of each run."""
    mean = (F.col("rouge1") + F.col("rouge2") + F.col("rougeL")) / 3
    return scores.select(
        F.col("folder").alias("Folder"),
        mean.alias("RougeAvg"),
        F.col("rouge1").alias("Rouge1"),
        F.col("rouge2").alias("Rouge2"),
        F.col("rougeL").alias("RougeL"),
    )


def rouge_geo_mean(board: DataFrame) -> DataFrame:
    """Scores times 100 and their geometric mean, taken before scaling."""
    product = F.col("Rouge1") * F.col("Rouge2") * F.col("RougeL")
    scaled = {c: F.col(c) * 100 for c in ("Rouge1", "Rouge2", "RougeL")}
    return board.withColumn("geo_mean", F.pow(product, F.lit(1.0 / 3.0)) * 100).withColumns(scaled)


def leaderboard(scores: DataFrame) -> DataFrame:
    return rouge_avg(scores).orderBy("Folder")


def best_checkpoint(log: DataFrame) -> DataFrame:
    """Per run the step of the highest score, the earlier one among equals; runs
    without any score keep their newest step."""
    ranked = F.struct(F.col("eval_rouge1"), -F.col("step"))
    scored = F.when(F.col("eval_rouge1").isNotNull(), F.col("step"))
    return log.groupBy("run_id").agg(
        F.coalesce(F.max_by(scored, ranked), F.max("step")).alias("step"),
        F.max("eval_rouge1").alias("eval_rouge1"),
    )
