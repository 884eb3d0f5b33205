"""Prediction logs: one JSON list, or one prediction per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gistworks.functions.runkeys import route_corpus
from gistworks.session import materialize, small_files


def _json_list(text: str):
    return F.from_json(text, "array<string>")


def parse_logs(df: DataFrame, content: str = "content") -> DataFrame:
    """(folder, position, prediction) from a column holding whole logs.

    A log of one line that is a JSON list gives its items; any other log gives
    its lines. The line break that ends the last line opens no further line.
    """
    body = F.regexp_replace(content, "\n\\z", "")
    one_line = ~F.contains(body, F.lit("\n"))
    items = F.coalesce(F.when(one_line, _json_list(content)), F.split(body, "\n"))
    return df.select("folder", F.posexplode(items).alias("position", "prediction"))


def scan_logs(spark: SparkSession, root: str, pattern: str = "*/*.out") -> DataFrame:
    """The same from files, read line by line so that a large log spreads over tasks.

    A line's position is its rank inside its file block plus the lines of the
    blocks before it, so no task sees more than one block of a log. The lines
    are read once and stored with their block and number: counts and positions
    come from one split of the files, whatever the parallelism is later.
    """
    # File paths arrive percent-encoded; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    with small_files(spark):
        read = spark.read.text(f"{root}/{pattern}").select(
            F.regexp_extract(F.substring_index(path, "/", -2), "(?:run=)?([^/]+)/[^/]+$", 1).alias("folder"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("seen"),
            F.col("value"),
        )
        lines = materialize(read, "lines")
    # Rows of a block are numbered in reading order, so its first number is all it takes.
    blocks = lines.groupBy("folder", "block").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("first"))
    in_log = Window.partitionBy("folder")
    offsets = blocks.select(
        "folder",
        "block",
        "first",
        F.sum("n").over(in_log).alias("lines"),
        (F.sum("n").over(in_log.orderBy("block")) - F.col("n")).alias("offset"),
    )
    joined = lines.join(offsets, ["folder", "block"])
    numbered = joined.withColumn("nth", F.col("seen") - F.col("first"))
    items = F.coalesce(F.when(F.col("lines") == 1, _json_list("value")), F.array("value"))
    return numbered.select(
        "folder", (F.col("offset") + F.col("nth")).alias("line"), F.posexplode(items).alias("item", "prediction")
    ).select("folder", (F.col("line") + F.col("item")).cast("int").alias("position"), "prediction")


def route_logs(df: DataFrame) -> DataFrame:
    """Attach the corpus a run folder belongs to."""
    return df.withColumn("dataset", route_corpus(F.col("folder")))


def logs_by_corpus(predictions: DataFrame) -> DataFrame:
    """Runs and predictions kept per corpus, counted per folder first."""
    per_log = predictions.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return (
        route_logs(per_log)
        .groupBy("dataset")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("n").alias("predictions"))
    )
