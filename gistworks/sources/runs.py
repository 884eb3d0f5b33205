"""Score files of runs: ``<root>/<run folder>/metrics.json`` in two shapes."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistworks.functions.batches import parts
from gistworks.session import ship_package, small_files

VARIANTS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
_FLAT = ", ".join(f"{v} DOUBLE" for v in VARIANTS)

# Runs either nest the scores under the metric's name or list them directly.
SCORE_SCHEMA = f"rouge STRUCT<{_FLAT.replace(' DOUBLE', ': DOUBLE')}>, {_FLAT}"


def either_shape(parsed: str | None = None) -> list[Column]:
    """The four scores, nested or flat; ``parsed`` names a struct holding both."""
    at = f"{parsed}." if parsed else ""
    return [F.coalesce(F.col(f"{at}rouge.{v}"), F.col(f"{at}{v}")).alias(v) for v in VARIANTS]


def parse_scores(df: DataFrame, json: str = "json") -> DataFrame:
    """Scores from a column of JSON strings, one run folder per row."""
    parsed = df.select("folder", F.from_json(json, SCORE_SCHEMA).alias("scores"))
    return parsed.select("folder", *either_shape("scores"))


def scan_runs(spark: SparkSession, root: str, file: str = "metrics.json") -> DataFrame:
    """Every run folder below ``root`` that holds a score file; ``file`` may be a pattern.

    A folder that Spark has partitioned by run is named by the run.
    """
    with small_files(spark):
        files = spark.read.schema(SCORE_SCHEMA).option("multiLine", True).json(f"{root}/*/{file}")
    # File paths arrive percent-encoded; a plus sign stands for itself there.
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(path, "(?:run=)?([^/]+)/[^/]+$", 1)
    return files.select(folder.alias("folder"), *either_shape())


# As Spark's writers name the folders of a partition column.
_ESCAPED = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _folder_name(run: str) -> str:
    return "run=" + _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", run)


def _folder_writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes (run, value) sorted by run into files below ``root``; returns how many.

    A file has its name once it is whole, and a task that runs again writes the
    same names, so a dead attempt leaves nothing that is read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}.txt"
        unfinished = f".{name}.{task.taskAttemptId()}"
        rows = (row for b in batches for p in parts(b) for row in zip(p["run"].to_pylist(), p["value"].to_pylist()))
        n = 0
        for run, values in itertools.groupby(rows, lambda row: row[0]):
            at = f"{root}/{_folder_name(run)}"
            os.makedirs(at, exist_ok=True)
            with open(f"{at}/{unfinished}", "wb") as out:
                for _, value in values:
                    out.write((value or b"") + b"\n")
            os.replace(f"{at}/{unfinished}", f"{at}/{name}")
            n += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([n], pa.int64())})

    return write


def write_folders(contents: DataFrame, root: str) -> None:
    """(folder, content) as one text file in ``<root>/run=<folder>`` each.

    Where the folder is a mounted file system the tasks write the files
    themselves: there Spark's writer starts a process for each permission of a
    folder, a file and its checksum, which takes most of the time of small files.
    """
    spark = contents.sparkSession
    rows = contents.select(F.col("folder").alias("run"), F.regexp_replace("content", "\n\\z", "").alias("value"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if at.getScheme() != "file":
        rows.write.partitionBy("run").text(root)
        return
    ship_package(spark)
    named = F.coalesce(F.nullif(F.col("run").cast("string"), F.lit("")), F.lit(_NO_NAME)).alias("run")
    os.makedirs(at.getPath())
    (
        rows.select(named, F.col("value").cast("binary").alias("value"))
        .sortWithinPartitions("run")
        .mapInArrow(_folder_writer(at.getPath()), "files long")
        .agg(F.sum("files"))
        .collect()
    )
