"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffles and splits skewed joins at run time; the
# forced form lets it split a skewed join even when the following aggregation
# then needs a shuffle of its own. Long documents make large Arrow rows, so a
# batch is bounded in bytes and in rows. Merging at run time only ever lowers the
# number of shuffle partitions, so a large job should also set
# spark.sql.adaptive.coalescePartitions.initialPartitionNum to about its shuffled
# bytes over 128 MB.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def build_session(app: str = "gistworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gistworks-"))
    return spark.sparkContext.getCheckpointDir()


_made: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


# A small file counts for this many bytes when files are dealt over tasks.
_OPEN_COST = 512 << 10


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """Settings under which many small files are listed and read in few tasks.

    Spark lists up to 10,000 paths in a task each, and counts a file for 4 MB.
    """
    wanted = {
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism),
        "spark.sql.files.openCostInBytes": str(_OPEN_COST),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Used where a result feeds several jobs or must not be computed twice: the
    lineage ends at the written table, so a lost executor costs a re-read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def discard(stored: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialize` that nothing will read again."""
    delete_path(stored.sparkSession, stored.stored_at)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application, once its results are stored or shown.

    Frames that operators returned may still read theirs, so only the caller
    knows when.
    """
    for path in _made.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_gistworks_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gistworks-")) / "gistworks.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._gistworks_shipped = True
