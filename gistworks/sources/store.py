"""Tables of runs that may be written again: the last committed version of a run is the one that is read.

A write puts its runs' rows into files of a new version, beside what is there,
and only then commits: one mark for each run, appended in a single job. Readers
take for every run the version of its last mark. A write that dies leaves rows
that no mark names; a run written twice is there once; runs that a write doesn't
hold are untouched. ``clean`` deletes what no mark names any more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gistworks.session import delete_path

_MARKS = StructType([StructField("run", StringType()), StructField("version", StringType()), StructField("number", LongType())])


class RunStore:
    """Rows with a run's name in column ``run``, of one schema, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, run: str = "run_id"):
        self.spark, self.path, self.run = spark, path.rstrip("/"), run
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _marks(self) -> DataFrame:
        marks = f"{self.path}/_commits"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(marks)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _MARKS)
        return self.spark.read.schema(_MARKS).parquet(marks)

    def current(self) -> DataFrame:
        """(run, version) that readers see; of marks with one number the greatest version's."""
        return self._marks().groupBy("run").agg(F.max(F.struct("number", "version")).alias("last")).select("run", "last.version")

    def write(self, rows: DataFrame, commit: bool = True) -> str:
        """Writes every run in ``rows`` anew and returns the version; without ``commit`` nobody sees it yet."""
        version = uuid.uuid4().hex
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        shaped.hint("rebalance", F.col(self.run)).write.parquet(f"{self.path}/data/version={version}")
        if commit:
            self.commit(version)
        return version

    def commit(self, version: str) -> None:
        """Marks a written version as the last of its runs."""
        runs = self._version(version).select(F.col(self.run).alias("run")).distinct()
        number = self._marks().agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        runs.select("run", F.lit(version).alias("version"), F.lit(number).cast("long").alias("number")).write.mode("append").parquet(f"{self.path}/_commits")

    def _version(self, version: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/version={version}")

    def read(self) -> DataFrame:
        """The rows of every run's last version; folders of other versions are not read.

        There are as many versions as writes that still have a run, not as rows.
        """
        last = self.current()
        versions = [r["version"] for r in last.select("version").distinct().collect()]
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        whole = StructType([*self.schema.fields, StructField("version", StringType())])
        stored = self.spark.read.option("basePath", f"{self.path}/data").schema(whole).parquet(*[f"{self.path}/data/version={v}" for v in versions])
        seen = last.select(F.col("run").alias("_run"), F.col("version").alias("_version"))
        kept = stored.join(seen, F.col(self.run).eqNullSafe(F.col("_run")) & (F.col("version") == F.col("_version")), "left_semi")
        return kept.select(*self.schema.names)

    def clean(self) -> list[str]:
        """Deletes the versions that no run's last mark names; returns them. Not while another write is on its way."""
        kept = {r["version"] for r in self.current().select("version").distinct().collect()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        there = [s.getPath().getName().removeprefix("version=") for s in files.listStatus(root)] if files.exists(root) else []
        gone = sorted(v for v in there if v not in kept)
        for version in gone:
            delete_path(self.spark, f"{self.path}/data/version={version}")
        return gone
