"""Corpora as a Spark data source: ``spark.read.format("corpus")``.

For corpora that Spark's own readers cannot take as they are. A corpus lies under
``<path>/<corpus>/<subset>/split=<split>/*.parquet``, in its own column names; the
source gives them in one schema. There is a partition for every file; of a file
only the columns a corpus needs are read, batch by batch.

Options: ``path`` (any file system that pyarrow knows, by URI), ``dataset`` (one
corpus or several, by commas; all if left out), ``split`` (likewise), and
``batch`` (rows held at once). Files of other corpora and splits are not opened.
Filters are Spark's: what a Python source takes upon itself stays with the frame
and would wrongly hold for the next query on it. Register the source once:
``register(spark)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gistworks.sources.corpus import REGISTRY, SPLITS, CorpusSpec, corpus_spec

SCHEMA = "id LONG, dataset STRING, split STRING, text STRING, summary STRING"


class CorpusFile(InputPartition):
    """One file of a corpus' split."""

    def __init__(self, spec: CorpusSpec, split: str, path: str):
        super().__init__((spec.name, split, path))
        self.spec, self.split, self.path = spec, split, path


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path is needed")
        self.path, self.batch = options["path"].rstrip("/"), int(options.get("batch", 2000))
        self.allowed = {
            "dataset": {s.strip() for s in options.get("dataset", ",".join(REGISTRY)).split(",")},
            "split": {s.strip() for s in options.get("split", ",".join(SPLITS)).split(",")},
        }
        for name in self.allowed["dataset"]:
            corpus_spec(name)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        out = []
        for name in sorted(self.allowed["dataset"]):
            spec = REGISTRY[name]
            for split in sorted(self.allowed["split"]):
                at = fs.FileSelector(f"{root}/{spec.name}/{spec.subset}/split={split}", allow_not_found=True)
                out += [CorpusFile(spec, split, f.path) for f in files.get_file_info(at) if f.path.endswith(".parquet")]
        return out

    def read(self, partition: CorpusFile | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if partition is None:  # no file at all
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        theirs = {ours: name for name, ours in partition.spec.columns.items()}
        columns = [theirs.get(c, c) for c in ("id", "text", "summary")]
        with files.open_input_file(partition.path) as source:
            stored = pq.ParquetFile(source)
            missing = sorted(set(columns) - set(stored.schema_arrow.names))
            if missing:
                raise ValueError(f"corpus {partition.spec.name!r} lacks columns {missing}")
            for batch in stored.iter_batches(self.batch, columns=columns):
                ids, texts, summaries = (batch.column(c) for c in columns)
                own = [pa.array([x] * len(batch), pa.string()) for x in (partition.spec.name, partition.split)]
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(pa.int64()), *own, texts.cast(pa.string()), summaries.cast(pa.string())], ["id", "dataset", "split", "text", "summary"]
                )


class CorpusSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(CorpusSource)
