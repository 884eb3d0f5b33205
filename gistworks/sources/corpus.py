"""The four summarization corpora as one schema: id, dataset, split, text, summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistworks.operators.admission import admit
from gistworks.operators.selection import preview_head, train_cap

SPLITS = ("train", "validation", "test")
COLUMNS = ("id", "dataset", "split", "text", "summary")


@dataclass(frozen=True)
class CorpusSpec:
    """Where a corpus lies and how its columns map to ``text`` and ``summary``."""

    name: str
    subset: str = "document"
    columns: dict[str, str] = field(default_factory=dict)


# The source column names of each corpus.
REGISTRY = {
    "arxiv": CorpusSpec("arxiv", columns={"article": "text", "abstract": "summary"}),
    "pubmed": CorpusSpec("pubmed", columns={"article": "text", "abstract": "summary"}),
    "govreport": CorpusSpec("govreport", columns={"report": "text"}),
    "bigpatent": CorpusSpec("bigpatent", subset="all", columns={"description": "text", "abstract": "summary"}),
}

Reader = Callable[[CorpusSpec], DataFrame]


def corpus_spec(name: str) -> CorpusSpec:
    if name not in REGISTRY:
        raise ValueError(f"unknown corpus {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def parquet_reader(spark: SparkSession, root: str) -> Reader:
    """Reads ``root/<corpus>/<subset>/split=<split>/*.parquet``."""

    def read(spec: CorpusSpec) -> DataFrame:
        return spark.read.parquet(f"{root}/{spec.name}/{spec.subset}")

    return read


def standardize(df: DataFrame, spec: CorpusSpec) -> DataFrame:
    """Rename the source columns and label the corpus; fails on a missing column."""
    wanted = {*spec.columns, "id", "split", *({"text", "summary"} - set(spec.columns.values()))}
    missing = sorted(wanted - set(df.columns))
    if missing:
        raise ValueError(f"corpus {spec.name!r} lacks columns {missing}")
    renamed = df.withColumnsRenamed(spec.columns).withColumn("dataset", F.lit(spec.name))
    return renamed.select(*COLUMNS)


def union_corpora(reader: Reader, names: tuple[str, ...] = tuple(REGISTRY)) -> DataFrame:
    frames = [standardize(reader(corpus_spec(n)), corpus_spec(n)) for n in names]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def get_split(corpus: DataFrame, key: str) -> DataFrame:
    return corpus.filter(F.col("split") == key)


def load_corpus(
    name: str,
    reader: Reader,
    preview: bool = False,
    preview_size: int = 4,
    samples: int | str = "max",
    min_input_size: int = 0,
    preprocess: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Load one corpus, limit its rows, then filter.

    A preview keeps the first rows of each split and wins over ``samples``.
    ``preprocess`` takes the place of the admission filter.
    """
    spec = corpus_spec(name)
    corpus = standardize(reader(spec), spec)
    if preview:
        corpus = preview_head(corpus, preview_size)
    else:
        corpus = train_cap(corpus, samples)
    if preprocess is None:
        return admit(corpus, min_input_size)
    return corpus.transform(preprocess)


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Store pairs partitioned by corpus and split, large splits over many files."""
    (
        corpus.hint("rebalance", F.col("dataset"), F.col("split"))
        .write.partitionBy("dataset", "split")
        .parquet(path)
    )
