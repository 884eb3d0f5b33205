"""Metrics by name, and the report over several of them.

A metric is a function from pairs (run_id, dataset and id or other keys,
prediction, reference) to (run_id, variant, value) per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistworks.operators.bertscore import BLOCK, bertscore_pairs, match
from gistworks.operators.joins import keys_of
from gistworks.operators.rouge import VARIANTS, rouge_scores
from gistworks.operators.sentences import sentence_lines
from gistworks.session import materialize

Metric = Callable[[DataFrame], DataFrame]
#: Called once per task; turns a batch of texts into one (tokens x dimensions) array each.
EncoderFactory = Callable[[], Callable[[list[str]], list[np.ndarray]]]


def _to_rows(scores: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Score columns to (run_id, variant, value) rows."""
    entries = [F.struct(F.lit(v).alias("variant"), F.col(c).alias("value")) for v, c in columns.items()]
    return scores.select("run_id", F.inline(F.array(*entries)))


def rouge_metric(variants: Sequence[str] = VARIANTS, use_stemmer: bool = True, abbreviations: DataFrame | None = None) -> Metric:
    """ROUGE of pairs; with a corpus' abbreviations summary-level LCS takes sentences, else lines, as its units."""

    def score(pairs: DataFrame) -> DataFrame:
        if abbreviations is not None:
            pairs = sentence_lines(pairs, abbreviations)
        scores = rouge_scores(pairs, ("run_id", *keys_of(pairs)), variants, use_stemmer)
        return _to_rows(scores, {v: f"{v}_f" for v in variants})

    return score


def bertscore_metric(vectors: DataFrame) -> DataFrame:
    """BERTScore over stored vectors: token rows with a run_id."""
    # A pair of another run is another pair.
    keyed = vectors.withColumn("pair_id", F.struct("run_id", "pair_id"))
    scores = bertscore_pairs(keyed).withColumn("run_id", F.col("pair_id.run_id"))
    return _to_rows(scores, {c: c for c in ("precision", "recall", "f")})


def encoded_bertscore(encoder: EncoderFactory, batch_size: int = 32, block: int = BLOCK) -> Metric:
    """BERTScore over texts: the encoder gives a text's vectors, a token a row.

    A pair is encoded and matched in the same pass, so no vector leaves its
    task. The distinct texts of ``batch_size`` pairs are encoded together, each
    once; a null text counts as empty. Vectors of that many pairs are held, and
    cosines of ``block`` by ``block`` tokens.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                sides = [[t or "" for t in part.column(c).to_pylist()] for c in ("prediction", "reference")]
                texts = list(dict.fromkeys(t for side in sides for t in side))
                vectors = dict(zip(texts, encode(texts), strict=True))
                found = [match(vectors[p], vectors[r], block) for p, r in zip(*sides)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("run_id"), *(pa.array(c, pa.float64()) for c in zip(*found))], ["run_id", "precision", "recall", "f"]
                )

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("run_id", "prediction", "reference")
        kind = rows.schema["run_id"].dataType.simpleString()
        return _to_rows(rows.mapInArrow(scored, f"run_id {kind}, precision double, recall double, f double"), {c: c for c in ("precision", "recall", "f")})

    return score


REGISTRY: dict[str, Metric] = {"rouge": rouge_metric(), "bertscore": bertscore_metric}


def register_metric(name: str, metric: Metric) -> None:
    REGISTRY[name] = metric


def load_metrics(names: Sequence[str]) -> dict[str, Metric]:
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; known: {', '.join(REGISTRY)}")
    return {n: REGISTRY[n] for n in names}


def python_metric(fn: Callable[[list[str], list[str]], list[float]], variant: str) -> Metric:
    """A metric from a plain function of predictions and references to one value per pair.

    It sees one Arrow batch at a time, never a whole run.
    """

    def batches(frames):
        for frame in frames:
            values = fn(frame["prediction"].tolist(), frame["reference"].tolist())
            yield pd.DataFrame({"run_id": frame["run_id"], "variant": variant, "value": values})

    def score(pairs: DataFrame) -> DataFrame:
        rows = pairs.select("run_id", "prediction", "reference")
        return rows.mapInPandas(batches, "run_id string, variant string, value double")

    return score


def multi_metric_report(metrics: dict[str, Metric], inputs: DataFrame | dict[str, DataFrame]) -> DataFrame:
    """(run_id, metric, variant, value): the mean of every metric over each run.

    ``inputs`` are the pairs that all metrics read, or the rows each one reads.
    Pairs that several metrics read are stored once, not made again for each;
    those that :func:`~gistworks.session.materialize` gave are as they are.
    """
    if isinstance(inputs, DataFrame) and len(metrics) > 1 and not hasattr(inputs, "stored_at"):
        inputs = materialize(inputs, "pairs")
    report = None
    for name, metric in metrics.items():
        means = metric(inputs[name] if isinstance(inputs, dict) else inputs).groupBy("run_id", "variant").agg(F.avg("value").alias("value"))
        part = means.select("run_id", F.lit(name).alias("metric"), "variant", "value")
        report = part if report is None else report.unionByName(part)
    if report is None:
        raise ValueError("no metric given")
    return report
