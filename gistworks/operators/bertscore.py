"""BERTScore (Zhang et al. 2020), without idf or rescaling: over stored token vectors, or over two arrays.

Stored vectors are rows: pair_id, side (0 prediction, 1 reference), pos, v. The
position is unique inside a side, so cutting it into blocks bounds a block by
the block size however long a text is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

PREDICTION, REFERENCE = 0, 1
BLOCK = 256


def _unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    rows = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0.0, 1.0, norms)


def match(prediction: np.ndarray, reference: np.ndarray, block: int = BLOCK) -> tuple[float, float, float]:
    """(precision, recall, f) of two (tokens x dimensions) arrays; a side without tokens scores 0.

    Cosines are made ``block`` by ``block`` tokens at a time, so that a pair of
    long texts holds no more of them at once.
    """
    n, m = len(prediction), len(reference)
    if not n or not m:
        return 0.0, 0.0, 0.0
    p, r = (_unit_rows(x, np.shape(x)[1]) for x in (prediction, reference))
    best_p, best_r = np.full(n, -np.inf), np.full(m, -np.inf)
    for a in range(0, n, block):
        for b in range(0, m, block):
            cosines = p[a : a + block] @ r[b : b + block].T
            np.maximum(best_p[a : a + block], cosines.max(axis=1), out=best_p[a : a + block])
            np.maximum(best_r[b : b + block], cosines.max(axis=0), out=best_r[b : b + block])
    precision, recall = float(best_p.mean()), float(best_r.mean())
    both = precision + recall
    return precision, recall, 2 * precision * recall / both if both else 0.0


_MAXIMA = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("p", "r")]
)


@F.pandas_udf(_MAXIMA)
def _block_maxima(dim: pd.Series, prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """The best cosine of each token against the other block."""
    best_p, best_r = [], []
    for d, p, r in zip(dim, prediction, reference):
        cosines = _unit_rows(p, d) @ _unit_rows(r, d).T
        best_p.append(cosines.max(axis=1))
        best_r.append(cosines.max(axis=0))
    return pd.DataFrame({"p": best_p, "r": best_r})


def _blocks(vectors: DataFrame, side: int, size: int) -> DataFrame:
    """One row per block of at most ``size`` tokens, vectors laid end to end."""
    placed = vectors.where(F.col("side") == side).select(
        "pair_id", F.expr(f"pos div {size}").alias("block"), F.struct("pos", "v").alias("token")
    )
    tokens = F.array_sort(F.collect_list("token"))
    blocks = placed.groupBy("pair_id", "block").agg(tokens.alias("tokens"))
    return blocks.select(
        "pair_id",
        F.col("block").alias(f"block{side}"),
        F.size(F.col("tokens")[0]["v"]).alias(f"dim{side}"),
        F.flatten(F.transform("tokens", lambda t: t["v"])).alias(f"flat{side}"),
    )


def bertscore_pairs(vectors: DataFrame, block: int = BLOCK, pairs: DataFrame | None = None) -> DataFrame:
    """(pair_id, precision, recall, f) by greedy matching; a side without tokens scores 0.

    Blocks are joined, not tokens: an ordinary pair is one row with two small
    matrices. A pair of very long texts becomes many block rows, which skew
    handling can split; each returns one maximum per token. ``pairs`` lists
    pair_ids that must appear even if no side has a token.
    """
    joined = _blocks(vectors, PREDICTION, block).join(_blocks(vectors, REFERENCE, block), "pair_id")
    best = joined.select(
        "pair_id", "block0", "block1", _block_maxima("dim0", "flat0", "flat1").alias("best")
    )
    sides = F.array(
        F.struct(F.lit(PREDICTION).alias("side"), F.col("block0").alias("block"), F.col("best.p").alias("best")),
        F.struct(F.lit(REFERENCE).alias("side"), F.col("block1").alias("block"), F.col("best.r").alias("best")),
    )
    per_token = (
        best.select("pair_id", F.inline(sides))
        .select("pair_id", "side", "block", F.posexplode("best").alias("nth", "cosine"))
        .groupBy("pair_id", "side", "block", "nth")
        .agg(F.max("cosine").alias("cosine"))
    )
    means = per_token.groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == PREDICTION, F.col("cosine"))).alias("precision"),
        F.avg(F.when(F.col("side") == REFERENCE, F.col("cosine"))).alias("recall"),
    )
    known = vectors.select("pair_id").distinct()
    if pairs is not None:
        known = known.unionByName(pairs.select("pair_id")).distinct()
    scored = known.join(means, "pair_id", "left").fillna(0.0, ["precision", "recall"])
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def bertscore_corpus(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """Mean precision, recall and f per run."""
    return scores.groupBy(run).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f")])
