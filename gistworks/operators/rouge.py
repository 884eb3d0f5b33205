"""ROUGE of prediction and reference pairs (Lin 2004).

Every row is scored by itself, repeated keys too. N-grams are matched inside their
row, many rows at once in an Arrow pass; rows are dealt evenly over tasks before,
by key and number. Stems and subsequences are measured row by row in one Arrow
pass, which then counts the n-grams too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gistworks.functions.batches import parts
from gistworks.functions.grams import matches
from gistworks.functions.kernels import lcs_length, summary_lcs_hits
from gistworks.functions.porter import stem_token
from gistworks.functions.tokenizer import TOKEN_PATTERN
from gistworks.operators.joins import keys_of
from gistworks.operators.resample import bootstrap_intervals
from gistworks.session import ship_package

VARIANTS = ("rouge1", "rouge2", "rougeL", "rougeLsum")
_NGRAM = {"rouge1": 1, "rouge2": 2}


def _clipped(prediction: list[str], reference: list[str], n: int) -> int:
    """N-grams in common, each counted as often as in the side with fewer."""
    grams = [Counter(zip(*(side[k:] for k in range(n)))) for side in (prediction, reference)]
    return (grams[0] & grams[1]).total()


def _measure(stem: bool, variants: Sequence[str]):
    """One Arrow pass for all measures of a pair that needs stems or sequences."""

    token = re.compile(TOKEN_PATTERN)
    of_sides = {
        "rouge1": lambda p, r: _clipped(p, r, 1),
        "rouge2": lambda p, r: _clipped(p, r, 2),
        "rougeL": lcs_length,
    }

    def lines(text: str) -> list[list[str]]:
        split = [token.findall(line) for line in text.split("\n")]
        if stem:
            split = [[stem_token(t) for t in line] for line in split]
        return [line for line in split if line]

    def flat(sentences: list[list[str]]) -> list[str]:
        return [t for s in sentences for t in s]

    def one(prediction: str | None, reference: str | None) -> tuple:
        p, r = lines(prediction or ""), lines(reference or "")
        fp, fr = flat(p), flat(r)
        hits = [summary_lcs_hits(r, p) if v == "rougeLsum" else of_sides[v](fp, fr) for v in variants]
        return len(fp), len(fr), *hits

    names = ["pred_tokens", "ref_tokens", *variants]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def measure(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(p, r) for p, r in zip(prediction, reference)], columns=names)

    return measure


def rouge_counts(
    pairs: DataFrame,
    keys: Sequence[str] = ("id",),
    variants: Sequence[str] = VARIANTS,
    use_stemmer: bool = True,
) -> DataFrame:
    """keys, pred_tokens, ref_tokens and the matches of each variant."""
    unknown = set(variants) - set(VARIANTS)
    if unknown:
        raise ValueError(f"unknown variants {sorted(unknown)}")
    if use_stemmer or set(variants) - set(_NGRAM):
        # Texts pass through Python anyway, so nothing is shuffled after.
        measure = _measure(use_stemmer, tuple(variants))
        found = pairs.select(*keys, measure(F.lower("prediction"), F.lower("reference")).alias("m"))
        return found.select(*keys, "m.*")

    # Keys travel as one column, with the row's number, as keys may repeat: equal
    # ones do not land in one task.
    ship_package(pairs.sparkSession)
    key = F.struct(*keys, F.monotonically_increasing_id().alias("_row"))
    rows = pairs.select(key.alias("key"), "prediction", "reference").repartition("key")
    counted = rows.select("key", _count_grams(tuple(variants))(F.lower("prediction"), F.lower("reference")).alias("m"))
    return counted.select(*[F.col(f"key.{k}").alias(k) for k in keys], "m.*")


def _count_grams(variants: Sequence[str]):
    """One Arrow pass for the n-grams of a pair: no n-gram leaves its row."""
    sizes = [_NGRAM[v] for v in variants]
    names = ["pred_tokens", "ref_tokens", *variants]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sides in batches:
            for part in parts(pa.RecordBatch.from_arrays(list(sides), ["prediction", "reference"])):
                yield pa.StructArray.from_arrays([pa.array(c) for c in matches(*part.columns, sizes)], names)

    return count


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def prf(variant: str) -> dict[str, Column]:
    """Precision, recall and F of a variant from the columns of :func:`rouge_counts`."""
    hits, n_pred, n_ref = F.col(variant), F.col("pred_tokens"), F.col("ref_tokens")
    if variant == "rouge2":
        n_pred, n_ref = F.greatest(n_pred - 1, F.lit(0)), F.greatest(n_ref - 1, F.lit(0))
    return {
        "precision": _ratio(hits, n_pred),
        "recall": _ratio(hits, n_ref),
        "f": _ratio(2 * hits, n_pred + n_ref),
    }


def rouge_scores(
    pairs: DataFrame,
    keys: Sequence[str] = ("id",),
    variants: Sequence[str] = VARIANTS,
    use_stemmer: bool = True,
) -> DataFrame:
    """keys and ``<variant>_precision``, ``_recall``, ``_f`` per pair."""
    counts = rouge_counts(pairs, keys, variants, use_stemmer)
    scores = [c.alias(f"{v}_{name}") for v in variants for name, c in prf(v).items()]
    return counts.select(*keys, *scores)


def rouge_corpus(
    pairs: DataFrame,
    variants: Sequence[str] = VARIANTS,
    use_stemmer: bool = True,
    run: str = "run_id",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One F value per run and variant: the mean over the run's pairs."""
    scores = rouge_scores(pairs, (run, *keys_of(pairs, keys=keys)), variants, use_stemmer)
    return scores.groupBy(run).agg(*[F.avg(f"{v}_f").alias(v) for v in variants])


def rouge_interval(
    pairs: DataFrame,
    variants: Sequence[str] = VARIANTS,
    use_stemmer: bool = True,
    run: str = "run_id",
    keys: Sequence[str] | None = None,
    resamples: int = 1000,
    level: float = 0.95,
    seed: str = "bootstrap",
) -> DataFrame:
    """(run, variant, low, mean, high, resamples): the run's mean F and its bootstrap interval, from one pass over the texts."""
    keys = keys_of(pairs, keys=keys)
    scores = rouge_scores(pairs, (run, *keys), variants, use_stemmer)
    values = scores.select(run, *keys, *[F.col(f"{v}_f").alias(v) for v in variants])
    return bootstrap_intervals(values, variants, run, keys, resamples, level, seed)
