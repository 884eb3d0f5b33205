"""The operators as stages of a pipeline: (spark, docs, folder) to the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gistworks.llm import bpe, decontaminate, lines, simhash, toxicity
from gistworks.llm.common import Stored
from gistworks.llm.queries import TOXIC, train_labels


def stored(docs: DataFrame) -> DataFrame:
    return Stored(docs, "stage").read()


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose score is below the threshold; the classifier learns from the folder's labels."""
    model = toxicity.fit(docs, train_labels(spark, folder))
    score = _free(docs, "score")
    return toxicity.with_score(docs, model, score).where(F.col(score) < TOXIC).drop(score)


def drop_common_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows; lines that a document shares with an earlier one are gone from its text."""
    return lines.dedup_lines(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest identifier."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that hold no item of the folder's benchmark."""
    leaks = _free(docs, "leaks")
    found = decontaminate.with_leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet"), leaks)
    return found.where(F.size(leaks) == 0).drop(leaks)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, text, the text's token ids and the text decoded from them."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, form="ids")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))
