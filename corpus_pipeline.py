"""Cleaning a corpus for training: stages over ``documents``, each stored before the next.

Every stage takes (spark, docs, sf_dir) and works on whole texts of all rows
that its predecessor kept. Null and empty texts pass every filter (a null or
empty text is not toxic, shares no lines and holds no benchmark item), but
SimHash sees them as one group of equal fingerprints, of which one row stays.
Repeated rows are one group likewise. All stages but the last carry further
columns along, whatever their names; the last returns doc_id, n_tokens, ids and
the decoded text. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gistworks.llm import stages

#: Names and functions, in order: toxic documents go; lines shared with an
#: earlier document go; one document of each near-duplicate group stays;
#: documents with benchmark items go; the rest is encoded and decoded again.
STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_common_lines),
    ("SimHash near-dedup", stages.keep_one_of_each),
    ("benchmark decontamination", stages.drop_leaks),
    ("byte-level BPE", stages.encode),
]

#: A fitted classifier and iterative grouping: no SQL. Each operator is tested against a plain definition, the whole with planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's ``documents``, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stages.stored(docs)
    return docs
