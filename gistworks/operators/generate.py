"""Batch generation with a user-supplied predictor, and its repair after failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gistworks.operators.joins import keys_of
from gistworks.session import scratch_path

# A factory is called once per task and returns the function that turns a
# batch of texts into as many outputs; the model is loaded in between.
Predict = Callable[[list[str]], list[str]]
PredictorFactory = Callable[[], Predict]

ATTEMPT_COLUMNS = "attempt int, ok boolean, output string, error string"


def lead_predictor(gen_max_len: int) -> PredictorFactory:
    """A predictor that answers with the first ``gen_max_len`` words."""

    def make() -> Predict:
        return lambda texts: [" ".join(t.split(" ")[:gen_max_len]) for t in texts]

    return make


def _chunks(frame: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), size):
        yield frame.iloc[start : start + size]


def _answers(predict: Predict, texts: list[str]) -> list[str]:
    outputs = predict(texts)
    if len(outputs) != len(texts):
        raise ValueError(f"predictor returned {len(outputs)} outputs for {len(texts)} texts")
    return outputs


def _key_schema(df: DataFrame, keys: tuple[str, ...]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def generate_batched(
    df: DataFrame,
    predictor: PredictorFactory,
    text: str = "text",
    keys: Sequence[str] | None = None,
    batch_size: int = 32,
    returns: str = "string",
) -> DataFrame:
    """keys and prediction; an error of the predictor fails the job.

    The column may hold texts or token ids: whatever a row has goes to the
    predictor, whose outputs have the type ``returns``.
    """
    keys = tuple(keys_of(df, keys=keys))

    def run(frames):
        predict = predictor()
        for frame in frames:
            for chunk in _chunks(frame, batch_size):
                outputs = _answers(predict, chunk["source"].tolist())
                yield chunk[list(keys)].assign(prediction=outputs)

    rows = df.select(*keys, F.col(text).alias("source"))
    return rows.mapInPandas(run, f"{_key_schema(df, keys)}, prediction {returns}")


def generate_attempts(
    df: DataFrame,
    predictor: PredictorFactory,
    attempt: int,
    text: str = "text",
    keys: Sequence[str] | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """keys, attempt, ok, output, error: a failing row is recorded, not fatal.

    A batch that fails is tried again row by row, so that only the rows at
    fault are marked.
    """
    keys = tuple(keys_of(df, keys=keys))

    def single(predict: Predict, source: str) -> tuple[bool, str | None, str | None]:
        try:
            return True, _answers(predict, [source])[0], None
        except Exception as e:  # noqa: BLE001 - whatever a model raises is recorded
            return False, None, f"{type(e).__name__}: {e}"

    def run(frames):
        predict = predictor()
        for frame in frames:
            for chunk in _chunks(frame, batch_size):
                sources = chunk["source"].tolist()
                try:
                    rows = [(True, output, None) for output in _answers(predict, sources)]
                except Exception:  # noqa: BLE001 - narrowed down by single()
                    rows = [single(predict, s) for s in sources]
                ok, output, error = zip(*rows)
                yield chunk[list(keys)].assign(attempt=attempt, ok=ok, output=output, error=error)

    rows = df.select(*keys, F.col(text).alias("source"))
    return rows.mapInPandas(run, f"{_key_schema(df, keys)}, {ATTEMPT_COLUMNS}")


def failed_subset(df: DataFrame, attempts: DataFrame, attempt: int = 1, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows whose given attempt failed. Keys are made distinct before they move."""
    keys = keys_of(df, attempts, keys=keys)
    failed = attempts.where(~F.col("ok") & (F.col("attempt") == attempt)).select(*keys).distinct()
    return df.join(failed, keys, "left_semi")


def pending_subset(df: DataFrame, attempts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows that no attempt has answered yet."""
    keys = keys_of(df, attempts, keys=keys)
    done = attempts.where("ok").select(*keys).distinct()
    return df.join(done, keys, "left_anti")


def retry_merge(rows: DataFrame, attempts: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row per key: a successful attempt before a failed one, the latest first.

    Keys that were never tried stay with empty columns.
    """
    keys = keys_of(rows, attempts, keys=keys)
    best = attempts.groupBy(*keys).agg(
        F.max_by(F.struct("attempt", "ok", "output"), F.struct("ok", "attempt")).alias("best")
    )
    return rows.select(*keys).join(best, keys, "left").select(*keys, "best.*")


def read_attempts(spark: SparkSession, log_path: str, schema: T.StructType) -> DataFrame | None:
    """The attempts of an earlier run, if there are any at the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(log_path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(schema).parquet(log_path)


def generate_resumable(
    df: DataFrame,
    predictors: list[PredictorFactory],
    text: str = "text",
    keys: Sequence[str] | None = None,
    batch_size: int = 32,
    log_path: str | None = None,
) -> DataFrame:
    """Run the predictors in turn, each over the rows still without output.

    Every pass is appended to the log at ``log_path`` (a new scratch table if
    none is given) before the next starts: no answer is computed twice, and a
    lost executor costs at most its own share of the current pass. An earlier
    log at the path is read first, so that a job started again asks only what
    is still open, and its passes count on from the attempts made.
    """
    if not predictors:
        raise ValueError("no predictor given")
    spark = df.sparkSession
    keys = keys_of(df, keys=keys)
    path = log_path or scratch_path(spark, "attempts")
    schema = T.StructType([*(df.schema[k] for k in keys), *T.StructType.fromDDL(ATTEMPT_COLUMNS).fields])
    log = read_attempts(spark, path, schema)
    made = (log.agg(F.max("attempt")).first()[0] or 0) if log is not None else 0
    for attempt, predictor in enumerate(predictors, start=made + 1):
        todo = df if log is None else pending_subset(df, log, keys)
        generate_attempts(todo, predictor, attempt, text, tuple(keys), batch_size).write.mode("append").parquet(path)
        log = spark.read.schema(schema).parquet(path)
    return retry_merge(df, log, keys)
