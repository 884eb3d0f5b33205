"""Whole evaluations: from a corpus to scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from gistworks.functions.text import ANSWER_MARKER, chat_messages, extract_answer, prompt_prefix
from gistworks.functions.tokenizer import RUNS, Tokenizer
from gistworks.operators.admission import fits_context
from gistworks.operators.compare import align_pairs
from gistworks.operators.generate import PredictorFactory, generate_batched, generate_resumable
from gistworks.operators.joins import keys_of
from gistworks.operators.metrics import Metric, load_metrics, multi_metric_report
from gistworks.operators.rouge import VARIANTS, rouge_corpus
from gistworks.operators.vocab import causal_prompt_ids, decode_ids, encode_fixed
from gistworks.session import materialize
from gistworks.sources.corpus import Reader, get_split, load_corpus
from gistworks.sources.sinks import read_metrics, read_predictions, read_report, write_metrics, write_predictions, write_report


@dataclass(frozen=True)
class Scoring:
    """Which ROUGE values to compute and how."""

    variants: Sequence[str] = VARIANTS
    use_stemmer: bool = True

    def score(self, predictions: DataFrame, references: DataFrame) -> DataFrame:
        aligned = align_pairs(predictions, references)
        return rouge_corpus(aligned, self.variants, self.use_stemmer)


class Counts:
    """Rows counted while the jobs that need them run: no job of its own.

    ``admitted`` rows of the split, ``predicted`` outputs, ``unanswered`` among
    them (null), and ``matched`` pairs that were scored. Rows that a task
    repeats after a lost executor are counted by their last run only.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, **counts) -> DataFrame:
        """``df``, counted as it is written; each name once."""
        observation = Observation()
        self._seen |= dict.fromkeys(counts, observation)
        return df.observe(observation, *[c.alias(n) for n, c in counts.items()])

    def columns(self) -> list:
        """The counts as columns, once the watched frames have been written."""
        found = {n: int(o.get[n] or 0) for n, o in self._seen.items()}
        if {"predicted", "matched"} <= set(found):
            found["unmatched"] = found["predicted"] - found["matched"]
        return [F.lit(v).cast("long").alias(n) for n, v in found.items()]


def evaluate_run(
    corpus: DataFrame,
    run_id: str,
    predictor: PredictorFactory,
    vocab: DataFrame,
    enc_max_len: int,
    path: str,
    split: str = "test",
    batch_size: int = 32,
    scoring: Scoring = Scoring(),
) -> DataFrame:
    """Encode one split, generate, decode, store the predictions and score them.

    The stored predictions are what is scored and the stored scores what is
    returned, so nothing is computed twice. The scores come with what the run
    counted: admitted, predicted, unanswered, matched and unmatched rows.
    """
    spark, counts = corpus.sparkSession, Counts()
    rows = get_split(corpus, split)
    read = counts.watch(rows, admitted=F.count(F.lit(1)))
    inputs = decode_ids(encode_fixed(read, vocab, enc_max_len), vocab, "input_ids")
    predicted = _watched(generate_batched(inputs, predictor, batch_size=batch_size), counts)
    write_predictions(predicted.withColumn("run_id", F.lit(run_id)), f"{path}/predictions")
    stored = read_predictions(spark, f"{path}/predictions", by_dataset=True)
    pairs = materialize(counts.watch(align_pairs(stored, rows), matched=F.count(F.lit(1))), "pairs")
    scores = rouge_corpus(pairs, scoring.variants, scoring.use_stemmer)
    absent = [F.lit(None).cast("double").alias(v) for v in VARIANTS if v not in scoring.variants]
    write_metrics(scores.select(F.col("run_id").alias("folder"), "*", *absent), f"{path}/metrics")
    return read_metrics(spark, f"{path}/metrics").withColumnRenamed("folder", "run_id").select("*", *counts.columns())


def _watched(predicted: DataFrame, counts: Counts) -> DataFrame:
    return counts.watch(predicted, predicted=F.count(F.lit(1)), unanswered=F.count_if(F.col("prediction").isNull()))


@dataclass(frozen=True)
class Model:
    """What a configuration names: a predictor for (gen_max_len, num_beams), and its vocabulary or a tokenizer with ids.

    With ``over_ids`` the predictor turns lists of ids into lists of ids, which
    are decoded after; otherwise it turns decoded inputs, or plain texts where
    there is no vocabulary, into texts.
    """

    predictor: Callable[[int, int], PredictorFactory]
    vocab: DataFrame | None = None
    over_ids: bool = False
    tokenizer: Tokenizer = RUNS


_ARGS = ("model", "dataset", "metrics", "preview", "samples", "min_input_size")


def run_config(config: dict, reader: Reader, models: dict[str, Model], path: str, metrics: dict[str, Metric] | None = None, split: str = "test") -> DataFrame:
    """One evaluation as its configuration says: (run_id, metric, variant, value).

    ``config`` has ``method`` ("eval"), ``exec_args`` (model, dataset, metrics,
    preview, samples, min_input_size) and ``exec_kwargs`` (enc_max_len,
    gen_max_len, num_beams, batch_size). ``metrics`` adds to the registered
    ones. All metrics read the same stored pairs; scores are stored nested by
    metric and read back, with what the run counted: admitted, predicted,
    unanswered, matched and unmatched rows.
    """
    if config.get("method") != "eval":
        raise ValueError("only the method 'eval' can be run")
    args, kwargs = config.get("exec_args", {}), config.get("exec_kwargs", {})
    missing = [k for k in _ARGS if k not in args]
    if missing:
        raise ValueError(f"the configuration lacks {missing}")
    if args["model"] not in models:
        raise ValueError(f"unknown model {args['model']!r}; known: {', '.join(models)}")
    own = metrics or {}
    chosen = {n: own[n] if n in own else load_metrics([n])[n] for n in args["metrics"]}
    model = models[args["model"]]
    width, budget = kwargs.get("enc_max_len", 4096), kwargs.get("gen_max_len", 256)
    corpus = load_corpus(
        args["dataset"], reader, preview=bool(args["preview"]), samples=args["samples"], min_input_size=args["min_input_size"]
    )
    rows = get_split(corpus, split)
    predictor = model.predictor(budget, kwargs.get("num_beams", 1))
    batch, counts = kwargs.get("batch_size", 32), Counts()
    inputs = counts.watch(rows, admitted=F.count(F.lit(1)))
    coded = model.vocab is not None or model.tokenizer.ids is not None
    if coded:
        inputs = encode_fixed(inputs, model.vocab, width, tokenizer=model.tokenizer)
    if model.over_ids:
        ids = generate_batched(inputs, predictor, "input_ids", batch_size=batch, returns="array<int>")
        predicted = decode_ids(ids, model.vocab, "prediction", tokenizer=model.tokenizer).withColumnRenamed("text", "prediction")
    else:
        if coded:
            inputs = decode_ids(inputs, model.vocab, "input_ids", tokenizer=model.tokenizer)
        predicted = generate_batched(inputs, predictor, batch_size=batch)
    run_id = f"{args['model']}-{args['dataset']}-{width}"
    write_predictions(_watched(predicted, counts).withColumn("run_id", F.lit(run_id)), f"{path}/predictions")
    stored = read_predictions(rows.sparkSession, f"{path}/predictions", by_dataset=True)
    pairs = materialize(counts.watch(align_pairs(stored, rows), matched=F.count(F.lit(1))), "pairs")
    write_report(multi_metric_report(chosen, pairs), f"{path}/scores")
    return read_report(rows.sparkSession, f"{path}/scores").select("*", *counts.columns())


def causal_run(
    corpus: DataFrame,
    run_id: str,
    predictor: PredictorFactory,
    vocab: DataFrame,
    max_length: int,
    max_new_tokens: int,
    context: int,
    shots: int | None = None,
    split: str = "test",
    scoring: Scoring = Scoring(),
) -> DataFrame:
    """Prompt, keep what fits the context, encode with a reserved answer marker,
    generate a continuation, take the answer after the marker, score.

    The predictor gets the prompt and returns prompt and answer, as a causal
    model does.
    """
    rows = get_split(corpus, split)
    kept = fits_context(rows, context, shots, text=prompt_prefix(F.col("text")))
    ids = causal_prompt_ids(kept, vocab, max_length, max_new_tokens)
    prompts = decode_ids(ids, vocab, "input_ids").withColumn(
        "text", F.concat("text", F.lit(f" {ANSWER_MARKER}"))
    )
    outputs = generate_batched(prompts, predictor)
    answers = outputs.withColumn("run_id", F.lit(run_id)).withColumn("prediction", extract_answer(F.col("prediction")))
    return scoring.score(materialize(answers, "answers"), rows)


def chat_run(
    corpus: DataFrame,
    run_id: str,
    predictors: list[PredictorFactory],
    budget: int,
    split: str = "test",
    scoring: Scoring = Scoring(),
    tokenizer: Tokenizer = RUNS,
    log_path: str | None = None,
) -> DataFrame:
    """Cut each text to a chat budget, ask once per row, ask again where that
    failed, score what was answered.

    The mean is over answered rows; ``scored`` and ``unanswered`` say how many
    those were and how many have no answer.
    """
    rows = get_split(corpus, split)
    asked = rows.select(*keys_of(rows), chat_messages(F.col("text"), budget, tokenizer)[0]["content"].alias("text"))
    merged = generate_resumable(asked, predictors, log_path=log_path)
    answers = merged.where("ok").withColumn("run_id", F.lit(run_id)).withColumnRenamed("output", "prediction")
    counts = merged.agg(F.struct(F.count_if("ok").alias("ok"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("open")))
    scored = scoring.score(answers, rows).withColumn("n", counts.scalar())
    return scored.select("*", F.col("n.ok").alias("scored"), F.col("n.open").alias("unanswered")).drop("n")


def lead_answer(budget: int) -> PredictorFactory:
    """A causal stand-in: repeats the prompt and answers with its first words."""

    def make():
        def predict(texts: list[str]) -> list[str]:
            return [f"{t} {' '.join(t.split(' ')[:budget])}" for t in texts]

        return predict

    return make
