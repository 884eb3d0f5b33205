"""One registered query per operator, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistworks.functions import runkeys, text as tx, tokenizer
from gistworks.operators import (
    admission, bertscore, compare, generate, hooks, leaderboard, lengths, metrics, positions, rouge, selection, sentences, vocab,
)
from gistworks.plans import evaluate
from gistworks.plans.views import Views
from gistworks.session import scratch_path, ship_package
from gistworks.sources import corpus, datasource, predlog, runs, sinks, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# Parameters shared with the SQL of the same queries.
VOCAB_SIZE = 8000
ENC_MAX_LEN = 512
GEN_MAX_LEN = 64
NGRAMS = ("rouge1", "rouge2")
SEED = "bootstrap"
UNSTEMMED = ("rouge1", "rouge2", "rougeL")


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    """Register ``fn`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return fn(Views(spark, folder))

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six places for comparison."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


def _joined(column: str) -> Column:
    return F.array_join(F.col(column), " ").alias(column)


def _vocab(v: Views) -> DataFrame:
    return vocab.build_vocab(v.pairs(), size=VOCAB_SIZE)


def _aligned(v: Views) -> DataFrame:
    return compare.align_pairs(v.run_predictions(), v.references())


# --- sources ---------------------------------------------------------------


@query
def corpus_load(v: Views) -> DataFrame:
    return corpus.load_corpus("arxiv", v.raw_reader())


@query
def corpus_rename(v: Views) -> DataFrame:
    return corpus.union_corpora(v.raw_reader())


@query
def corpus_split(v: Views) -> DataFrame:
    return corpus.get_split(corpus.union_corpora(v.raw_reader()), "test")


@query
def corpus_source(v: Views) -> DataFrame:
    """Two corpora stored under their own names, one split of them read through the data source."""
    root = scratch_path(v.spark, "corpora")
    for name in ("arxiv", "govreport"):
        spec = corpus.corpus_spec(name)
        v.raw_reader()(spec).write.partitionBy("split").parquet(f"{root}/{spec.name}/{spec.subset}")
    datasource.register(v.spark)
    at = root if ":/" in root else f"file://{root}"
    return v.spark.read.format("corpus").options(path=at, dataset="arxiv, govreport", split="test").load()


@query
def runs_scan(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "runs")
    runs.write_folders(v.run_scores().withColumnRenamed("json", "content"), root)
    return runs.scan_runs(v.spark, root, "part-*")


def _stored_logs(v: Views) -> DataFrame:
    root = scratch_path(v.spark, "logs")
    runs.write_folders(v.pred_logs(), root)
    return predlog.scan_logs(v.spark, root, "*/part-*")


@query
def predlog_scan(v: Views) -> DataFrame:
    return _stored_logs(v)


@query
def predlog_route(v: Views) -> DataFrame:
    return predlog.logs_by_corpus(_stored_logs(v))


# --- sinks -----------------------------------------------------------------


@query
def sink_predictions(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "predictions")
    sinks.write_predictions(v.run_predictions(), path)
    return sinks.read_predictions(v.spark, path)


@query
def sink_metrics(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "metrics")
    sinks.write_metrics(runs.parse_scores(v.run_scores()), path)
    return sinks.read_metrics(v.spark, path)


@query
def sink_leaderboard(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "leaderboard")
    sinks.write_leaderboard(leaderboard.leaderboard(runs.parse_scores(v.run_scores())), path)
    board = sinks.read_leaderboard(v.spark, path)
    return board.select("Folder", *[_r6(c) for c in ("RougeAvg", "Rouge1", "Rouge2", "RougeL")])


@query
def sink_rewrite(v: Views) -> DataFrame:
    """One model's runs are written twice more, at last with other rows; another write is never committed."""
    kept = store.RunStore(v.spark, scratch_path(v.spark, "store"), sinks.PREDICTION_SCHEMA)
    runs_ = v.run_predictions()
    kept.write(runs_)
    again = runs_.where(F.col("run_id").startswith("echo-"))
    kept.write(again)
    kept.write(again.where("id % 3 = 0").withColumn("prediction", F.concat(F.lit("again "), "prediction")))
    kept.write(runs_.where(F.col("run_id").startswith("skip-")).limit(1), commit=False)
    kept.clean()
    return kept.read()


# --- projections -----------------------------------------------------------


@query
def prompt_prefix(v: Views) -> DataFrame:
    return v.pairs().select("id", tx.prompt_prefix(F.col("text")).alias("text"), "summary")


@query
def chat_messages(v: Views) -> DataFrame:
    asked = v.pairs().select("id", tx.chat_messages(F.col("text")).alias("messages"))
    return asked.select("id", F.inline("messages"))


@query
def token_budget_truncate(v: Views) -> DataFrame:
    return v.pairs().select("id", tx.truncate_tokens(F.col("text"), tx.CHAT_BUDGET).alias("text"))


@query
def suffix_reserve(v: Views) -> DataFrame:
    ids = tx.reserve_suffix(F.split("text", " "), F.array(F.lit("SUMMARY"), F.lit(":")))
    return v.pairs().select("id", F.array_join(ids, " ").alias("ids"))


@query
def answer_extract(v: Views) -> DataFrame:
    key = F.col("id")
    opened = F.when(key % 7 == 0, " ").otherwise(" SUMMARY:\n ")
    tail = F.when(key % 3 == 0, " \nSUMMARY: again").otherwise("\t\n")
    output = F.concat("text", opened, "prediction", tail)
    return v.pairs().select("id", tx.extract_answer(output).alias("answer"))


@query
def clip_preview(v: Views) -> DataFrame:
    return tx.clip_strings(v.pairs())


def _event_keys(v: Views) -> DataFrame:
    names = F.array(*[F.lit(c) for c in runkeys.CORPORA])
    return v.table("events").select(
        "event_id",
        F.concat(F.lit("model-"), "event_type").alias("model"),
        F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("dataset"),
        (1024 * (F.col("event_id") % 8 + 1)).alias("enc_max_len"),
        "ts",
    )


@query
def run_key(v: Views) -> DataFrame:
    model, dataset, width = F.col("model"), F.col("dataset"), F.col("enc_max_len")
    key = runkeys.run_key(model, dataset, width)
    return _event_keys(v).select(
        "event_id",
        key.alias("run_key"),
        runkeys.hub_key(model, width, dataset).alias("hub_key"),
        runkeys.run_folder(key, F.col("ts")).alias("folder"),
    )


@query
def run_key_parse(v: Views) -> DataFrame:
    # Names are counted first, so each is taken apart once.
    named = v.run_predictions().groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    path = F.concat("run_id", F.lit("/checkpoint-1600"))
    return named.withColumn("folder", runkeys.strip_checkpoint(path)).select(
        "folder", "n", *[c.alias(n) for n, c in runkeys.parse_folder(F.col("folder")).items()]
    )


@query
def token_count(v: Views) -> DataFrame:
    return lengths.token_lengths(v.pairs())


# --- filters and row limits ------------------------------------------------


@query
def preview_head(v: Views) -> DataFrame:
    return selection.preview_head(v.pairs())


@query
def train_cap(v: Views) -> DataFrame:
    return selection.train_cap(v.pairs(), 100)


@query
def admission_filter(v: Views) -> DataFrame:
    return admission.admit(v.pairs()).select(*corpus.COLUMNS)


@query
def context_window_filter(v: Views) -> DataFrame:
    prompt = tx.prompt_prefix(F.col("text"))
    return admission.fits_context(v.pairs(), context=1024, shots=3, text=prompt).select("id", prompt.alias("text"), "summary")


def _prompt_lengths(v: Views) -> DataFrame:
    prompted = v.pairs().withColumn("num_tok", tx.token_count(tx.prompt_prefix(F.col("text"))))
    return prompted.select("id", "num_tok")


@query
def length_cutoff(v: Views) -> DataFrame:
    return lengths.length_cutoff(_prompt_lengths(v))


@query
def failed_subset(v: Views) -> DataFrame:
    return generate.failed_subset(v.pairs(), v.attempts()).select("id", "text")


@query
def pending_subset(v: Views) -> DataFrame:
    return generate.pending_subset(v.pairs(), v.attempts()).select("id", "text")


@query
def sample_one(v: Views) -> DataFrame:
    return selection.sample_one(v.pairs().select("dataset", "id", "text", "summary"), seed="reading")


# --- joins -----------------------------------------------------------------


@query
def align_pairs(v: Views) -> DataFrame:
    return _aligned(v)


@query
def align_corpora(v: Views) -> DataFrame:
    """Predictions of corpora that share ids."""
    predictions = v.corpora().select(F.lit("run").alias("run_id"), "dataset", "id", "prediction")
    return compare.align_pairs(predictions, v.corpora())


@query
def align_report(v: Views) -> DataFrame:
    answered = v.run_predictions().where(F.col("run_id").startswith("skip-"))
    admitted = admission.admit(v.pairs())
    return compare.align_report(answered, admitted)


def _numbered_outputs(v: Views) -> DataFrame:
    """Every run's predictions in the order of ids, without the ids."""
    known = v.run_predictions().join(v.pairs().select("id", "dataset"), "id")
    return positions.number_rows(known, ["run_id", "dataset"], ["id"]).drop("id")


@query
def align_positions(v: Views) -> DataFrame:
    pairs, _ = positions.align_positions(_numbered_outputs(v), v.pairs())
    return pairs


@query
def position_report(v: Views) -> DataFrame:
    return positions.position_report(_numbered_outputs(v), v.pairs())


@query
def retry_merge(v: Views) -> DataFrame:
    return generate.retry_merge(v.pairs(), v.attempts())


@query
def side_by_side(v: Views) -> DataFrame:
    parsed = runkeys.parse_folder(F.col("run_id"))
    predictions = v.run_predictions().select(parsed["model"].alias("model"), "id", "prediction")
    pairs = v.pairs().select("id", "dataset", "text", "summary")
    return compare.side_by_side(pairs, predictions, ["lead-3.5-turbo", "skip", "echo"])


# --- aggregations ----------------------------------------------------------


@query
def admission_audit(v: Views) -> DataFrame:
    return admission.admission_audit(v.pairs(), min_input_size=100)


@query
def length_histogram(v: Views) -> DataFrame:
    return lengths.length_histogram(_prompt_lengths(v))


@query
def length_summary(v: Views) -> DataFrame:
    return lengths.length_summary(_prompt_lengths(v))


@query
def length_summary_by_corpus(v: Views) -> DataFrame:
    return lengths.length_summary(lengths.token_lengths(v.corpora()), "text_tokens", by=("dataset", "split"))


@query
def length_top_by_corpus(v: Views) -> DataFrame:
    return lengths.length_top(lengths.token_lengths(v.corpora()), "summary_tokens", by=("dataset",))


@query
def length_top(v: Views) -> DataFrame:
    return lengths.length_top(_prompt_lengths(v))


@query
def length_by_side(v: Views) -> DataFrame:
    return lengths.length_by_side(v.pairs())


@query
def rouge_avg(v: Views) -> DataFrame:
    board = leaderboard.rouge_avg(runs.parse_scores(v.run_scores()))
    return board.select("Folder", _r6("RougeAvg"))


@query
def rouge_geo_mean(v: Views) -> DataFrame:
    board = leaderboard.rouge_avg(runs.parse_scores(v.run_scores()))
    scaled = leaderboard.rouge_geo_mean(board)
    return scaled.select("Folder", *[_r6(c) for c in ("geo_mean", "Rouge1", "Rouge2", "RougeL")])


@query
def leaderboard_table(v: Views) -> DataFrame:
    board = leaderboard.leaderboard(runs.parse_scores(v.run_scores()))
    return board.select("Folder", *[_r6(c) for c in ("RougeAvg", "Rouge1", "Rouge2", "RougeL")])


_QUERIES["leaderboard"] = _QUERIES.pop("leaderboard_table")


@query
def best_checkpoint(v: Views) -> DataFrame:
    return leaderboard.best_checkpoint(v.eval_log())


# --- sentences -------------------------------------------------------------


@query
def abbreviations(v: Views) -> DataFrame:
    found = sentences.find_abbreviations(v.pairs())
    return found.select("word", "with_period", "without", F.round("score", 4).alias("score"))


@query
def sentence_split(v: Views) -> DataFrame:
    pairs = v.pairs()
    made = sentences.sentences_of(pairs, sentences.find_abbreviations(pairs))
    one_line = F.regexp_replace("sentence", f"[{sentences.BLANKS}]+", " ")
    return made.select("id", "nth", one_line.alias("sentence"))


# --- tokens and ids --------------------------------------------------------


@query
def vocab_build(v: Views) -> DataFrame:
    return _vocab(v)


@query
def encode_fixed(v: Views) -> DataFrame:
    encoded = vocab.encode_fixed(v.pairs(), _vocab(v), ENC_MAX_LEN)
    return encoded.select("id", _joined("input_ids"), _joined("attention_mask"))


@query
def encode_pairs(v: Views) -> DataFrame:
    encoded = vocab.encode_pairs(v.pairs(), _vocab(v), ENC_MAX_LEN)
    return encoded.select("id", _joined("input_ids"), _joined("attention_mask"), _joined("labels"))


@query
def decode_ids(v: Views) -> DataFrame:
    words = _vocab(v)
    return vocab.decode_ids(vocab.encode_fixed(v.pairs(), words, ENC_MAX_LEN), words, "input_ids").select("id", "text")


@query
def encode_corpora(v: Views) -> DataFrame:
    """Corpora that share ids: a row is told by corpus and id."""
    encoded = vocab.encode_fixed(v.corpora(), _vocab(v), ENC_MAX_LEN)
    return encoded.select("dataset", "id", _joined("input_ids"))


def _pieces(v: Views) -> tokenizer.Tokenizer:
    import public_tokenizers

    return tokenizer.subword_tokenizer(v.spark, public_tokenizers.path("piece_bpe_32k.model"))


@query
def encode_subword(v: Views) -> DataFrame:
    """Texts and summaries as ids of scored pieces, both cut to one width."""
    encoded = vocab.encode_pairs(v.pairs(), None, ENC_MAX_LEN, add_eos=True, tokenizer=_pieces(v))
    return encoded.select("id", _joined("input_ids"), _joined("attention_mask"), _joined("labels"))


@query
def decode_subword(v: Views) -> DataFrame:
    """Whole texts to ids of pieces and back."""
    own = _pieces(v)
    ids = v.pairs().select("id", own.ids(F.col("text"), None).alias("ids"))
    return vocab.decode_ids(ids, None, "ids", tokenizer=own)


def _masked_labels(v: Views, words: DataFrame) -> DataFrame:
    return vocab.encode_pairs(v.pairs(), words, ENC_MAX_LEN, ignore_padding=True, keys=("id",)).select("id", "labels")


@query
def unmask_labels(v: Views) -> DataFrame:
    words = _vocab(v)
    labels = _masked_labels(v, words).withColumn("labels", vocab.unmask(F.col("labels")))
    return vocab.decode_ids(labels, words, "labels")


@query
def causal_prompt_ids(v: Views) -> DataFrame:
    ids = vocab.causal_prompt_ids(v.pairs(), _vocab(v), max_length=512, max_new_tokens=256)
    return ids.select("id", _joined("input_ids"))


# --- generation ------------------------------------------------------------


@query
def generate_batched(v: Views) -> DataFrame:
    return generate.generate_batched(v.pairs(), generate.lead_predictor(GEN_MAX_LEN), keys=("id",))


def failing_lead(gen_max_len: int, fails_every: int, prefix: str = "") -> generate.PredictorFactory:
    """The first words, except for texts whose length is a multiple of ``fails_every``."""

    def make() -> generate.Predict:
        def one(text: str) -> str:
            if len(text) % fails_every == 0:
                raise ValueError("no answer")
            return prefix + " ".join(text.split(" ")[:gen_max_len])

        return lambda texts: [one(t) for t in texts]

    return make


@query
def generate_resumable(v: Views) -> DataFrame:
    passes = [failing_lead(GEN_MAX_LEN, 5), failing_lead(GEN_MAX_LEN, 25, "retry ")]
    return generate.generate_resumable(v.pairs(), passes, keys=("id",))


def _scores(df: DataFrame, variants: tuple[str, ...] = NGRAMS) -> DataFrame:
    return df.select("run_id", *[_r6(x) for x in variants])


@query
def evaluate_run(v: Views) -> DataFrame:
    scores = evaluate.evaluate_run(
        corpus.load_corpus("arxiv", v.raw_reader()),
        run_id="lead-arxiv",
        predictor=generate.lead_predictor(GEN_MAX_LEN),
        vocab=_vocab(v),
        enc_max_len=ENC_MAX_LEN,
        path=scratch_path(v.spark, "run"),
        scoring=evaluate.Scoring(NGRAMS, use_stemmer=False),
    )
    return _scores(scores)


@query
def evaluate_counts(v: Views) -> DataFrame:
    """What a run counted on its way: outputs for inputs of some lengths are null."""

    def patchy():
        return lambda texts: [None if len(t) % 7 == 0 else t[:20] for t in texts]

    counted = evaluate.evaluate_run(
        corpus.load_corpus("pubmed", v.raw_reader()), "patchy-pubmed", patchy, _vocab(v), 64, scratch_path(v.spark, "run"),
        split="train", scoring=evaluate.Scoring(("rouge1",), use_stemmer=False),
    )
    return counted.select("run_id", "admitted", "predicted", "unanswered", "matched", "unmatched")


@query
def causal_run(v: Views) -> DataFrame:
    scores = evaluate.causal_run(
        corpus.load_corpus("pubmed", v.raw_reader()),
        run_id="lead-pubmed",
        predictor=evaluate.lead_answer(GEN_MAX_LEN),
        vocab=_vocab(v),
        max_length=512,
        max_new_tokens=256,
        context=4096,
        shots=2,
        split="validation",
        scoring=evaluate.Scoring(NGRAMS, use_stemmer=False),
    )
    return _scores(scores)


@query
def chat_run(v: Views) -> DataFrame:
    scores = evaluate.chat_run(
        corpus.load_corpus("govreport", v.raw_reader()),
        run_id="chat-govreport",
        predictors=[failing_lead(GEN_MAX_LEN, 5), failing_lead(GEN_MAX_LEN, 25, "retry ")],
        budget=tx.CHAT_BUDGET,
        scoring=evaluate.Scoring(NGRAMS, use_stemmer=False),
    )
    return scores.select("run_id", *[_r6(x) for x in NGRAMS], "scored", "unanswered")


def leading_ids(gen_max_len: int, _num_beams: int) -> generate.PredictorFactory:
    """A stand-in over ids: answers with the first of them."""
    return lambda: lambda batch: [ids[:gen_max_len] for ids in batch]


def letter_encoder():
    """A stand-in for a language model: a token's vector tells its length, first and last letter."""
    import re

    import numpy as np

    def encode(texts: list[str]) -> list:
        found = [re.findall("[a-z0-9]+", t.lower()) for t in texts]
        return [np.array([[len(t), ord(t[0]) % 7 + 1, ord(t[-1]) % 5 + 1] for t in ts], np.float32).reshape(-1, 3) for ts in found]

    return encode


@query
def evaluate_config(v: Views) -> DataFrame:
    config = {
        "method": "eval",
        "exec_args": {"model": "lead", "dataset": "arxiv", "metrics": ["rouge", "bertscore"], "preview": False, "samples": "max", "min_input_size": 0},
        "exec_kwargs": {"enc_max_len": ENC_MAX_LEN, "gen_max_len": GEN_MAX_LEN, "num_beams": 1, "batch_size": 8},
    }
    own = {"rouge": metrics.rouge_metric(NGRAMS, use_stemmer=False), "bertscore": metrics.encoded_bertscore(letter_encoder)}
    models = {"lead": evaluate.Model(leading_ids, _vocab(v), over_ids=True)}
    report = evaluate.run_config(config, v.raw_reader(), models, scratch_path(v.spark, "run"), own)
    return report.select("run_id", "metric", "variant", F.round("value", 5).alias("value"))


# --- metrics ---------------------------------------------------------------


def _scored_pairs(v: Views) -> DataFrame:
    return v.pairs().select("id", "prediction", F.col("summary").alias("reference"))


def _pair_scores(v: Views, variant: str, use_stemmer: bool = False) -> DataFrame:
    counts = rouge.rouge_counts(_scored_pairs(v), ("id",), (variant,), use_stemmer)
    scores = [_r6(c, name) for name, c in rouge.prf(variant).items()]
    return counts.select("id", F.col(variant).alias("hits"), "pred_tokens", "ref_tokens", *scores)


@query
def rouge1(v: Views) -> DataFrame:
    return _pair_scores(v, "rouge1")


@query
def rouge2(v: Views) -> DataFrame:
    return _pair_scores(v, "rouge2")


@query
def rougeL(v: Views) -> DataFrame:
    return _pair_scores(v, "rougeL")


@query
def rougeLsum(v: Views) -> DataFrame:
    return _pair_scores(v, "rougeLsum")


@query
def rouge_stemmed(v: Views) -> DataFrame:
    scores = rouge.rouge_scores(_scored_pairs(v), ("id",), UNSTEMMED, use_stemmer=True)
    return scores.select("id", *[_r6(c) for c in scores.columns if c != "id"])


@query
def rouge_corpus(v: Views) -> DataFrame:
    return _scores(rouge.rouge_corpus(_aligned(v), UNSTEMMED, False), UNSTEMMED)


@query
def rouge_corpus_ngrams(v: Views) -> DataFrame:
    return _scores(rouge.rouge_corpus(_aligned(v), NGRAMS, False))


@query
def rouge_interval(v: Views) -> DataFrame:
    found = rouge.rouge_interval(_aligned(v), NGRAMS, False, seed=SEED)
    return found.select("run_id", "variant", _r6("low"), _r6("mean"), _r6("high"), "resamples")


@query
def bertscore_texts(v: Views) -> DataFrame:
    """Texts encoded and matched in one pass."""
    pairs = _scored_pairs(v).withColumn("run_id", F.concat(F.lit("letters-"), (F.col("id") % 5).cast("string")))
    report = metrics.multi_metric_report({"bertscore": metrics.encoded_bertscore(letter_encoder)}, pairs)
    return report.select("run_id", "variant", F.round("value", 5).alias("value"))


@query
def bertscore_pair(v: Views) -> DataFrame:
    scores = bertscore.bertscore_pairs(v.token_vectors())
    return scores.select("pair_id", _r6("precision"), _r6("recall"), _r6("f"))


def _run_vectors(v: Views) -> DataFrame:
    run = F.concat(F.lit("vectors-"), (F.col("pair_id") % 3).cast("string"))
    return v.token_vectors().withColumn("run_id", run)


@query
def bertscore_corpus(v: Views) -> DataFrame:
    scores = bertscore.bertscore_pairs(v.token_vectors())
    run = F.concat(F.lit("vectors-"), (F.col("pair_id") % 3).cast("string"))
    means = bertscore.bertscore_corpus(scores.withColumn("run_id", run))
    return means.select("run_id", _r6("precision"), _r6("recall"), _r6("f"))


@query
def multi_metric_report(v: Views) -> DataFrame:
    chosen = {
        "rouge": metrics.rouge_metric(NGRAMS, use_stemmer=False),
        **metrics.load_metrics(["bertscore"]),
    }
    inputs = {"rouge": _aligned(v), "bertscore": _run_vectors(v)}
    report = metrics.multi_metric_report(chosen, inputs)
    return report.select("run_id", "metric", "variant", _r6("value"))


@query
def masked_eval(v: Views) -> DataFrame:
    words = _vocab(v)
    labels = _masked_labels(v, words).withColumn("labels", vocab.unmask(F.col("labels")))
    references = vocab.decode_ids(labels, words, "labels").select("id", F.col("text").alias("summary"))
    runs_ = v.pairs().select(F.lit("step").alias("run_id"), "id", "prediction")
    aligned = compare.align_pairs(runs_, references)
    return _scores(rouge.rouge_corpus(aligned, NGRAMS, False))


# --- user hooks ------------------------------------------------------------


@query
def hook_preprocess(v: Views) -> DataFrame:
    def only_short(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.length("summary") < 200).withColumn("summary", F.replace("summary", F.lit(" "), F.lit("_")))

    return corpus.load_corpus("bigpatent", v.raw_reader(), preprocess=only_short)


def _shared_word_rate(predictions: list[str], references: list[str]) -> list[float]:
    rates = []
    for p, r in zip(predictions, references):
        words = set(p.split(" "))
        rates.append(len(words & set(r.split(" "))) / len(words))
    return rates


@query
def hook_metric(v: Views) -> DataFrame:
    own = {"shared_words": metrics.python_metric(_shared_word_rate, "rate")}
    report = metrics.multi_metric_report(own, _aligned(v))
    return report.select("run_id", "metric", "variant", _r6("value"))


def word_tokenizer():
    """A user's tokenizer: blank-separated words as they are."""
    import re

    return lambda texts: [[(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", t)] for t in texts]


@query
def hook_tokenizer(v: Views) -> DataFrame:
    own = tokenizer.batch_tokenizer(word_tokenizer)
    text = F.col("text")
    return v.pairs().select("id", own.count(text).alias("n"), tx.truncate_tokens(text, 100, own).alias("text"))


@query
def hook_map_rows(v: Views) -> DataFrame:
    def headline(row: dict) -> dict:
        line = row["text"].split("\n")[0]
        return {"headline": line, "line_chars": len(line)}

    return hooks.map_rows(v.pairs().select("id", "text"), headline, "headline string, line_chars long", ("text",)).drop("text")


@query
def hook_map_batches(v: Views) -> DataFrame:
    def lines(batch: dict[str, list]) -> dict[str, list]:
        found = [(i, n, line) for i, t in zip(batch["id"], batch["text"]) for n, line in enumerate(t.split("\n"))]
        return {"id": [f[0] for f in found], "nth": [f[1] for f in found], "line": [f[2] for f in found]}

    return hooks.map_batches(v.pairs(), lines, "id long, nth long, line string", ("id", "text"))


@query
def hook_predictor(v: Views) -> DataFrame:
    def last_words():
        return lambda texts: [" ".join(t.split(" ")[-GEN_MAX_LEN:]) for t in texts]

    return generate.generate_batched(v.pairs(), last_words, keys=("id",))


# --- the flagship ----------------------------------------------------------


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Admitted pairs, scored by ROUGE-1, averaged per split."""
    ship_package(spark)
    admitted = admission.admit(Views(spark, folder).pairs())
    pairs = admitted.select("split", "id", "prediction", F.col("summary").alias("reference"))
    scores = rouge.rouge_scores(pairs, ("split", "id"), ("rouge1",), use_stemmer=False)
    return scores.groupBy("split").agg(F.count(F.lit(1)).alias("pairs"), _r6(F.avg("rouge1_f"), "rouge1"))
