"""Joins, hooks, the metric registry, length figures and whole evaluations."""

import pytest
from pyspark.sql import functions as F

from gistworks.operators import compare, generate, hooks, lengths, metrics, vocab
from gistworks.plans import evaluate
from gistworks.session import materialize, scratch_path, shared_dir
from gistworks.sources.sinks import read_metrics


@pytest.fixture(scope="module")
def references(spark):
    return spark.createDataFrame([(i, f"a summary of {i}") for i in range(6)], "id long, summary string")


@pytest.fixture(scope="module")
def predictions(spark):
    data = [("x", i, f"x says {i}") for i in range(6)] + [("y-z", i, f"y says {i}") for i in (1, 3, 77)]
    return spark.createDataFrame(data, "run_id string, id long, prediction string")


def test_alignment_is_by_key(predictions, references):
    rows = compare.align_pairs(predictions, references).collect()
    assert len(rows) == 8
    assert all(r["prediction"].split()[-1] == r["reference"].split()[-1] == str(r["id"]) for r in rows)
    only_y = predictions.where("run_id = 'y-z'")
    assert tuple(compare.align_report(only_y, references).first()) == (2, 1, 4)


def test_side_by_side(predictions, references):
    rows = {r["id"]: r for r in compare.side_by_side(references, predictions, ["x", "y-z", "none"], "run_id").collect()}
    assert len(rows) == 6
    assert rows[1]["y-z"] == "y says 1" and rows[2]["y-z"] == compare.MISSING == rows[1]["none"]


def test_lengths(spark):
    df = spark.createDataFrame([(n,) for n in (0, 9, 10, 19, 20, 20, 18000, 17999)], "num_tok long")
    assert {tuple(r) for r in lengths.length_histogram(df).collect()} == {(0, 2), (10, 2), (20, 2), (18000, 1), (17990, 1)}
    assert lengths.length_cutoff(df).count() == 7
    assert tuple(lengths.length_summary(df).first()) == (18000, 0, 4509.625)
    assert [tuple(r) for r in lengths.length_top(df, n=2).collect()] == [(20, 2), (0, 1)]


def test_metric_registry(predictions, references):
    with pytest.raises(ValueError, match="unknown metrics"):
        metrics.load_metrics(["rouge", "bleu"])
    assert list(metrics.load_metrics(["bertscore", "rouge"])) == ["bertscore", "rouge"]
    metrics.register_metric("own", metrics.python_metric(lambda p, r: [float(len(x)) for x in p], "chars"))
    try:
        aligned = compare.align_pairs(predictions, references)
        chosen = metrics.load_metrics(["rouge", "own"])
        rows = metrics.multi_metric_report(chosen, dict.fromkeys(chosen, aligned)).collect()
    finally:
        del metrics.REGISTRY["own"]
    found = {(r["run_id"], r["metric"], r["variant"]): r["value"] for r in rows}
    assert len(found) == 2 * (4 + 1)
    assert found["x", "own", "chars"] == 8 and 0 < found["x", "rouge", "rouge1"] < 1
    with pytest.raises(ValueError):
        metrics.multi_metric_report({}, {})


def test_map_hooks(spark, references):
    added = hooks.map_rows(references, lambda r: {"n": len(r["summary"]), "id": -r["id"]}, "n long, id long", ("id", "summary"))
    assert {(r["id"], r["n"]) for r in added.collect()} == {(-i, 14) for i in range(6)}

    def doubled_even(batch):
        ids = [i for i in batch["id"] if i % 2 == 0 for _ in (0, 1)]
        return {"id": ids}

    assert sorted(r["id"] for r in hooks.map_batches(references, doubled_even, "id long", ("id",)).collect()) == [0, 0, 2, 2, 4, 4]


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        (i, "arxiv", "test" if i % 2 else "train", f"word{i} and more words about topic{i} " * 5, f"about topic{i}")
        for i in range(20)
    ]
    return spark.createDataFrame(data, "id long, dataset string, split string, text string, summary string")


def test_evaluation_stores_what_it_scores(spark, corpus):
    words = vocab.build_vocab(corpus, size=500)
    path = scratch_path(spark, "test-run")
    scores = evaluate.evaluate_run(corpus, "lead-arxiv", generate.lead_predictor(6), words, 64, path).first()
    stored = read_metrics(spark, f"{path}/metrics").first()
    assert stored["folder"] == "lead-arxiv" and stored["rougeL"] == pytest.approx(scores["rougeL"])
    assert scores["rouge1"] == pytest.approx(2 * 2 / (6 + 2))
    predictions = spark.read.parquet(f"{path}/predictions")
    assert predictions.count() == 10 and predictions.where("prediction not like 'word%'").count() == 0


def test_causal_and_chat_runs(spark, corpus):
    words = vocab.build_vocab(corpus.unionByName(corpus.limit(1).withColumn("summary", F.lit("summary an expert"))), size=500)
    causal = evaluate.causal_run(corpus, "c", evaluate.lead_answer(4), words, 64, 16, context=4096, shots=2)
    assert causal.count() == 1
    assert evaluate.causal_run(corpus, "c", evaluate.lead_answer(4), words, 64, 16, context=8, shots=2).count() == 0
    chat = evaluate.chat_run(corpus, "c", [generate.lead_predictor(40)], 13)
    assert chat.first()["run_id"] == "c"


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "test")
    assert df.inputFiles()[0].startswith("file:") and shared_dir(spark).split(":")[-1] in df.inputFiles()[0]
    assert df.agg(F.sum("x")).first()[0] == 90


def test_corpora_with_equal_ids_stay_apart(spark):
    data = [("arxiv", 1, "a1", "p"), ("pubmed", 1, "b1", "q")]
    df = spark.createDataFrame(data, "dataset string, id long, summary string, prediction string").withColumn("run_id", F.lit("r"))
    rows = compare.align_pairs(df, df).collect()
    assert sorted((r["dataset"], r["prediction"], r["reference"]) for r in rows) == [("arxiv", "p", "a1"), ("pubmed", "q", "b1")]
    assert compare.side_by_side(df.drop("prediction", "run_id"), df, ["r"], "run_id").count() == 2
    log = df.select("dataset", "id", F.lit(1).alias("attempt"), (F.col("dataset") == "arxiv").alias("ok"), F.lit("o").alias("output"))
    assert {r["dataset"] for r in generate.pending_subset(df, log).collect()} == {"pubmed"}
    assert {r["dataset"]: r["ok"] for r in generate.retry_merge(df, log).collect()} == {"arxiv": True, "pubmed": False}


def test_configuration_is_checked(spark):
    args = {"model": "m", "dataset": "arxiv", "metrics": ["rouge"], "preview": False, "samples": "max", "min_input_size": 0}
    for config, said in (
        ({"method": "finetune"}, "method"), ({"method": "eval", "exec_args": {"model": "m"}}, "lacks"),
        ({"method": "eval", "exec_args": args}, "unknown model"), ({"method": "eval", "exec_args": {**args, "metrics": ["no"]}}, "unknown m"),
    ):
        with pytest.raises(ValueError, match=said):
            evaluate.run_config(config, None, {}, "/nowhere")


def test_configured_run(spark, tmp_path):
    data = [(1, "test", "w " * 40 + "end", "w fin"), (2, "test", "q " * 50, "z"), (3, "train", "x " * 30, "x y")]
    reader = lambda spec: spark.createDataFrame(data, "id long, split string, article string, abstract string")
    config = {
        "method": "eval",
        "exec_args": {"model": "lead", "dataset": "arxiv", "metrics": ["rouge", "own"], "preview": True, "samples": "max", "min_input_size": 0},
        "exec_kwargs": {"gen_max_len": 3},
    }
    models = {"lead": evaluate.Model(lambda budget, beams: generate.lead_predictor(budget))}
    own = {"own": metrics.python_metric(lambda p, r: [float(len(x.split())) for x in p], "words")}
    got = {(r["metric"], r["variant"]): r["value"] for r in evaluate.run_config(config, reader, models, str(tmp_path / "run"), own).collect()}
    assert got["own", "words"] == 3 and set(got) == {("own", "words")} | {("rouge", v) for v in ("rouge1", "rouge2", "rougeL", "rougeLsum")}
    # "w w w" against "w fin": one match of five tokens; the other pair has none.
    assert got["rouge", "rouge1"] == pytest.approx(0.2)


def test_scratch_tables_go(spark):
    import os

    from gistworks.session import clear_scratch, discard

    one, two = (materialize(spark.range(3)) for _ in range(2))
    discard(one)
    assert not os.path.exists(one.stored_at.removeprefix("file:")) and two.count() == 3
    clear_scratch(spark)
    assert not os.path.exists(two.stored_at.removeprefix("file:"))
