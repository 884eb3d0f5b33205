"""Runs written again, writes that die, and what is left to clean; and counts of a run."""

import pytest

from gistworks.operators import generate, vocab
from gistworks.plans import evaluate
from gistworks.sources.store import RunStore

SCHEMA = "id long, prediction string, run_id string"


@pytest.fixture
def kept(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"), SCHEMA)


def rows(store):
    return sorted(map(tuple, store.read().collect()))


def test_the_last_version_of_each_run(spark, kept):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert rows(kept) == []
    kept.write(frame([(1, "a", "r"), (2, "b", "r"), (1, "x", "s")]))
    kept.write(frame([(1, "a", "r"), (2, "b", "r"), (1, "x", "s")]))
    assert rows(kept) == [(1, "a", "r"), (1, "x", "s"), (2, "b", "r")]
    kept.write(frame([(3, "c", "r")]))
    kept.write(frame([(7, "n", "t")]))
    assert rows(kept) == [(1, "x", "s"), (3, "c", "r"), (7, "n", "t")]
    assert len(kept.clean()) == 1
    assert rows(kept) == [(1, "x", "s"), (3, "c", "r"), (7, "n", "t")]


def test_uncommitted_writes_are_not_seen(spark, kept):
    kept.write(spark.createDataFrame([(1, "a", "r")], SCHEMA))
    version = kept.write(spark.createDataFrame([(2, "b", "r"), (3, "c", "u")], SCHEMA), commit=False)
    assert rows(kept) == [(1, "a", "r")]
    kept.commit(version)
    assert rows(kept) == [(2, "b", "r"), (3, "c", "u")]
    lost = kept.write(spark.createDataFrame([(9, "z", "r")], SCHEMA), commit=False)
    assert lost in kept.clean() and rows(kept) == [(2, "b", "r"), (3, "c", "u")]


def test_a_failed_write_changes_nothing(spark, kept):
    kept.write(spark.createDataFrame([(1, "a", "r")], SCHEMA))
    bad = spark.range(10).selectExpr("id", "string(raise_error('no')) as prediction", "'r' as run_id")
    with pytest.raises(Exception, match="no"):
        kept.write(bad)
    assert rows(kept) == [(1, "a", "r")]


def test_a_run_without_a_name(spark, kept):
    kept.write(spark.createDataFrame([(1, "a", None), (2, "b", "r")], SCHEMA))
    kept.write(spark.createDataFrame([(3, "c", None)], SCHEMA))
    assert sorted(rows(kept), key=str) == [(2, "b", "r"), (3, "c", None)]


def test_counts_need_no_job_of_their_own(spark, tmp_path):
    data = [("arxiv", "test", i, f"word{i} " * (i + 3), "word0") for i in range(12)]
    corpus = spark.createDataFrame(data, "dataset string, split string, id long, text string, summary string").repartition(3)
    words = vocab.build_vocab(corpus)

    def gaps():
        return lambda texts: [None if len(t) % 3 == 0 else t for t in texts]

    made = evaluate.evaluate_run(corpus, "gaps", gaps, words, 4, str(tmp_path / "a"), scoring=evaluate.Scoring(("rouge1",), False)).first()
    lengths = [len(" ".join([f"word{i}"] * min(4, i + 3))) for i in range(12)]
    assert made["admitted"] == made["predicted"] == made["matched"] == 12 and made["unmatched"] == 0
    assert made["unanswered"] == sum(n % 3 == 0 for n in lengths)
    lead = evaluate.evaluate_run(corpus, "lead", generate.lead_predictor(2), words, 4, str(tmp_path / "b"), scoring=evaluate.Scoring(("rouge1",), False)).first()
    assert lead["unanswered"] == 0 and lead["run_id"] == "lead"
