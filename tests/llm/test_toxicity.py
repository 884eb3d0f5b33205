"""The classifier's fit against a dense solver, its score against a plain sum, and pairs of groups found in the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistworks.llm import queries, toxicity

from .conftest import words


def sparse(matrix):
    rows, cols = np.nonzero(matrix)
    return toxicity.Sparse(rows, cols, matrix[rows, cols].astype(float), matrix.shape)


@pytest.mark.parametrize("seed, fairness", [(1, 0.0), (2, 1.0), (3, 20.0)])
def test_weights_are_the_minimum(seed, fairness):
    draw = np.random.default_rng(seed)
    x, y = (draw.random((120, 9)) < 0.3) * draw.integers(1, 3, (120, 9)), (draw.random(120) < 0.4).astype(float)
    d = draw.integers(-1, 2, (30, 9))
    w, bias = toxicity.fit_weights(sparse(x), y, sparse(d), fairness=fairness, rounds=40)
    # Newton's method on the whole matrix.
    v, c = np.zeros(9), 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ v + c)))
        g = np.append(x.T @ (p - y) + 0.05 * v + 2 * fairness * 120 / 30 * d.T @ (d @ v), (p - y).sum())
        full = np.column_stack((x, np.ones(120)))
        h = full.T @ (full * (p * (1 - p))[:, None])
        h[:9, :9] += 0.05 * np.eye(9) + 2 * fairness * 120 / 30 * d.T @ d
        step = np.linalg.solve(h, g)
        v, c = v - step[:9], c - step[9]
    assert w == pytest.approx(v, abs=2e-3) and bias == pytest.approx(c, abs=2e-3)


def test_score_is_the_sum_over_distinct_words(make_docs):
    draw = random.Random(1)
    known = ["vile", "nasty", "calm", "élan", "vileness"]
    slots = sorted({s for w in known for s in toxicity.slots(w.encode())})
    model = toxicity.Classifier(np.array(slots), np.array([draw.uniform(-2, 2) for _ in slots]), -0.3)
    rows = [(k, " ".join(draw.choice([*known, "other", "Vile!", "CALM,"]) for _ in range(draw.randint(0, 9)))) for k in range(50)] + [(99, None)]
    weight = model.table()
    for r in toxicity.with_score(make_docs(rows), model, "own").collect():
        found = set("".join(c if c.isalnum() else " " for c in (r["text"] or "").lower()).split())
        total = -0.3 + sum(weight.get(s, 0.0) for w in found for s in toxicity.slots(w.encode()))
        assert r["own"] == pytest.approx(1 / (1 + np.exp(-total)))


def labelled(spark, make_docs):
    """Two made-up group names that stand in the same places, one mostly in toxic texts; no list has them."""
    draw = random.Random(8)
    rows, marks = [], []
    for k in range(900):
        text, toxic = words(3000 + k, 20), k % 2
        if toxic:
            text[3] = "vileword"
        for spot, (name, share) in {8: ("zorbs", 0.5), 14: ("quelps", 0.5)}.items():
            if draw.random() < share:
                text[spot - 1 : spot + 2] = ["the", name, "live"]
        rows.append((k, " ".join(text)))
        marks.append((k, toxic))
    return make_docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_groups_are_found_in_the_rows(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    sample = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("label"))
    found = dict(toxicity.find_groups(sample))
    assert found["zorbs"] == "quelps" and found["quelps"] == "zorbs" and "vileword" not in found
    assert toxicity.find_groups(sample.limit(0)) == [] == toxicity.find_groups(sample.where("label = 1"))
    with_found, without = toxicity.fit(docs, labels), toxicity.fit(docs, labels, groups=(), found=0)
    assert with_found.pairs > 500 and without.pairs == 0
    own = toxicity.fit(docs, labels, groups=(("zorbs", "quelps"),), found=0)
    assert 0 < own.pairs <= 900 * toxicity.PAIRS


def test_the_query_has_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert toxicity.fit(docs, queries.train_labels(spark, folder)).pairs > 0


def test_pairs_of_a_text_are_bounded():
    swap = {"a": "b", "b": "a"}
    text = ". ".join(f"a says {k}" for k in range(50)) + ". a says 1. nothing here"
    got = toxicity.counterfactuals(text, swap)
    assert len(got) == toxicity.PAIRS and all(y == x.replace("a ", "b ", 1) for x, y in got)
    assert got == toxicity.counterfactuals(". ".join(reversed(text.split(". "))), swap) and toxicity.counterfactuals(None, swap) == []


def test_rows_of_one_identifier_are_bounded(spark, make_docs):
    docs, labels = labelled(spark, make_docs)
    many = docs.unionByName(make_docs([(5, f"vileword {k}") for k in range(500)]))
    assert toxicity.fit(many, labels, sample=600).pairs <= 600 * toxicity.PAIRS


@pytest.mark.parametrize("n, sign, toxic_of", [(24, "vileword", 1), (900, "kindword", 0)])
def test_few_rows_and_words_against_the_label_rank_too(spark, make_docs, n, sign, toxic_of):
    """A word that stands in a tenth of the rows tells the label, for it or against it."""
    texts = {k: " ".join([*words(k, 12), *([sign] if k % 10 == 3 else [])]) for k in range(n)}
    labels = spark.createDataFrame([(k, toxic_of if k % 10 == 3 else 1 - toxic_of) for k in range(n)], "doc_id long, toxic int")
    unseen = make_docs([(k, " ".join([*words(5000 + k, 12), *([sign] if k % 2 else [])])) for k in range(20)])
    scored = toxicity.with_score(unseen, toxicity.fit(make_docs(texts.items()), labels)).collect()
    with_sign, without = ([r["score"] for r in scored if r["doc_id"] % 2 == k] for k in (1, 0))
    assert min(with_sign) > max(without) if toxic_of else max(with_sign) < min(without)
