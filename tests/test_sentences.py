"""Abbreviations and sentences against plain definitions."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gistworks.operators import metrics, rouge, sentences

TEXT = (
    "Dr. Kim met Prof. Lee at 9 a.m. on Main St. near the park. They spoke! \"Was it late?\" she asked. "
    "No. 5 was closed (it was 10 p.m. then). The U.S. team, i.e. Dr. Kim and J. Roe, left... And so on. ok"
)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(1)
    nouns = "park team week house letter door".split()
    rows = [(i, " ".join(draw.choice(["Dr. Kim", "Prof. Lee", "the U.S. team", "a.m. or p.m. now", "i.e. this"]) + f" saw the {draw.choice(nouns)} of a {draw.choice(nouns)}." for _ in range(4))) for i in range(200)]
    # Sentences end in nouns, which also stand inside of others.
    return spark.createDataFrame([*rows, (200, TEXT), (201, None), (202, ""), (203, "One only")], "id long, text string").repartition(4)


def plain_counts(texts):
    out = Counter()
    for text in texts:
        for w in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
            bare = re.sub(r"^[\"'(\[{«“‘]+", "", re.sub(r"[\"')\]}»”’,;:]+$", "", w)).lower()
            out["", bare.endswith(".")] += 1
            word = bare.removesuffix(".")
            if any(c.isalpha() for c in word) and not re.search("[.!?]$", word):
                out[word, bare.endswith(".")] += 1
    return out


def test_counts_and_scores(corpus):
    texts = [r["text"] for r in corpus.collect()]
    want = plain_counts(texts)
    got = {r["word"]: (r["with_period"], r["without"]) for r in sentences.word_counts(corpus).collect()}
    assert got == {w: (want[w, True], want[w, False]) for w, _ in want}
    share = want["", True] / (want["", True] + want["", False])
    found = {r["word"]: r["score"] for r in sentences.find_abbreviations(corpus).collect()}
    assert {"dr", "prof", "u.s", "a.m", "p.m", "i.e"} <= set(found) and not {"park", "team", "kim", "week"} & set(found)
    for word, score in found.items():
        a, b = got[word]
        letters = len(word.replace(".", ""))
        ratio = -2 * (a * math.log(share / 0.99) + b * math.log((1 - share) / (1 - 0.99)))
        assert score == pytest.approx(ratio * math.exp(-letters) * (len(word) - letters + 1) / letters**b) and score >= 0.3


def test_ends(corpus):
    known = frozenset(["dr", "prof", "st", "a.m", "p.m", "u.s", "i.e", "no"])
    assert sentences.split_text(TEXT, known) == [
        "Dr. Kim met Prof. Lee at 9 a.m. on Main St. near the park.", "They spoke!", "\"Was it late?\" she asked.", "No. 5 was closed (it was 10 p.m. then).",
        "The U.S. team, i.e. Dr. Kim and J. Roe, left...", "And so on. ok",
    ]
    assert sentences.split_text(" \n ", known) == sentences.split_text("", known) == []
    assert sentences.split_text("A b?! «Cod.» D\n\nE.", frozenset()) == ["A b?!", "«Cod.»", "D\n\nE."]


def test_shipped_and_joined_abbreviations_agree(corpus):
    found = sentences.find_abbreviations(corpus)
    shipped = {r["id"]: r["sentences"] for r in sentences.split_sentences(corpus, found).collect()}
    joined = {r["id"]: r["sentences"] for r in sentences._split_by_join(corpus, found, "text", "sentences").collect()}
    assert shipped == joined and shipped[201] == shipped[202] == [] and shipped[203] == ["One only"]
    words = {r["word"] for r in found.collect()}
    assert all(shipped[r["id"]] == sentences.split_text(r["text"] or "", words) for r in corpus.collect())
    long = sentences.sentences_of(corpus, found)
    assert {(r["id"], r["nth"], r["sentence"]) for r in long.collect()} == {(i, k, s) for i, x in shipped.items() for k, s in enumerate(x)}


def test_no_periods_no_abbreviations(spark):
    for text in ("no periods here", "all. end. so."):
        assert sentences.find_abbreviations(spark.createDataFrame([(1, text)], "id long, text string")).count() == 0
    assert sentences.find_abbreviations(spark.createDataFrame([], "id long, text string")).count() == 0


def test_summary_level_lcs_over_sentences(spark, corpus):
    found = sentences.find_abbreviations(corpus)
    rows = [("r", 1, "The cat sat. A dog ran. Dr. Kim\nslept", "A dog ran. The cat sat."), ("r", 2, None, "xy. Y"), ("r", 3, "a b", "a b")]
    pairs = spark.createDataFrame(rows, "run_id string, id long, prediction string, reference string")
    lines = {r["id"]: (r["prediction"], r["reference"]) for r in sentences.sentence_lines(pairs, found).collect()}
    assert lines == {1: ("The cat sat.\nA dog ran.\nDr. Kim\nslept", "A dog ran.\nThe cat sat."), 2: (None, "xy.\nY"), 3: ("a b", "a b")}
    by_hand = pairs.withColumn("prediction", F.when(F.col("id") == 1, lines[1][0]).otherwise(F.col("prediction"))).withColumn(
        "reference", F.when(F.col("id") == 1, lines[1][1]).when(F.col("id") == 2, "xy.\nY").otherwise(F.col("reference"))
    )
    want = sorted(r["rougeLsum_f"] for r in rouge.rouge_scores(by_hand, ("run_id", "id"), ("rougeLsum",)).collect())
    got = sorted(r["value"] for r in metrics.rouge_metric(("rougeLsum",), abbreviations=found)(pairs).collect())
    assert got == want
    without = metrics.rouge_metric(("rougeLsum",))(pairs).agg(F.sum("value")).first()[0]
    assert sum(got) > without
