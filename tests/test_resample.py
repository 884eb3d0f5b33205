"""Bootstrap intervals against their definition."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistworks.operators import resample, rouge


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def plain(rows, resamples, tail, seed="bootstrap"):
    """(low, mean, high) of (key, value) rows."""
    means = []
    for b in range(1, resamples + 1):
        a, c = 1 + number(f"{seed}:a:{b}") % (resample.PRIME - 1), number(f"{seed}:c:{b}") % resample.PRIME
        weights = []
        for key, _ in rows:
            u = (a * (number(key) % resample.PRIME) + c) % resample.PRIME
            weights.append(sum(u >= t for t in resample.thresholds()))
        if sum(weights):
            means.append(sum(w * x for w, (_, x) in zip(weights, rows)) / sum(weights))
    means.sort()
    at = lambda part: means[max(1, math.ceil(len(means) * part / 1000)) - 1]
    return at(tail), sum(x for _, x in rows) / len(rows), at(1000 - tail), len(means)


@pytest.fixture(scope="module")
def scores(spark):
    draw = random.Random(4)
    rows = [("a", "x", i, draw.random(), draw.gauss(3, 1)) for i in range(80)] + [("b", "x", i, draw.random(), 1.0) for i in range(3)] + [("c", None, 1, 0.5, 2.0)]
    return spark.createDataFrame(rows, "run_id string, dataset string, id long, u double, v double").repartition(5)


@pytest.mark.parametrize("level, tail", [(0.95, 25), (0.5, 250)])
def test_against_the_definition(scores, level, tail):
    got = resample.bootstrap_intervals(scores, ("u", "v"), keys=("dataset", "id"), resamples=60, level=level).collect()
    rows = scores.collect()
    assert len(got) == 6
    for r in got:
        own = [(f"{x['dataset'] or ''}|{x['id']}", x[r["variant"]]) for x in rows if x["run_id"] == r["run_id"]]
        assert (r["low"], r["mean"], r["high"], r["resamples"]) == pytest.approx(plain(own, 60, tail))


def test_weights_are_poisson(spark):
    keys = spark.range(20_000).select(F.lit("r").alias("run_id"), "id", F.col("id").cast("double").alias("x"))
    means = resample.bootstrap_means(keys, ("x",), "run_id", ("id",), 200, "s").where("resample > 0").toPandas()["x"].to_numpy()
    x = np.arange(20_000)
    assert means.std() == pytest.approx(x.std() / math.sqrt(len(x)), rel=0.2)
    assert means.mean() == pytest.approx(x.mean(), abs=4 * x.std() / math.sqrt(len(x) * 200))


def test_partitioning_does_not_matter(scores):
    found = [sorted(map(str, resample.bootstrap_intervals(scores.repartition(n), ("u",), keys=("id",), resamples=20).select("run_id", F.round("low", 9), F.round("high", 9)).collect())) for n in (1, 6)]
    assert found[0] == found[1]


def test_nulls_single_rows_and_levels(spark, scores):
    one = spark.createDataFrame([("r", 1, 0.25), ("r", 2, None)], "run_id string, id long, u double")
    row = resample.bootstrap_intervals(one, ("u",), resamples=30).first()
    assert row["low"] == row["mean"] == row["high"] == 0.25 and 5 < row["resamples"] <= 30
    assert resample.bootstrap_intervals(one.limit(0), ("u",)).count() == 0
    with pytest.raises(ValueError):
        resample.bootstrap_intervals(scores, ("u",), level=1.0)


def test_texts_are_read_once(spark, plan_of):
    pairs = spark.createDataFrame([("r", i, f"a b {i}", "a b c") for i in range(9)], "run_id string, id long, prediction string, reference string")
    made = rouge.rouge_interval(pairs, resamples=50)
    assert plan_of(made).count("Scan ExistingRDD") == 1 and "Join" not in plan_of(made)
    rows = {r["variant"]: r for r in made.collect()}
    assert set(rows) == set(rouge.VARIANTS) and all(r["low"] <= r["mean"] <= r["high"] for r in rows.values())


def test_scores_are_made_once_and_resamples_are_no_rows(spark, plan_of):
    """A condition on the scores was moved below the shuffle, where all n-grams were matched a second time."""
    pairs = spark.createDataFrame([("r", i, f"a b {i}", "a b c") for i in range(9)], "run_id string, id long, prediction string, reference string")
    plan = plan_of(rouge.rouge_interval(pairs, ("rouge1", "rouge2"), use_stemmer=False, resamples=50))
    assert "atleastnnonnulls" not in plan and "posexplode" not in plan and plan.count("lower(prediction") == 1


def test_weights_at_the_ends_of_the_keys():
    a, c = (np.array(x, np.int64) for x in resample.coefficients(40, "s"))
    a[:3], c[:3] = (1, resample.PRIME - 1, resample.PRIME - 1), (0, 0, resample.PRIME - 1)
    keys = np.array([0, 1, 2, resample.PRIME - 1, 2**30])
    steps = resample.thresholds()
    got = resample._weights(keys, a, c, steps)
    draws = [[(x * k + y) % resample.PRIME for x, y in zip(a.tolist(), c.tolist())] for k in keys.tolist()]
    assert got.tolist() == [[1, *[sum(u >= t for t in steps) for u in row]] for row in draws]


def test_rows_with_null_or_nan_are_left_out_and_infinite_ones_weighed(spark):
    rows = [("r", i, float(i), 1.0) for i in range(9)]
    odd = [("r", 20, None, 1.0), ("r", 21, 1.0, float("nan")), ("q", 22, None, None)]
    kind = "run_id string, id long, u double, v double"
    got, want = (sorted(resample.bootstrap_intervals(spark.createDataFrame(x, kind), ("u", "v"), resamples=30).collect()) for x in (rows + odd, rows))
    assert got == want and len(got) == 2
    means = resample.bootstrap_means(spark.createDataFrame([*rows, ("r", 30, float("inf"), 2.0)], kind), ("u", "v"), "run_id", ("id",), 60, "s").collect()
    endless = [math.isinf(r["u"]) for r in means if r["resample"]]
    assert any(endless) and not all(endless) and not any(math.isnan(r["u"]) for r in means)


@pytest.mark.parametrize("kind", ["string", "long", "struct<a: string, b: long>"])
def test_many_runs_pass_on_their_sums_in_parts(spark, monkeypatch, kind):
    monkeypatch.setattr(resample, "_HELD", 1 << 10)
    run = {"string": F.col("n").cast("string"), "long": F.col("n"), "struct<a: string, b: long>": F.struct(F.lit("x").alias("a"), F.col("n").alias("b"))}[kind]
    rows = spark.range(700, numPartitions=3).withColumn("n", F.when(F.col("id") % 10 > 0, F.col("id") % 90))
    scores = rows.select(run.alias("run_id"), "id", (F.col("id") * F.col("id")).cast("double").alias("u"))
    whole = rows.groupBy("n").agg(F.avg((F.col("id") * F.col("id")).cast("double")).alias("u"), F.count(F.lit(1)).alias("n_rows"))
    got = resample.bootstrap_means(scores, ("u",), "run_id", ("id",), 20, "s")
    assert got.groupBy("run_id", "resample").count().where("count > 1").count() == 0
    plain_means = sorted(r["u"] for r in got.where("resample = 0").collect())
    assert plain_means == pytest.approx(sorted(r["u"] for r in whole.collect())) and len(plain_means) == 82
