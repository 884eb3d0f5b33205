import numpy as np
import pytest

from gistworks.operators.bertscore import bertscore_corpus, bertscore_pairs, match
from gistworks.operators.metrics import bertscore_metric, encoded_bertscore, multi_metric_report
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = []
    # The first pair holds most tokens; the last has no reference.
    for pair, (n_pred, n_ref) in enumerate([(90, 70), (3, 1), (1, 4), (2, 0)]):
        for side, n in ((0, n_pred), (1, n_ref)):
            data += [(pair, side, pos, [float(x) for x in rng.normal(size=5)]) for pos in range(n)]
    data.append((4, 0, 0, [0.0] * 5))
    data.append((4, 1, 0, [1.0] * 5))
    return spark.createDataFrame(data, "pair_id long, side int, pos long, v array<double>")


def brute(vectors):
    frame = vectors.toPandas()
    out = {}
    for pair, rows in frame.groupby("pair_id"):
        sides = [np.array(rows[rows.side == s].v.tolist()) for s in (0, 1)]
        if min(map(len, sides)) == 0:
            out[pair] = (0.0, 0.0, 0.0)
            continue
        with np.errstate(invalid="ignore"):
            unit = [np.nan_to_num(s / np.linalg.norm(s, axis=1, keepdims=True)) for s in sides]
        c = unit[0] @ unit[1].T
        p, r = c.max(axis=1).mean(), c.max(axis=0).mean()
        out[pair] = (p, r, 2 * p * r / (p + r) if p + r else 0.0)
    return out


@pytest.mark.parametrize("block", [7, 256])
def test_block_size_does_not_change_the_scores(vectors, block):
    want = brute(vectors)
    got = {r["pair_id"]: tuple(r)[1:] for r in bertscore_pairs(vectors.repartition(5), block).collect()}
    assert got.keys() == want.keys() == {0, 1, 2, 3, 4}
    for pair, scores in want.items():
        assert got[pair] == pytest.approx(scores)


def test_same_text_scores_one(vectors):
    half = vectors.where("side = 0 and pair_id < 3")
    both = half.unionByName(half.withColumn("side", F.lit(1)))
    for row in bertscore_pairs(both, 16).collect():
        assert tuple(row)[1:] == pytest.approx((1.0, 1.0, 1.0))


def test_runs_are_kept_apart(vectors):
    twice = vectors.withColumn("run_id", F.lit("a")).unionByName(vectors.withColumn("run_id", F.lit("b")))
    rows = bertscore_metric(twice).groupBy("run_id", "variant").agg(F.avg("value").alias("v")).collect()
    means = np.array(list(brute(vectors).values())).mean(axis=0)
    for row in rows:
        assert row["v"] == pytest.approx(means[["precision", "recall", "f"].index(row["variant"])])
    assert len(rows) == 6
    scored = bertscore_pairs(vectors).withColumn("run_id", F.lit("x"))
    assert tuple(bertscore_corpus(scored).first())[1:] == pytest.approx(tuple(means))


def test_a_listed_pair_without_tokens_scores_zero(spark, vectors):
    pairs = spark.createDataFrame([(0,), (9,)], "pair_id long")
    got = {r["pair_id"]: tuple(r)[1:] for r in bertscore_pairs(vectors, pairs=pairs).collect()}
    assert got[9] == (0.0, 0.0, 0.0) and got[3] == (0.0, 0.0, 0.0) and len(got) == 6


def spell(text):
    """A vector for each word, by its letters."""
    rng = [np.random.default_rng(sum(map(ord, w))).normal(size=6) for w in text.split()]
    return np.array(rng, np.float32).reshape(-1, 6)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_blocks_of_a_match(block):
    p, r = spell("a b c d e f g"), spell("b x y a q")
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (p.astype(float), r.astype(float))]
    c = unit[0] @ unit[1].T
    want = c.max(axis=1).mean(), c.max(axis=0).mean()
    got = match(p, r, block)
    assert got[:2] == pytest.approx(want) and got[2] == pytest.approx(2 * want[0] * want[1] / sum(want))
    assert match(p, r[:0]) == match(p[:0], r) == (0.0, 0.0, 0.0)


def test_texts_are_encoded_once_and_not_shuffled(spark, plan_of):
    texts = [("a b c", "b c"), ("b c", "a b c"), ("", "z"), (None, None), ("long words in it", "b c")]
    rows = [(("r", "s")[i % 2], i, *texts[i % 5]) for i in range(40)]
    pairs = spark.createDataFrame(rows, "run_id string, id long, prediction string, reference string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def encoder():
        def encode(batch):
            calls.add(len(batch))
            return [spell(t) for t in batch]

        return encode

    scored = encoded_bertscore(encoder, batch_size=40)(pairs)
    assert "Exchange" not in plan_of(scored)
    got = scored.collect()
    # Of the 80 texts of one batch five are distinct, the empty one among them.
    assert calls.value == 5 and len(got) == 120
    want = [match(spell(p or ""), spell(r or "")) for _, _, p, r in rows]
    for k, name in enumerate(("precision", "recall", "f")):
        assert sorted(r["value"] for r in got if r["variant"] == name) == pytest.approx(sorted(w[k] for w in want))


def test_pairs_are_stored_once_for_several_metrics(spark, plan_of):
    rows = [("r", i, "a b", "b c") for i in range(6)]
    pairs = spark.createDataFrame(rows, "run_id string, id long, prediction string, reference string")
    one = encoded_bertscore(lambda: lambda batch: [spell(t) for t in batch])
    report = multi_metric_report({"x": one, "y": one}, pairs)
    assert "ExistingRDD" not in plan_of(report) and report.count() == 6
