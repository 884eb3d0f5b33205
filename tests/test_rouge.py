import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gistworks.functions.porter import stem_token
from gistworks.operators import rouge
from tests.test_kernels import table, union_hits

WORDS = "running runs ran the of summaries summary évident 42 relational".split()


def brute(prediction, reference, stemmed):
    """All four variants from their definitions, as (hits, n_pred, n_ref)."""

    def lines(text):
        clean = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789\n" else " " for c in text.lower())
        found = [[stem_token(t) if stemmed else t for t in line.split()] for line in clean.split("\n")]
        return [line for line in found if line]

    p, r = lines(prediction), lines(reference)
    fp, fr = sum(p, []), sum(r, [])

    def grams(tokens, n):
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    out = {}
    for n, name in ((1, "rouge1"), (2, "rouge2")):
        gp, gr = grams(fp, n), grams(fr, n)
        out[name] = (sum((gp & gr).values()), sum(gp.values()), sum(gr.values()))
    out["rougeL"] = (table(fp, fr)[-1][-1], len(fp), len(fr))
    out["rougeLsum"] = (union_hits(r, p), len(fp), len(fr))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(11)

    def text():
        return "".join(rng.choice(WORDS) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randint(0, 25)))

    data = [(i, text(), text()) for i in range(60)] + [(60, "", "a b"), (61, "", ""), (62, "one", "one"), (63, "é", "è")]
    return spark.createDataFrame(data, "id long, prediction string, reference string")


@pytest.mark.parametrize("stemmed", [False, True])
def test_every_variant_against_brute_force(pairs, stemmed):
    scores = {r["id"]: r for r in rouge.rouge_scores(pairs, use_stemmer=stemmed).collect()}
    rows = pairs.collect()
    assert len(scores) == len(rows)
    for row in rows:
        for name, (hits, n_pred, n_ref) in brute(row["prediction"], row["reference"], stemmed).items():
            p, r = (hits / n if n else 0.0 for n in (n_pred, n_ref))
            f = 2 * p * r / (p + r) if p + r else 0.0
            got = [scores[row["id"]][f"{name}_{x}"] for x in ("precision", "recall", "f")]
            assert got == pytest.approx([p, r, f]), (row, name)


def test_properties(pairs):
    swapped = pairs.select("id", F.col("reference").alias("prediction"), F.col("prediction").alias("reference"))
    same = pairs.select("id", "reference", F.col("reference").alias("prediction"))
    a, b = (rouge.rouge_scores(x, use_stemmer=False) for x in (pairs, swapped))
    for v in ("rouge1", "rouge2", "rougeL"):
        both = a.alias("a").join(b.alias("b"), "id")
        assert both.where(F.abs(F.col(f"a.{v}_precision") - F.col(f"b.{v}_recall")) > 1e-12).count() == 0
        assert a.where(~F.col(f"{v}_f").between(0, 1)).count() == 0
    counts = rouge.rouge_counts(pairs, use_stemmer=False)
    assert counts.where("rouge2 > rouge1 or rougeL > least(pred_tokens, ref_tokens) or rougeL > rouge1").count() == 0
    whole = rouge.rouge_counts(same, use_stemmer=False)
    assert whole.where("rouge1 <> ref_tokens or rougeL <> ref_tokens").count() == 0


def test_partitioning_does_not_matter(pairs):
    found = [sorted(map(tuple, rouge.rouge_counts(pairs.repartition(n)).collect())) for n in (1, 5)]
    assert found[0] == found[1]


def test_null_texts_score_zero(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None)], "id long, prediction string, reference string")
    for stemmed in (False, True):
        for row in rouge.rouge_scores(df, use_stemmer=stemmed).collect():
            assert [v for k, v in row.asDict().items() if k != "id"] == [0.0] * 12


def test_subset_of_variants_and_unknown_name(pairs):
    only = rouge.rouge_scores(pairs, variants=("rougeLsum",))
    assert only.columns == ["id", "rougeLsum_precision", "rougeLsum_recall", "rougeLsum_f"]
    with pytest.raises(ValueError, match="unknown variants"):
        rouge.rouge_counts(pairs, variants=("rouge3",))


def test_one_exchange_and_no_join(pairs, plan_of):
    plan = plan_of(rouge.rouge_counts(pairs, variants=("rouge1", "rouge2"), use_stemmer=False))
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for stemmed, variants in ((False, rouge.VARIANTS), (True, ("rouge1",)), (True, rouge.VARIANTS)):
        assert "Exchange" not in plan_of(rouge.rouge_counts(pairs, variants=variants, use_stemmer=stemmed))


def test_both_plans_count_the_same_ngrams(pairs):
    native = rouge.rouge_counts(pairs, variants=("rouge1", "rouge2"), use_stemmer=False)
    arrow = rouge.rouge_counts(pairs, use_stemmer=False).select(*native.columns)
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, arrow.collect()))


def test_a_constant_run_name_costs_no_shuffle(pairs, plan_of):
    one_run = pairs.withColumn("run_id", F.lit("only"))
    plan = plan_of(rouge.rouge_counts(one_run, ("run_id", "id"), ("rouge1", "rouge2"), use_stemmer=False))
    assert plan.count("Exchange hashpartitioning") == 1


def test_corpus_value_is_the_mean(spark, pairs):
    keyed = pairs.withColumn("run_id", F.when(F.col("id") % 3 == 0, "b").otherwise("a"))
    got = {r["run_id"]: r for r in rouge.rouge_corpus(keyed).collect()}
    per_pair = rouge.rouge_scores(keyed, ("run_id", "id")).toPandas().groupby("run_id").mean()
    for run in "ab":
        for v in rouge.VARIANTS:
            assert got[run][v] == pytest.approx(per_pair.loc[run, f"{v}_f"])


def test_repeated_keys_are_rows_of_their_own(spark):
    rows = [(1, "a b c", "a b"), (1, "a b", "a b c d"), (1, "a b c", "a b"), (None, "x", "x"), (None, "y", "x")]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string").repartition(3)
    variants = ("rouge1", "rouge2")
    native = rouge.rouge_counts(pairs, variants=variants, use_stemmer=False)
    arrow = rouge.rouge_counts(pairs, variants=(*variants, "rougeL"), use_stemmer=False).select(*native.columns)
    got = sorted(map(tuple, native.collect()), key=repr)
    assert got == sorted(map(tuple, arrow.collect()), key=repr)
    assert got == sorted([(1, 3, 2, 2, 1), (1, 3, 2, 2, 1), (1, 2, 4, 2, 1), (None, 1, 1, 1, 0), (None, 1, 1, 0, 0)], key=repr)
    assert rouge.rouge_scores(pairs, variants=variants, use_stemmer=False).where("rouge1_f > 1").count() == 0


def test_ngrams_stay_in_their_row(spark, plan_of):
    rows = [(1, "a b a b a b", "b a b a c a b"), (2, "x", "x"), (3, "", "a"), (4, "a " * 3000, "a " * 2000 + "b"), (5, "b a", "a b"), (6, "Ab ab", "AB-ab ab")]
    pairs = spark.createDataFrame(rows, "id long, prediction string, reference string")
    counts = rouge.rouge_counts(pairs, variants=("rouge1", "rouge2"), use_stemmer=False)
    assert "Generate" not in plan_of(counts) and "Aggregate" not in plan_of(counts)
    got = {r["id"]: (r["pred_tokens"], r["ref_tokens"], r["rouge1"], r["rouge2"]) for r in counts.collect()}
    assert got == {1: (6, 7, 6, 4), 2: (1, 1, 1, 0), 3: (0, 1, 0, 0), 4: (3000, 2001, 2000, 1999), 5: (2, 2, 2, 0), 6: (2, 3, 2, 1)}
