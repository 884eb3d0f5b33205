import random

from pyspark.sql import functions as F

from gistworks.operators.selection import kth_smallest, preview_head, sample_one, train_cap


def test_kth_smallest_is_exact(spark):
    rng = random.Random(5)
    for low, high in ((0, 50), (-(2**40), 2**40), (0, 2**62), (-70000, -5)):
        values = [rng.randint(low, high) for _ in range(300)] + [None]
        df = spark.createDataFrame([(v,) for v in values], "v long")
        ordered = sorted(v for v in values if v is not None)
        for k in (1, 2, 150, 299, 300):
            assert kth_smallest(df, "v", k) == ordered[k - 1]
        assert kth_smallest(df, "v", 1000) == ordered[-1]
    assert kth_smallest(df, "v", 0) is None
    assert kth_smallest(df.where("v > 0"), "v", 3) is None


def rows(spark):
    # One split holds nearly everything; another has fewer rows than a preview.
    data = [(i * 7 % 1000, "train", "a") for i in range(1000)] + [(2000, "test", "a"), (2001, "test", "b")]
    return spark.createDataFrame(data, "id long, split string, dataset string")


def test_preview_keeps_lowest_ids_of_each_split(spark):
    kept = {tuple(r) for r in preview_head(rows(spark)).select("split", "id").collect()}
    assert kept == {("train", i) for i in range(4)} | {("test", 2000), ("test", 2001)}


def test_train_cap_touches_train_only(spark):
    for cap in (0, 1, 500, 5000):
        kept = train_cap(rows(spark), cap).groupBy("split").agg(F.count("*"), F.max("id")).collect()
        found = {r[0]: (r[1], r[2]) for r in kept}
        assert found["test"] == (2, 2001)
        assert found.get("train") == ((min(cap, 1000), min(cap, 1000) - 1) if cap else None)
    assert train_cap(rows(spark), "max").count() == 1002


def test_sample_is_repeatable_and_one_per_group(spark):
    a, b = (sample_one(rows(spark).repartition(n), "s").orderBy("dataset").collect() for n in (1, 7))
    assert a == b and [r["dataset"] for r in a] == ["a", "b"]
    others = {sample_one(rows(spark), s).where("dataset = 'a'").first()["id"] for s in "qwertz"}
    assert len(others) > 1


def test_ties_and_null_splits(spark):
    data = [(1, "train"), (1, "train"), (1, "train"), (2, "train"), (5, None), (5, None), (6, "test"), (None, "test")]
    df = spark.createDataFrame(data, "id long, split string")
    for cap, want in ((1, 1), (2, 2), (3, 3), (4, 4)):
        kept = train_cap(df, cap).groupBy("split").count().collect()
        assert {r["split"]: r["count"] for r in kept} == {"train": want, None: 2, "test": 2}
    kept = preview_head(df, 2).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in kept} == {"train": 2, None: 2, "test": 1}


def test_many_groups_are_joined(spark, monkeypatch):
    from gistworks.operators import selection

    few = sorted(map(tuple, preview_head(rows(spark)).collect())), sorted(map(tuple, sample_one(rows(spark), "s").collect()))
    monkeypatch.setattr(selection, "FEW_GROUPS", 1)
    assert (sorted(map(tuple, preview_head(rows(spark)).collect())), sorted(map(tuple, sample_one(rows(spark), "s").collect()))) == few


def test_bounds_reach_the_scan(spark, tmp_path, plan_of):
    path = str(tmp_path / "t")
    rows(spark).write.parquet(path)
    stored = spark.read.parquet(path)
    for df in (preview_head(stored), sample_one(stored, "s")):
        pushed = plan_of(df).split("PushedFilters: [")[1].split("]")[0]
        assert "LessThanOrEqual(id" in pushed or "EqualTo(id" in pushed
