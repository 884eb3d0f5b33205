"""Corpora through the data source: files opened, columns read, filters taken."""

import pytest
from gistworks.sources import datasource
from gistworks.sources.corpus import REGISTRY


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpora"))
    rows = [(k, ("train", "test")[k % 2], f"text {k} é", None if k == 3 else f"sum {k}", "unused") for k in range(20)]
    for name in ("arxiv", "govreport"):
        spec = REGISTRY[name]
        theirs = {ours: n for n, ours in spec.columns.items()}
        frame = spark.createDataFrame(rows, f"id long, split string, {theirs['text']} string, {theirs.get('summary', 'summary')} string, dataset string")
        frame.repartition(2).write.partitionBy("split").parquet(f"{at}/{spec.name}/{spec.subset}")
    datasource.register(spark)
    return f"file://{at}"


def load(spark, root, **options):
    return spark.read.format("corpus").options(path=root, **options).load()


def test_all_rows_in_one_schema(spark, root):
    got = {tuple(r) for r in load(spark, root, batch=3).collect()}
    want = {(k, name, ("train", "test")[k % 2], f"text {k} é", None if k == 3 else f"sum {k}") for k in range(20) for name in ("arxiv", "govreport")}
    assert got == want


def test_one_split_opens_its_files_alone(spark, root):
    assert load(spark, root).rdd.getNumPartitions() == 8
    one = load(spark, root, dataset="arxiv", split="test")
    assert one.rdd.getNumPartitions() == 2
    assert sorted(r["id"] for r in one.where("id > 4").collect()) == list(range(5, 20, 2))


def test_filters_do_not_stay_with_the_frame(spark, root):
    read = load(spark, root)
    for condition, n in (("split = 'test' and dataset = 'arxiv'", 10), ("split in ('train', 'validation')", 20), ("split = 'test' and split = 'train'", 0), ("split = 'test' or id = 0", 22), ("true", 40)):
        assert read.where(condition).count() == n


def test_options(spark, root):
    assert {r["dataset"] for r in load(spark, root, dataset="govreport", split="test").collect()} == {"govreport"}
    assert load(spark, root, dataset="pubmed").count() == 0
    with pytest.raises(Exception, match="unknown corpus"):
        load(spark, root, dataset="nosuch").collect()
    with pytest.raises(Exception, match="path is needed"):
        spark.read.format("corpus").load().collect()


def test_a_missing_column_fails(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, text string").write.parquet(f"{tmp_path}/arxiv/document/split=test")
    datasource.register(spark)
    with pytest.raises(Exception, match="lacks columns"):
        load(spark, f"file://{tmp_path}", dataset="arxiv").collect()
