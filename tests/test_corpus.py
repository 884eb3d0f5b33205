import uuid

import pytest

from gistworks.operators.admission import admissible, admission_audit, admit, drop_reason, fits_context
from gistworks.sources import corpus
from pyspark.sql import functions as F


@pytest.fixture
def stored(spark, tmp_path):
    """An arxiv and a govreport corpus as their sources store them."""
    text = "alpha beta gamma delta " * 8
    data = [(i, s, f"{text}{i}", f"short summary {i}") for s in ("train", "validation", "test") for i in range(6)]
    ids = [(n, *row[1:]) for n, row in enumerate(data)]
    df = spark.createDataFrame(ids, "id long, split string, article string, abstract string")
    root = str(tmp_path / uuid.uuid4().hex)
    df.write.partitionBy("split").parquet(f"{root}/arxiv/document")
    gov = df.withColumnsRenamed({"article": "report", "abstract": "summary"})
    gov.write.partitionBy("split").parquet(f"{root}/govreport/document")
    return corpus.parquet_reader(spark, root)


def test_load_renames_limits_and_filters(spark, stored):
    full = corpus.load_corpus("arxiv", stored)
    assert full.columns == list(corpus.COLUMNS) and full.count() == 18
    assert corpus.load_corpus("govreport", stored).where("dataset = 'govreport'").count() == 18
    preview = corpus.load_corpus("arxiv", stored, preview=True, samples=1)
    assert preview.groupBy("split").count().select("count").distinct().collect()[0][0] == 4
    capped = corpus.load_corpus("arxiv", stored, samples=2)
    assert capped.where("split = 'train'").count() == 2 and capped.count() == 14
    assert corpus.load_corpus("arxiv", stored, min_input_size=10_000).count() == 0


def test_limits_run_before_the_filter(spark, stored):
    # Two of the first four train rows are dropped by the filter; none takes their place.
    def reader(spec):
        raw = stored(spec)
        return raw.withColumn("abstract", F.when(F.col("id").isin(0, 1), F.lit("")).otherwise(F.col("abstract")))

    assert corpus.get_split(corpus.load_corpus("arxiv", reader, preview=True), "train").count() == 2


def test_hook_replaces_the_filter(spark, stored):
    kept = corpus.load_corpus("arxiv", stored, preprocess=lambda df: df.where("id = 3"))
    assert [r["id"] for r in kept.collect()] == [3]


def test_unknown_names_and_missing_columns_fail(spark, stored):
    with pytest.raises(ValueError, match="unknown corpus"):
        corpus.load_corpus("wiki", stored)
    with pytest.raises(ValueError, match="abstract"):
        corpus.standardize(spark.range(1).selectExpr("id", "'t' split", "'x' article"), corpus.corpus_spec("arxiv"))


def test_split_prunes_partitions(spark, stored, plan_of):
    plan = plan_of(corpus.get_split(corpus.load_corpus("arxiv", stored), "test"))
    assert "PartitionFilters: [isnotnull(split" in plan


def test_written_corpus_reads_back(spark, stored, tmp_path):
    both = corpus.union_corpora(stored, ("arxiv", "govreport"))
    corpus.write_corpus(both, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*corpus.COLUMNS).exceptAll(both).count() == 0 and back.count() == both.count()


CASES = [
    # text, summary, minimum, reason
    ("x" * 21, "y" * 10, 0, None),
    ("x" * 20, "y" * 10, 0, "too_short_ratio"),
    ("x" * 999, "y", 0, None),
    ("x" * 1000, "y", 0, "too_long_ratio"),
    ("abc def ghi", "def", 0, "verbatim"),
    ("abc def ghi", "DEF", 0, None),
    ("abc def ghi", "zzz", 11, None),
    ("abc def ghi", "zzz", 12, "below_min"),
    ("abc", "", 0, "empty"),
    (None, "abc", 0, "null"),
    ("abc", None, 0, "null"),
    ("ééééé", "ü", 5, None),
]


def test_admission_rules(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "id int, text string, summary string, m int, r string")
    for row in df.collect():
        one = df.where(F.col("id") == row["id"])
        text, summary = F.col("text"), F.col("summary")
        reason = one.select(drop_reason(text, summary, row["m"])).first()[0]
        assert reason == row["r"], row
        assert one.where(admissible(text, summary, row["m"])).count() == (row["r"] is None)


def test_audit_adds_up(spark):
    df = spark.createDataFrame([("d", "s", *c[:2]) for c in CASES], "dataset string, split string, text string, summary string")
    audit = admission_audit(df).first().asDict()
    assert audit["rows_in"] == len(CASES) and audit["rows_in"] - audit["rows_dropped"] == admit(df).count()
    assert sum(v for k, v in audit.items() if k.startswith("n_")) == audit["rows_dropped"]


def test_context_is_strict_and_optional(spark):
    df = spark.createDataFrame([("a b c ", "d"), ("a b", " c")], "text string, summary string")
    assert fits_context(df, 8, 2).count() == 1
    for off in (False, None, 0):
        assert fits_context(df, 1, off).count() == 2
