"""Numbered rows, outputs aligned by place, and logs under any split of their files."""

import random

import pytest
from pyspark.sql import functions as F

from gistworks.operators import positions
from gistworks.sources import predlog


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_have_no_gaps(spark, parts):
    draw = random.Random(parts)
    # One group holds most rows; orders repeat; nulls are a group and come first.
    rows = [(draw.choice(["hot", "hot", "hot", "b", None]), draw.choice([None, *range(40)]), k) for k in range(600)]
    frame = spark.createDataFrame(rows, "g string, o long, k long").repartition(parts)
    got = positions.number_rows(frame, ["g"], ["o"]).collect()
    assert len(got) == 600 and sorted(r["k"] for r in got) == list(range(600))
    for g in ("hot", "b", None):
        own = sorted((r["position"], r["o"]) for r in got if r["g"] == g)
        assert [p for p, _ in own] == list(range(len(own)))
        order = [(o is not None, o or 0) for _, o in own]
        assert order == sorted(order)
    assert positions.number_rows(frame.limit(0), ["g"], ["o"]).count() == 0


def test_no_window_over_whole_groups(spark, plan_of):
    frame = spark.range(100).withColumn("g", F.lit("a"))
    plan = plan_of(positions.number_rows(frame, ["g"], ["id"]))
    # Windows run over the counts of tasks alone.
    assert "SinglePartition" not in plan and "row_number" not in plan


def test_runs_of_another_length_are_reported_and_left_out(spark):
    references = spark.createDataFrame([("x", 5, "e"), ("x", 2, "b"), ("x", 9, "i"), ("y", 1, "a")], "dataset string, id long, summary string")
    rows = [("r", "x", 0, "B"), ("r", "x", 1, "E"), ("r", "x", 2, "I"), ("s", "x", 0, "B"), ("s", "y", 0, "A"), ("t", "z", 0, "?")]
    outputs = spark.createDataFrame(rows, "run_id string, dataset string, position int, prediction string")
    pairs, report = positions.align_positions(outputs, references)
    assert {tuple(r) for r in pairs.collect()} == {("r", "x", 2, "B", "b"), ("r", "x", 5, "E", "e"), ("r", "x", 9, "I", "i"), ("s", "y", 1, "A", "a")}
    assert {tuple(r) for r in report.collect()} == {("r", "x", 3, 3, True), ("s", "x", 1, 3, False), ("s", "y", 1, 1, True), ("t", "z", 1, 0, False)}


@pytest.mark.parametrize("split", ["100", "1000", "128m"])
def test_logs_are_scanned_once_whatever_the_splits(spark, tmp_path, plan_of, split):
    logs = {"a-arxiv": "\n".join(f"line {k} {'x' * (k % 90)}" for k in range(300)) + "\n", "b-pubmed": '["one", "two"]', "c": "only\n"}
    for name, body in logs.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.out").write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        scanned = predlog.scan_logs(spark, str(tmp_path))
        assert "FileScan text" not in plan_of(scanned)
        # Another split after the scan changes nothing.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = {}
        for r in scanned.collect():
            got.setdefault(r["folder"], {})[r["position"]] = r["prediction"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"a-arxiv": dict(enumerate(logs["a-arxiv"].splitlines())), "b-pubmed": {0: "one", 1: "two"}, "c": {0: "only"}}
