import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gistworks.operators.leaderboard import best_checkpoint, leaderboard, rouge_avg, rouge_geo_mean
from gistworks.sources import predlog, runs, sinks

SCORES = {"rouge1": 0.4, "rouge2": 0.1, "rougeL": 0.25, "rougeLsum": 0.3}


@pytest.fixture
def folders(tmp_path):
    shapes = {"bart-arxiv": SCORES, "a+b c-pubmed-4096-15062023193353": {"rouge": {**SCORES, "rouge1": 0.5}}}
    for name, scores in shapes.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metrics.json").write_text(json.dumps(scores, indent=1))
    (tmp_path / "unfinished").mkdir()
    return str(tmp_path)


def test_runs_of_both_shapes(spark, folders):
    found = {r["folder"]: r for r in runs.scan_runs(spark, folders).collect()}
    assert found.keys() == {"bart-arxiv", "a+b c-pubmed-4096-15062023193353"}
    assert [found["bart-arxiv"][v] for v in runs.VARIANTS] == list(SCORES.values())
    assert found["a+b c-pubmed-4096-15062023193353"]["rouge1"] == 0.5


def test_leaderboard(spark, folders):
    board = leaderboard(runs.scan_runs(spark, folders)).collect()
    assert [r["Folder"] for r in board] == ["a+b c-pubmed-4096-15062023193353", "bart-arxiv"]
    assert board[1]["RougeAvg"] == pytest.approx(0.25)
    scaled = rouge_geo_mean(rouge_avg(runs.scan_runs(spark, folders))).where("Folder = 'bart-arxiv'").first()
    assert scaled["geo_mean"] == pytest.approx(100 * 0.01 ** (1 / 3)) and scaled["Rouge1"] == pytest.approx(40)


def test_best_checkpoint(spark):
    log = [(1, 100, 0.2), (1, 200, 0.3), (1, 300, 0.3), (2, 100, None), (2, 200, None), (3, 7, 0.0), (3, 8, None)]
    df = spark.createDataFrame(log, "run_id int, step long, eval_rouge1 double")
    assert {tuple(r) for r in best_checkpoint(df).collect()} == {(1, 200, 0.3), (2, 200, None), (3, 7, 0.0)}


PREDICTIONS = ['plain', 'with "quotes" and \\ slash', "two\nlines", "", "  blanks  ", "ünï"]
LINES = ["first", "", "[not json", '["a json line"]', "", "last"]


@pytest.fixture
def logs(tmp_path):
    texts = {
        "r1-arxiv": json.dumps(PREDICTIONS),
        "r2-pubmed": "".join(x + "\n" for x in LINES),
        "r3-x": "only one line\n",
        "r4-arxiv": "\n".join(str(i) * 30 for i in range(2000)),
    }
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.out").write_text(text)
    return str(tmp_path), texts


WANT = {
    "r1-arxiv": PREDICTIONS,
    "r2-pubmed": LINES,
    "r3-x": ["only one line"],
    "r4-arxiv": [str(i) * 30 for i in range(2000)],
}


def collected(df):
    out = {}
    for r in df.orderBy("folder", "position").collect():
        out.setdefault(r["folder"], []).append((r["position"], r["prediction"]))
    return out


def test_logs_as_strings(spark, logs):
    df = spark.createDataFrame(list(logs[1].items()), "folder string, content string")
    assert collected(predlog.parse_logs(df)) == {k: list(enumerate(v)) for k, v in WANT.items()}


@pytest.mark.parametrize("split", ["4096", "134217728"])
def test_logs_as_files_of_many_blocks(spark, logs, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = predlog.scan_logs(spark, logs[0])
        assert collected(df) == {k: list(enumerate(v)) for k, v in WANT.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_routing_and_counts(spark, logs):
    counted = predlog.logs_by_corpus(predlog.scan_logs(spark, logs[0])).collect()
    assert {tuple(r) for r in counted} == {("arxiv", 2, 2006), ("pubmed", 1, 6), ("govreport", 1, 1)}


def tasks_of(spark, group, run):
    """What ``run`` gives, and the tasks of all its jobs' stages."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        result = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
    return result, sum(status.getStageInfo(s).numTasks for s in stages)


def test_many_small_logs_are_listed_and_read_in_few_tasks(spark, tmp_path):
    root = str(tmp_path / "logs")
    contents = spark.range(200).select(F.format_string("run%d-arxiv", "id").alias("folder"), F.lit("a\nb\n").alias("content"))
    runs.write_folders(contents, root)
    before = {k: spark.conf.get(k) for k in ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.files.openCostInBytes")}
    scanned, tasks = tasks_of(spark, "small logs", lambda: predlog.scan_logs(spark, root, "*/part-*"))
    assert scanned.count() == 400 and tasks <= 8 * spark.sparkContext.defaultParallelism
    assert before == {k: spark.conf.get(k) for k in before}


def tree(root):
    """Lines of each folder that is not hidden."""
    return {d.name: sorted(x for f in d.glob("part-*") for x in f.read_bytes().splitlines()) for d in Path(root).iterdir() if d.is_dir()}


def test_folders_are_those_of_a_partitioned_write(spark, tmp_path):
    names = ["a b+c", 'x"#%\'*/:=?\\{}[]^~', "tab\there", "1-arxiv", "1-arxiv", "ünï", None, "", "__HIVE_DEFAULT", "run=run", "z" * 200, "\x7f|<>"]
    data = [(n, None if i == 3 else f"line {i}\nü{i}\n") for i, n in enumerate(names)]
    df = spark.createDataFrame(data, "folder string, content string").repartition(3)
    runs.write_folders(df, str(tmp_path / "ours"))
    plain = df.select(F.col("folder").alias("run"), F.regexp_replace("content", "\n\\z", "").alias("value"))
    plain.write.partitionBy("run").text(str(tmp_path / "spark"))
    assert tree(tmp_path / "ours") == tree(tmp_path / "spark")
    # One file and nothing beside it where a task had one run of a name.
    assert [f.name.endswith(".txt") for f in (tmp_path / "ours" / "run=a b+c").iterdir()] == [True]
    with pytest.raises(Exception, match="exists"):
        runs.write_folders(df, str(tmp_path / "ours"))


def test_empty_and_default_names_share_a_folder(spark, tmp_path):
    data = [(None, "a"), ("__HIVE_DEFAULT_PARTITION__", "b"), ("", "c"), ("A", "d")]
    runs.write_folders(spark.createDataFrame(data, "folder string, content string").coalesce(1), str(tmp_path / "o"))
    assert tree(tmp_path / "o") == {"run=__HIVE_DEFAULT_PARTITION__": [b"a", b"b", b"c"], "run=A": [b"d"]}


def test_predictions_survive_storage(spark, tmp_path):
    data = [(i, p, run) for run in ("0613", "a/b=c") for i, p in enumerate([*PREDICTIONS, None])]
    df = spark.createDataFrame(data, "id long, prediction string, run_id string")
    sinks.write_predictions(df, str(tmp_path / "p"))
    back = sinks.read_predictions(spark, str(tmp_path / "p"))
    assert sorted(map(repr, back.select("id", "prediction", "run_id").collect())) == sorted(map(repr, df.collect()))
    one = back.where("run_id = '0613'")
    assert "PartitionFilters: [isnotnull(run_id" in one._jdf.queryExecution().executedPlan().toString()


def test_scores_and_board_survive_storage(spark, folders, tmp_path):
    scores = runs.scan_runs(spark, folders)
    sinks.write_metrics(scores, str(tmp_path / "m"))
    assert sinks.read_metrics(spark, str(tmp_path / "m")).exceptAll(scores).count() == 0
    board = leaderboard(scores)
    sinks.write_leaderboard(board, str(tmp_path / "b"))
    assert sinks.read_leaderboard(spark, str(tmp_path / "b")).exceptAll(board).count() == 0
