import pytest

from gistworks.operators import generate as g


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "id long, text string").repartition(3)


def failing(ids, answer="ok"):
    """Fails for a batch that holds any of the given rows."""
    bad = {f"text number {i}" for i in ids}

    def make():
        def predict(batch):
            if bad & set(batch):
                raise RuntimeError("out of memory")
            return [f"{answer} {t}" for t in batch]

        return predict

    return make


def test_batches_are_bounded_and_complete(spark, texts):
    def make():
        return lambda batch: [str(len(batch))] * len(batch)

    rows = g.generate_batched(texts, make, batch_size=7).collect()
    assert sorted(r["id"] for r in rows) == list(range(50))
    assert max(int(r["prediction"]) for r in rows) <= 7


def test_predictor_is_made_once_per_task(spark, texts):
    def make():
        seen = []

        def predict(batch):
            seen.extend(batch)
            return [str(len(seen))] * len(batch)

        return predict

    rows = g.generate_batched(texts.coalesce(1), make, batch_size=10).collect()
    assert max(int(r["prediction"]) for r in rows) == 50


def test_an_error_fails_the_plain_form(texts):
    with pytest.raises(Exception, match="out of memory"):
        g.generate_batched(texts, failing([3])).collect()
    with pytest.raises(Exception, match="outputs for"):
        g.generate_batched(texts, lambda: lambda batch: batch[:-1]).collect()


def test_only_rows_at_fault_are_marked(texts):
    rows = {r["id"]: r for r in g.generate_attempts(texts, failing([3, 4, 40]), 1, batch_size=8).collect()}
    assert {i for i, r in rows.items() if not r["ok"]} == {3, 4, 40}
    assert rows[3]["error"] == "RuntimeError: out of memory" and rows[3]["output"] is None
    assert rows[5]["output"] == "ok text number 5" and rows[5]["error"] is None and rows[5]["attempt"] == 1


def test_two_passes_keep_every_id(texts):
    merged = {r["id"]: r for r in g.generate_resumable(texts, [failing([3, 4, 40]), failing([4], "again")]).collect()}
    assert merged.keys() == set(range(50))
    assert merged[3]["output"] == "again text number 3" and merged[3]["attempt"] == 2
    assert not merged[4]["ok"] and merged[4]["attempt"] == 2 and merged[5]["attempt"] == 1


def test_merge_prefers_success_then_the_latest(spark):
    log = spark.createDataFrame(
        [(1, 1, True, "a"), (1, 2, True, "b"), (1, 3, False, None), (2, 1, False, None), (2, 2, False, None)],
        "id long, attempt int, ok boolean, output string",
    )
    merged = {r["id"]: tuple(r)[1:] for r in g.retry_merge(spark.range(1, 4), log).collect()}
    assert merged == {1: (2, True, "b"), 2: (2, False, None), 3: (None, None, None)}


def test_subsets(spark, texts):
    log = g.generate_attempts(texts, failing([1, 2]), 1).unionByName(g.generate_attempts(texts.where("id = 1"), failing([]), 2))
    assert {r["id"] for r in g.failed_subset(texts, log).collect()} == {1, 2}
    assert {r["id"] for r in g.pending_subset(texts, log).collect()} == {2}
    assert g.pending_subset(texts, log.limit(0)).count() == 50


def test_keys_of_any_type(spark):
    df = spark.createDataFrame([("r", 1, "a b c")], "run string, id int, text string")
    out = g.generate_batched(df, g.lead_predictor(2), keys=("run", "id"))
    assert tuple(out.first()) == ("r", 1, "a b")


def test_a_second_job_asks_only_what_is_open(spark, texts, tmp_path):
    log = str(tmp_path / "log")
    first = g.generate_resumable(texts, [failing([3, 4])], log_path=log)
    assert {r["id"] for r in first.where("not ok").collect()} == {3, 4}

    def only_open():
        def predict(batch):
            if not set(batch) <= {r["text"] for r in wanted}:
                raise RuntimeError("asked again")
            return ["late"] * len(batch)

        return predict

    wanted = texts.where("id in (3, 4)").collect()
    again = {r["id"]: r for r in g.generate_resumable(texts, [only_open], log_path=log).collect()}
    assert all(r["ok"] for r in again.values()) and again[3]["attempt"] == 2 and again[5]["attempt"] == 1
