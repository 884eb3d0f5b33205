"""Functions over texts see bounded parts of a batch."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gistworks.functions import tokenizer as tk
from gistworks.functions.batches import PART_BYTES, frame_parts, parts
from gistworks.operators import hooks, vocab


def test_parts_are_the_batch_in_order_and_bounded():
    draw = random.Random(3)
    texts = [None if draw.random() < 0.1 else "é" * draw.randint(0, 300) for _ in range(400)] + ["x" * 9000, "y"]
    lists = [None if t is None else list(range(len(t))) for t in texts]
    pairs = [{"text": t, "ends": e} for t, e in zip(texts, lists)]
    for values, each in ((texts, 600), (lists, 2400), (pairs, 3000)):
        array = pa.array(values)
        cut = list(parts(array.slice(7), 5000))
        assert [v for p in cut for v in p.to_pylist()] == values[7:] and len(cut) > 10
        assert all(p.nbytes <= 5000 + 2 * each + 100 for p in cut if len(p) > 1 and not any(v in (values[-2], values[-1]) for v in p.to_pylist()))
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": texts})
    assert pa.Table.from_batches(parts(batch, 5000)) == pa.Table.from_batches([batch])
    assert list(parts(pa.array([], pa.string()))) == []
    frame = pd.DataFrame({"n": range(len(texts)), "text": texts})
    cut = list(frame_parts(frame, 5000))
    assert pd.concat(cut).equals(frame) and len(cut) > 10 and len(list(frame_parts(frame[:0]))) == 1


def test_a_users_functions_see_bounded_parts(spark):
    df = spark.range(900).select("id", F.repeat(F.lit("word "), 1000).alias("text")).coalesce(1)

    def told():
        return lambda texts: [[(0, 0, str(sum(map(len, texts))))] for _ in texts]

    seen = df.select(tk.batch_tokenizer(told).tokens(F.col("text"))[0].cast("long").alias("n"))
    assert seen.agg(F.max("n")).first()[0] <= PART_BYTES + 5000 < 900 * 5000

    def batch(rows):
        return {"id": rows["id"], "n": [sum(map(len, rows["text"]))] * len(rows["id"])}

    got = hooks.map_batches(df, batch, "id long, n long", ("id", "text"))
    assert got.agg(F.max("n")).first()[0] <= PART_BYTES + 5000 and got.count() == 900


def test_decoding_over_many_parts(spark):
    words = spark.createDataFrame([(f"t{k}", 3 + k) for k in range(50)], "token string, token_id int")
    ids = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda x: ((x * F.col("id")) % 53).cast("int"))
    df = spark.range(1500).select("id", F.when(F.col("id") % 97 != 0, ids).alias("ids")).coalesce(1)
    for r in vocab.decode_ids(df, words, "ids").collect():
        want = "" if r["id"] % 97 == 0 else " ".join(f"t{i - 3}" for i in ((x * r["id"]) % 53 for x in range(1000)) if i >= 3)
        assert r["text"] == want
