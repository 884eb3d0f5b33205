"""The Merkle manifest against a plain tree, and its queue."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gistworks.llm import merkle, queries
from gistworks.llm.queues import MessageQueue

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at long, size long, digest string, part int, proof string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def layers(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def path(made, at):
    steps = []
    for nodes in made[:-1]:
        start = at // 16 * 16
        steps.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 16])))
        at //= 16
    return steps


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0], leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: layers([leaf(r) for r in groups[s]]) for s in names}
    top = layers([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            steps = path(trees[s], at) + path(top, k)
            digest = trees[s][0][at]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                digest = leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4])))
            for a, b in steps:
                digest = sha(a, digest, b)
            out.append((r[0], trees[s][0][at], trees[s][-1][0], top[-1][0], sha(*(a + b for a, b in steps)), digest, digest == top[-1][0]))
    return out


def rows_of(seed, n):
    draw = random.Random(seed)
    some = [(draw.choice([None, k, k, k, 7]), draw.choice([None, "", "hot", "hot", "hot", "é", "Z", "z"]), "en", draw.choice([None, 3]), draw.choice([None, "", f"Text {k} É", "Ab"])) for k in range(n)]
    return some + some[: n // 9]


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_query(spark, tmp_path, n):
    rows = rows_of(n, n)
    frame = spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)


def test_one_large_tree_in_several_rounds(spark):
    rows = [(k, "s", None, None, None) for k in range(256 * 17)]
    frame = spark.createDataFrame([(*r, *[None] * 6) for r in rows], SCHEMA)
    made, root = merkle.manifest(frame, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", keep={"doc_id": "doc_id"})
    want = layers([leaf(r) for r in rows])
    assert root == want[-1][0] == layers([want[-1][0]])[-1][0]
    checked = made.withColumn("led_to", merkle.fold(F.col("leaf"), F.col("proof")))
    assert checked.where(F.col("led_to") == root).count() == len(rows)
    proof = checked.where("doc_id = 4351").first()["proof"]
    assert [(s["left"], s["right"]) for s in proof] == path(want, 4351)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op11_merkle(spark, str(tmp_path))
    assert made.columns[:3] == ["doc_id", "leaf", "subroot"] and not made.count()


@pytest.mark.parametrize("limit", [1, 2, 7, 1000])
def test_queue_spills(limit):
    draw, queue, held = random.Random(limit), MessageQueue(limit), []
    for step in range(3000):
        if held and draw.random() < 0.45:
            held.sort()
            assert queue.receive() == held.pop(0)
        else:
            entry = ((draw.randrange(50), step), draw.random())
            queue.send(*entry)
            held.append(entry)
    assert [queue.receive() for _ in range(len(held))] == sorted(held) and not queue
    assert bool(queue.spilled) == (limit < 100)


@pytest.mark.parametrize("size", [2, 16, 17, 255, 256, 300])
def test_sweeps_with_a_small_queue(size):
    leaves = [sha(str(k)) for k in range(min(size, 256))]
    root, log = merkle.sweep_up(MessageQueue(2), 0, leaves, size)
    made = layers(leaves)
    want = made[-1][0] if size <= 256 else layers(leaves)[2][0]
    assert root == want
    proofs = dict(merkle.sweep_down(MessageQueue(2), log, len(leaves), merkle.levels_of(size), []))
    assert sorted(proofs) == list(range(len(leaves)))
    assert all(proofs[k] == path(made, k)[: merkle.levels_of(size)] for k in proofs)
