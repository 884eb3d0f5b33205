"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib

import pytest

from gistworks.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, at string, part string, pos string, depth string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children, out = {}, []
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own_saved + sum(saved[x] for x in children.get(path, []))
        leaves[path] = sum(leaves[x] for x in children.get(path, [])) or 1
        ends = ",".join(str(c) for c in sorted(c for c in nodes[path] if len(whole[c]) == len(path)))
        up = min(nodes[path[:-1]]) if path else None
        out.append((min(nodes[path]), len(path), up, len(nodes[path]), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed, n, depth, kinds):
    draw = random.Random(seed)
    rows, common = [], [("user", f"{k % kinds} é") for k in range(depth)]
    for c in draw.sample(range(0, 3 * n), n):
        m = min(draw.choice([1, 2, 3, 6, depth]), depth)
        like = draw.random() < 0.5
        for k in range(m):
            role, text = common[k] if like and draw.random() < 0.98 else (draw.choice(["user", "assistant", None]), draw.choice([None, "", "a", "bb", "😀"]))
            rows.append((c, draw.choice([k, k, k, k, None]) if m < 4 else k, role, text))
    return rows + rows[: len(rows) // 20] + [(None, 1, "user", "x"), (None, None, None, None)]


def got(spark, rows, chunk, parts=3):
    frame = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(parts)
    turns, _ = prefixes.numbered(frame)
    from pyspark.sql import functions as F

    made = prefixes.trie(*prefixes.rebuilt(turns, lambda c: c - c % 100, lambda c: F.crc32(c.cast("string")) % 6), chunk)
    return sorted(map(tuple, made.collect()), key=repr)


@pytest.mark.parametrize("seed, n, depth, kinds, chunk", [(1, 1, 4, 2, 1), (2, 60, 8, 3, 4), (3, 150, 10, 1, 7), (4, 40, 200, 5, 1), (5, 30, 140, 1, 1000), (6, 300, 5, 2, 32)])
def test_trie(spark, seed, n, depth, kinds, chunk):
    rows = conversations(seed, n, depth, kinds)
    assert got(spark, rows, chunk) == sorted(plain(rows), key=repr)


def test_copies_across_chunks(spark):
    rows = [(c, k, "user", "same") for c in range(90) for k in range(1 + (c % 7 == 0))] + [(c, 0, "user", f"own {c % 5}") for c in range(200, 260)]
    assert got(spark, rows, 5) == sorted(plain(rows), key=repr)


def test_query_and_empty_tables(spark, tmp_path):
    rows = conversations(9, 50, 6, 2)
    spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, f"{tmp_path}/a").collect()), key=repr) == sorted(plain(rows), key=repr)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert queries.op13_prefix_trie(spark, f"{tmp_path}/b").collect() == []


def test_extents_are_those_of_a_scan():
    draw = random.Random(3)
    keys = sorted(b"".join(draw.choice([b"a", b"b"]) * prefixes.WIDTH for _ in range(draw.randint(0, 6))) for _ in range(80))
    chunk = prefixes.Chunk([(k, len(x) // prefixes.WIDTH, x, [1] * (len(x) // prefixes.WIDTH)) for k, x in enumerate(keys)])
    for i, d, left, right in zip(*(x.tolist() for x in chunk.extents())):
        holds = [k for k, x in enumerate(keys) if x[: d * prefixes.WIDTH] == keys[i][: d * prefixes.WIDTH] and len(x) >= d * prefixes.WIDTH]
        assert (left, right) == (holds[0], holds[-1])
