"""Induced sorting and removal of repeated strings against plain definitions."""

import hashlib
import random

import numpy as np
import pytest

from gistworks.llm import induced, queries, repeats

from .conftest import CLASHING, HARD, SCHEMA, prose


def plain(rows, width=50):
    first = {}
    key = lambda i: (i is not None, i or 0)
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, b in coded:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w not in first or key(i) < first[w]:
                first[w] = key(i)
    out = []
    for i, b in coded:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < key(i):
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n):
    draw = random.Random(seed)
    shared = [prose(k, 12 + 5 * k) for k in range(6)]
    out = []
    for k in range(n):
        parts = [prose(draw.randrange(10**6), draw.randint(0, 25)) for _ in range(3)]
        for _ in range(draw.randint(0, 3)):
            parts.insert(draw.randrange(len(parts)), draw.choice([*shared, "x" * draw.choice([49, 50, 51, 300]), "é" * 40, "la " * draw.randint(10, 60)]))
        out.append((draw.choice([None, k, k, k, k, 3, -k]), draw.choice([None, "", " "]) if draw.random() < 0.1 else draw.choice(["", " ", "\n"]).join(parts)))
    return out + out[: n // 8] + [(1000 + k, out[5][1]) for k in range(n // 6)]


@pytest.mark.parametrize("seed, block, shard", [(1, 8 << 20, 16 << 20), (2, 300, 200), (3, 2000, 100_000)])
def test_removed(make_docs, seed, block, shard):
    rows = texts(seed, 90)
    made = repeats.remove_repeats(make_docs(rows).repartition(4), form="digest", block_bytes=block, shard_bytes=shard)
    assert sorted(map(tuple, made.collect()), key=repr) == plain(rows)


def test_another_width_and_spans(make_docs):
    rows = texts(4, 40)
    made = repeats.remove_repeats(make_docs(rows), 33, form="kept").collect()
    got = [(r.doc_id, sum(s.end - s.begin for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in made]
    assert sorted(got, key=repr) == sorted(((i, n, s, h) for i, _, n, s, h in plain(rows, 33)), key=repr)


def test_query_and_hard_rows(spark, make_docs, none, tmp_path):
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in HARD] + [(11, "the " * 200), (12, "x" * 120 + prose(1, 30))]
    make_docs(rows).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op12_repeats(spark, str(tmp_path)).collect()), key=repr) == plain(rows)
    assert repeats.remove_repeats(none, form="digest").count() == 0
    assert CLASHING and SCHEMA  # tables carry columns of clashing names


def test_identifiers_must_be_integers(spark):
    with pytest.raises(TypeError):
        repeats.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_stretches_cover_each_window_once():
    draw = random.Random(5)
    parts = [bytes(draw.choice(b"ab") for _ in range(draw.choice([0, 10, 49, 50, 51, 400, 9000]))) if draw.random() < 0.7 else b"z" * 9000 for _ in range(40)]
    joined, lengths = b"".join(parts), np.array([len(p) for p in parts])
    start, windows, value, text = repeats.stretches(joined, lengths, 50)
    want = [e - n + k for e, n in zip(np.cumsum(lengths).tolist(), lengths.tolist()) for k in range(n - 49)]
    assert [s + k for s, w in zip(start.tolist(), windows.tolist()) for k in range(w)] == want
    known = {}
    for s, w, v in zip(start.tolist(), windows.tolist(), value.tolist()):
        for k in range(s, s + w):
            assert known.setdefault(joined[k : k + 50], v) == v


# Induced sorting.


@pytest.mark.parametrize("seed", range(25))
def test_order_and_prefixes(seed):
    draw = random.Random(seed)
    for _ in range(6):
        n, kinds, cap = draw.choice([1, 2, 5, 60, 400]), draw.choice([1, 2, 3, 20]), draw.choice([4, 50])
        symbols = [draw.randint(1, kinds) for _ in range(n)]
        if draw.random() < 0.5:
            symbols = (symbols[: draw.randint(1, 30)] * 20)[:n] + symbols
        text = induced.Text.of(np.array(symbols, np.int16))
        full = [*symbols, 0]
        streams = induced.sorted_with_prefixes(text, cap, draw.choice([1, 16, 10_000]), draw.choice([1, 7, 1000]))
        assert sorted(p for pos, _ in streams for p in pos.tolist()) == list(range(len(symbols)))
        for (pos, lcp), sign in zip(streams, (1, -1)):
            for k in range(1, len(pos)):
                a, b = full[pos[k - 1] :], full[pos[k] :]
                common = next(i for i in range(len(full)) if a[i] != b[i])
                assert lcp[k] == min(common, cap)
                assert common >= cap or (a < b) == (sign > 0)


def test_arrays_on_disk(monkeypatch):
    draw = np.random.default_rng(1)
    symbols = np.concatenate([draw.integers(1, 4, 3000), np.ones(300, np.int64), draw.integers(1, 200, 3000)]).astype(np.int16)
    symbols = np.concatenate([symbols, symbols[1000:4000]])
    want = [(p.tolist(), x.tolist()) for p, x in induced.sorted_with_prefixes(induced.Text.of(symbols), 50)]
    monkeypatch.setattr(induced.alloc, "__defaults__", (100,))
    monkeypatch.setattr(induced.Spool.__init__, "__defaults__", (100,))
    got = induced.sorted_with_prefixes(induced.Text.of(symbols), 50, 64, 128)
    assert [(p.tolist(), x.tolist()) for p, x in got] == want
    assert isinstance(got[0][0], np.memmap)


def test_queue_keeps_order_and_spills():
    draw, queue, sent = np.random.default_rng(2), induced.BulkQueue(50), []
    for step in range(40):
        keys = draw.integers(step // 2, 40, 30).astype(np.int32)
        pos = np.arange(30) + 30 * step
        queue.push((keys, pos))
        sent += zip(keys.tolist(), pos.tolist())
    assert queue.spilled
    got = [x for bound in (5, 6, 25, 41) for took in [queue.take(bound)] if took is not None for x in zip(took[0].tolist(), took[1].tolist())]
    assert got == sorted(sent) and queue.least() is None
