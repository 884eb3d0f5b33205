"""Token counts, SimHash, BPE and language-model scores against plain definitions."""

import base64
import collections
import hashlib
import math
import re
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from gistworks.llm import bpe, lm, simhash, wordpiece

from .conftest import HARD, prose, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Token counts.


def greedy(word, vocabulary):
    word, n = wordpiece.MARK + word, 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in vocabulary), 0)
        if not size:
            return -1
        n, word = n + 1, word[size:]
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton_is_greedy(seed):
    import random

    draw = random.Random(seed)
    some = {"".join(draw.choice("ab" + wordpiece.MARK) for _ in range(draw.randint(1, 5))) for _ in range(12)}
    automaton = wordpiece.Automaton(sorted(some))
    for _ in range(300):
        word = "".join(draw.choice("abc") for _ in range(draw.randint(0, 9)))
        assert automaton.pieces(wordpiece.MARK + word) == greedy(word, some)


def test_piece_counts(hard, none):
    vocabulary = wordpiece.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    known = set(vocabulary)
    got = sorted((r for r in wordpiece.count_pieces(hard, vocabulary).collect()), key=str)
    want = []
    for i, text in HARD:
        found = [greedy(w, known) for w in WORD.findall(text or "")] if len(text or "") < 100_000 else None
        if found is None:
            cache = {}
            found = [cache[w] if w in cache else cache.setdefault(w, greedy(w, known)) for w in WORD.findall(text)]
        want.append((i, len(found), sum(max(n, 1) for n in found), sum(n < 0 for n in found)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert wordpiece.count_pieces(none, vocabulary).count() == 0


# SimHash.


def plain_print(text, size=3):
    found = WORD.findall(lower(text or ""))
    if not found:
        return 0
    grams = [" ".join(found[k : k + size]) for k in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_sparks_hash(spark):
    text = "One two THREE"
    (want,) = spark.range(1).select(F.xxhash64(F.lit(text.lower()))).first()
    assert simhash.fingerprint(text.encode(), 3) == want % (1 << 64) == plain_print(text)


def plain_components(rows, distance=3):
    prints = [plain_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= distance:
                    label[a] = label[b] = min(label[a], label[b])
    ids = collections.defaultdict(list)
    for (i, _), k in zip(rows, label):
        ids[k].append(i)
    return [(i, f"{p:016x}", min((x for x in ids[k] if x is not None), default=None)) for (i, _), p, k in zip(rows, prints, label)]


def near_copies():
    base = words(11, 400)
    rows = [(100, " ".join(base))]
    for k in range(12):
        changed = list(base)
        changed[k * 7] = f"new{k}"
        rows.append((101 + k, " ".join(changed)))
    return rows + [(200 + k, prose(50 + k, 40)) for k in range(15)]


def test_near_duplicates(make_docs, hard, none):
    for rows, docs in ((HARD, hard), (near_copies(), make_docs(near_copies()))):
        got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
        assert sorted(got, key=str) == sorted(plain_components(rows), key=str)
    assert simhash.near_duplicates(none).count() == 0


def test_anchors_meet():
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 1 << 63, 200, dtype=np.uint64)
    other = prints.copy()
    for k in range(len(other)):
        for bit in draw.choice(64, 3, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(bit)
    a, b = ([*zip(*(x.tolist() for x in simhash.anchors(p, 3)))] for p in (prints, other))
    for k in range(len(prints)):
        mine, theirs = ({(key, home) for row, key, home in x if row == k} for x in (a, b))
        assert any(home or (key, True) in theirs for key, home in mine if {(key, True), (key, False)} & theirs)
        assert len(mine) <= 32


def test_large_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    prints = [1 << b for b in range(40)] + [1 << b | 1 << b + 1 for b in range(39)]
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    labels = {r["node"]: r["label"] for r in simhash.link_prints(rows, 3).collect()}
    assert labels == {p: min(prints) for p in prints}


def test_keep_one(hard, none):
    kept = simhash.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 4, None, 6, 7, 8, 9, 10)))
    assert simhash.keep_one(none).count() == 0


# BPE.


def test_encode_and_decode(hard, none):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.encode(hard, RANKS, public_tokenizers.PATTERN)
    want = [(i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in HARD]
    rows = [(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    again = bpe.decode(got.drop("decoded"), RANKS)
    assert sorted(bytes(r["decoded"]) for r in again.collect()) == sorted(w[2] for w in want)
    assert bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_digest(hard):
    got = bpe.encode(hard.where("doc_id = 8"), RANKS, public_tokenizers.PATTERN, form="digest").first()
    text = dict(HARD)[8]
    ids = bpe.encode(hard.where("doc_id = 8"), RANKS, public_tokenizers.PATTERN).first()["ids"]
    assert got["n_tokens"] == len(ids) and got["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("limit", [600_000, 16 << 20])
def test_blocks_go_by_sections(monkeypatch, limit):
    import tiktoken

    monkeypatch.setattr(bpe, "task_number", lambda: 2)
    monkeypatch.setattr(bpe, "BLOCK_BYTES", limit, raising=False)
    texts = [t for _, t in HARD] + [prose(k % 70, 900) for k in range(400)] + [None] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})
    ranks = types.SimpleNamespace(value=bpe.read_ranks(RANKS))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    cut = list(bpe._cut(public_tokenizers.PATTERN, 5, ["doc_id"])(iter([batch.slice(0, 100), batch.slice(0, 0), batch.slice(100)])))
    every = pa.Table.from_batches(cut)
    words_ = every.filter(pc.equal(every["kind"], "words")).sort_by("bucket").to_batches()
    coded = pa.Table.from_batches(bpe._encode(ranks)(iter(words_)))
    held = every.filter(pc.equal(every["kind"], "block")).drop_columns(["kind", "bucket"])
    join, got, mass = bpe._join(ranks, bpe.as_ids, schema), [], []
    for block in pc.unique(held["block"]).to_pylist():
        out = join(held.filter(pc.equal(held["block"], block)), coded.filter(pc.equal(coded["block"], block)))
        mass += [b["decoded"].nbytes for b in out.to_batches()]
        got += [tuple(r.values()) for r in out.to_pylist()]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.value, special_tokens={})
    assert got == [(k, plain.encode_ordinary(t or ""), (t or "").encode()) for k, t in enumerate(texts)]
    # Neither a stored row nor a returned batch takes in a block; only the longest text is larger than a section.
    assert sum(mass) > 1_500_000 and sum(m > 600_000 for m in mass) == 0 and max(map(len, held["payload"].to_pylist())) < 400_000
    assert (len(pc.unique(held["block"])) > 1) == (limit == 600_000)


# Language model.


def test_scores(hard, none):
    learn = F.col("doc_id") % 2 == 0
    got = lm.score(hard, learn).collect()
    tokens = [(i, [w.encode() for w in WORD.findall(lower(t or ""))] + [lm.END]) for i, t in HARD]
    one, two = collections.Counter(), collections.Counter()
    for i, seq in tokens:
        if i is not None and i % 2 == 0:
            one.update(seq)
            two.update(zip([lm.END, *seq], seq))
    n, v = sum(one.values()), len(one)
    uni = lambda w: (one[w] + 1) / (n + v + 1)
    want = []
    for i, seq in tokens:
        p = sum(math.log10((two[h, w] + lm.PRIOR * uni(w)) / (one[h] + lm.PRIOR)) for h, w in zip([lm.END, *seq], seq))
        want.append((str(i), len(seq), sum(one[w] > 0 for w in seq), n, round(sum(math.log10(uni(w)) for w in seq), 5), round(p, 5)))
    rows = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5), round(r["score"], 5)) for r in got]
    assert sorted(rows) == sorted(want)
    # every state's probabilities sum to one, with the unseen share at a new word
    words_ = list(one)
    for h in words_[:20]:
        total = sum((two[h, w] + lm.PRIOR * uni(w)) / (one[h] + lm.PRIOR) for w in words_) + lm.PRIOR / (n + v + 1) / (one[h] + lm.PRIOR)
        assert total == pytest.approx(1, abs=1e-9) or sum(two[h, w] for w in words_) < one[h]
    assert lm.score(none, learn).count() == 0


def test_blocks_share_counts(make_docs, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 200)
    rows = [(k, prose(k % 5, 40)) for k in range(30)]
    split = lm.score(make_docs(rows).repartition(5), F.col("doc_id") < 20).select("doc_id", "score").collect()
    monkeypatch.setattr(lm, "BLOCK", 1 << 20)
    whole = lm.score(make_docs(rows).coalesce(1), F.col("doc_id") < 20).select("doc_id", "score").collect()
    assert {r[0]: round(r[1], 6) for r in split} == {r[0]: round(r[1], 6) for r in whole}


def test_ranks_file():
    with open(RANKS, "rb") as f:
        token, rank = f.readline().split()
    assert bpe.read_ranks(RANKS)[base64.b64decode(token)] == int(rank)
