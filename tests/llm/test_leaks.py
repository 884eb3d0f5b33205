"""The checks of decontamination against plain ones, and its recall on planted paraphrases."""

import random

import numpy as np
import pytest

from gistworks.llm import decontaminate as dc

from .conftest import prose, words


@pytest.fixture(scope="module")
def search():
    """Items and texts whose words come from a small stock, so that many candidates are near and few pass."""
    draw = random.Random(3)
    stock = words(1, 60)
    say = lambda n: " ".join(draw.choice(stock) for _ in range(n))
    items = [say(draw.randint(5, 60)) + ". " + say(4) + "." for _ in range(40)] + ["one", "a a a b"]
    texts = [say(draw.randint(0, 150)) + " " + (draw.choice(items) if draw.random() < 0.5 else "") + " " + say(draw.randint(0, 60)) for _ in range(120)]
    idf = np.ones(dc.SLOTS, np.float32)
    blocks = dc.Items.blocks(list(range(len(items))), [t.encode() for t in items], idf)
    made = dc.Search([dc.Searcher(idf, b, np.eye(len(b.terms), dtype=np.float32)) for b in blocks])
    return made, [t.encode() for t in texts] + [None, b"", b"one"]


def test_bounds_change_no_result(search, monkeypatch):
    made, texts = search
    measured = [0]
    plain = dc.subsequence

    def counted(a, b):
        measured[0] += 1
        return plain(a, b)

    monkeypatch.setattr(dc, "subsequence", counted)
    with_bounds, few = made.leaks(texts), measured[0]
    measured[0] = 0
    assert made.leaks(texts, bounds=False) == with_bounds
    assert sum(map(len, with_bounds)) > 30 and few < 0.7 * measured[0]


def test_bounds_are_upper_bounds(search):
    made, texts = search
    for _, counts, hashes in made.words.of(texts):
        numbers = made.bags.numbers(hashes)
        for row, low, high, item, told in list(made.hopeful(counts, hashes, False))[:400]:
            own, answer = made.items[item]
            bag, again = made.bags.shares(numbers, np.array([low]), np.array([high]), np.array([item]))
            assert bag[0] * len(own) >= dc.subsequence(own, hashes[low:high]) and told == again[0]
            assert told == pytest.approx(np.isin(answer, hashes[low:high]).mean() if len(answer) else 1.0)
            around = hashes[low:high].tolist()
            assert bag[0] * len(own) == pytest.approx(sum(min(around.count(w), own.tolist().count(w)) for w in set(own.tolist())))


@pytest.mark.parametrize("at_once", [1, 7, 1024])
def test_halves_add_up_to_windows(search, monkeypatch, at_once):
    made, texts = search
    monkeypatch.setattr(dc, "WINDOWS", at_once)
    ((_, counts, hashes),) = made.words.of(texts)
    for block in made.blocks:
        rows, start, end = dc.windows(counts, dc.STRIDE)
        weight = block.idf[dc.slot(hashes)]
        want = set()
        for r, a, b in zip(rows.tolist(), start.tolist(), end.tolist()):
            seen = sum((block.adds[block.place[s]] for s in dc.slot(hashes[a:b]) if block.place[s] >= 0), np.zeros(block.adds.shape[1]))
            near = np.flatnonzero(seen >= dc.COSINE * np.sqrt((weight[a:b] ** 2).sum()) * (1 + 1e-5))
            want |= {(r, a, b, int(block.items.owner[p])) for p in near}
        got = set(block.candidates(counts, hashes))
        assert want <= got and len(got) <= len(want) * 1.02 + 2


@pytest.mark.parametrize("rate", [0.1, 0.2, 0.3])
def test_paraphrases(make_docs, spark, rate):
    """Items with a share of their words replaced, and no run of eight words left."""
    draw = random.Random(int(100 * rate))
    items = [(k, prose(50_000 + k, 30 + k % 30)) for k in range(150)]
    docs = []
    for k, text in items:
        split = text.split(" ")
        spots = set(range(6, len(split) - 8, 7)) | set(draw.sample(range(len(split) - 8), int(rate * (len(split) - 8))))
        docs.append((k, f"{prose(60_000 + k, 40)} {' '.join(f'new{draw.randrange(10**6)}' if j in spots else w for j, w in enumerate(split[:-8]))} {' '.join(split[-8:-1])} x {prose(70_000 + k, 40)}"))
    found = dc.with_leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), "found").select("doc_id", "found.item_id").collect()
    whole = {k: dc.Words() for k, _ in items}
    passes = set()
    for (k, text), (_, doc) in zip(items, docs):
        ((_, _, own),), ((_, _, around),) = whole[k].of([text.encode()]), whole[k].of([doc.encode()])
        if dc.subsequence(own, around) >= dc.SUBSEQUENCE * len(own) and np.isin(own, around).mean() >= dc.ANSWER:
            passes.add(k)
    got = {k for k, ids in found if k in ids}
    assert all(set(ids) <= {k} for k, ids in found)
    assert len(passes) > 100 and len(got & passes) >= 0.9 * len(passes)
