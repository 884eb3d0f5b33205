"""Sharding, lines, quality, chats, toxicity and decontamination against plain definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from gistworks.llm import chat, decontaminate, lines, quality, sharding, toxicity

from .conftest import HARD, prose, words

# Sharding.


def plain_shard(key, shards):
    node, above = 0, shards
    for level, span in zip(sharding.LEVELS, sharding.SPANS):
        fan, best = -(-above // span), None
        for child in range(node * fan, node * fan + fan):
            weight = min(shards, (child + 1) * span) - child * span
            if weight > 0:
                u = (int(hashlib.md5(f"{level}{child}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
                best = min(best or (math.inf, 0), (-math.log(u) / weight, child))
        node, above = best[1], span
    return node


@pytest.mark.parametrize("shards", (1, 3, 8, 40))
def test_shards(hard, shards):
    got = sharding.place(hard, shards).collect()
    assert len(got) == len(HARD)
    by_shard = collections.defaultdict(list)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (plain_shard(key, shards), plain_shard(key, shards + 1))
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in HARD)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want


def test_growth_moves_rows_into_the_new_shard_only(make_docs, none):
    got = sharding.place(make_docs([(k, "t") for k in range(3000)]), 40).collect()
    moved = [r for r in got if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {40} and 40 < len(moved) < 120
    assert sharding.place(none, 40).count() == 0


# Lines.


def plain_lines(rows):
    order = sorted({(2**63 - 1 if i is None else i, t) for i, t in rows if t is not None}, key=lambda r: r[0])
    first, held, seqs, gone = {}, {}, {}, {}
    for i, text in order:
        if text in first:
            gone[i, text] = set(range(text.count("\n") + 1)) if text else set()
            continue
        first[text] = i
        seqs[text] = lines.line_hashes(text.encode())
        partners = {held.setdefault(h, text) for h, n in zip(*seqs[text]) if n >= lines.LINE_WORDS} - {text}
        gone[i, text] = {k for p in partners for k in lines.common_blocks(seqs[p][0], *seqs[text], lines.BLOCK_WORDS)}
    out = []
    for i, text in rows:
        drop = gone.get((2**63 - 1 if i is None else i, text), set())
        out.append((i, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)))
    return out


def overlapping():
    shared = [prose(70 + k, 12) for k in range(6)]
    own = lambda k, n=4: [prose(1000 + 10 * k + j, 9) for j in range(n)]
    rows = [
        (20, "\n".join([*own(1), *shared, *own(2)])),
        (21, "\n".join([*own(3), *shared[:3], "short one", *shared[3:], *own(4)])),
        (22, "\n".join([shared[2], *own(5), shared[1], *own(6)])),
        (23, "\n".join(own(1) + own(7))),
        (24, "\n".join([shared[0]] * 3 + own(8))),
        (25, "The.\nOf a.\n" + "\n".join(own(9))),
        (26, "The.\nOf a.\n" + "\n".join(own(10))),
    ]
    return rows + [(30 + k, rows[0][1]) for k in range(5)]


@pytest.mark.parametrize("which", ("hard", "overlapping"))
def test_line_dedup(hard, make_docs, which):
    rows = HARD if which == "hard" else overlapping()
    docs = hard if which == "hard" else make_docs(rows).repartition(3)
    got = lines.dedup_lines(docs, length_col="n_chars")
    assert got.columns == docs.columns
    found = got.select("doc_id", "text", "n_chars").collect()
    assert sorted(((r[0], r[1]) for r in found), key=str) == sorted(plain_lines(rows), key=str)
    assert all(r[2] == len(r[1]) for r in found if r[1] is not None)


def test_shared_passage_is_deleted_once(make_docs, none):
    rows = overlapping()
    kept = dict(r[:2] for r in lines.dedup_lines(make_docs(rows)).select("doc_id", "text").collect())
    passage = prose(73, 12)
    assert passage in kept[20] and passage not in kept[21]
    assert kept[25] == rows[5][1] and kept[26] == rows[6][1] and kept[30] == ""
    assert lines.dedup_lines(none).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_patience_is_an_alignment(seed):
    draw = random.Random(seed)
    a, b = ([draw.randint(0, 12) for _ in range(draw.randint(0, 25))] for _ in range(2))
    found = lines.patience(a, b)
    assert all(a[x] == b[y] for x, y in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
    assert len(lines.patience(a, a)) == len(a)


def test_repeated_lines_of_a_shared_passage_go(make_docs):
    """No common line is unique in the later document; all of its copies go, short lines among its own stay."""
    p, q, own = prose(51, 50), prose(52, 20), [prose(60 + k, 9) for k in range(4)]
    rows = [(1, "\n".join([own[0], p, q])), (2, "\n".join([own[1], p, "x", p, own[2], q, own[3], q, p]))]
    kept = dict(r[:2] for r in lines.dedup_lines(make_docs(rows)).select("doc_id", "text").collect())
    assert kept == {1: rows[0][1], 2: "\n".join([own[1], "x", own[2], own[3]])}


@pytest.mark.parametrize("seed", range(30))
def test_ranges_without_unique_lines_are_aligned(seed):
    draw = random.Random(seed)
    a, b = ([x for _ in range(draw.randint(1, 8)) for x in [draw.randint(0, 3)] * 2] for _ in range(2))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    found = lines._subsequence(np.array(a), np.array(b))
    assert len(found) == table[-1, -1] and all(a[x] == b[y] for x, y in found)
    assert all(v[0] < w[0] and v[1] < w[1] for v, w in zip(found, found[1:]))


# Quality.


def plain_counts(text):
    found = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    often, covered = collections.Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            covered |= {k, k + 1, k + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts(hard, none):
    got = quality.rate(hard, quality.grow(np.zeros((0, len(quality.FEATURES))), np.zeros(0), [])).collect()
    want = [(str(i), *plain_counts(t)) for i, t in HARD]
    assert sorted((str(r["doc_id"]), *r[1:6]) for r in got) == sorted(want)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.rate(none, quality.grow(np.zeros((0, 9)), np.zeros(0), [])).count() == 0


@pytest.mark.parametrize("text", ("a b c a b c", "a a a a", "x\nx\n \n \nx", "a b", "<a> #b $c%", "w1 w2 w3 w4 w1 w2 w3"))
def test_quality_small(text):
    assert quality.statistics(text.encode())[0] == plain_counts(text)


def test_trees_are_monotonic_and_learn():
    draw = np.random.default_rng(1)
    x = draw.random((3000, 4))
    y = ((x[:, 0] < 0.5) ^ (draw.random(3000) < 0.1)).astype(float)
    trees = quality.grow(x, y, [-1, 0, 1, 0])
    assert ((trees.predict(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    for f, sign in ((0, -1), (2, 1)):
        for _ in range(40):
            line = np.repeat(draw.random((1, 4)), 60, axis=0)
            line[:, f] = np.linspace(0, 1, 60)
            assert (sign * np.diff(trees.predict(line)) >= -1e-12).all()


def test_quality_keeps_clean_and_rejects_junk(make_docs, spark):
    clean = [(k, ". ".join(prose(200 + 3 * k + j, 40).capitalize() for j in range(3))) for k in range(80)]
    junk = [(1000 + k, " ".join(f"{w}###" for w in words(900 + k, 80))) for k in range(40)]
    docs = make_docs(clean + junk)
    labels = spark.createDataFrame([(i, int(i < 1000), None) for i, _ in (clean + junk)[::2]] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, text int")
    kept = {r["doc_id"]: r["kept"] for r in quality.rate(docs, quality.fit(docs, labels)).collect()}
    assert all(kept[i] == (i < 1000) for i in kept)


# Chats.


def chats(spark):
    rows = [
        (1, 0, "user", "hello <s>[INST]\\l"), (1, 1, "assistant", "</s>\\ ok [/INST]"), (2, 0, "assistant", "too early"), (3, 1, "user", None),
        (3, 0, "system", ""), (3, 2, "assistant", "<</SYS>>"), (4, 0, "tool<s>", "x[ROLE]"), (4, 1, None, "y"), (5, 0, "user", "open"),
        (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "n"), (None, None, "assistant", "m"),
    ]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")


def test_chats(spark):
    rows, table = chats(spark)
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(table)).collect()}
    groups = collections.defaultdict(list)
    for i, turn, role, text in rows:
        groups[i].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for i, turns in groups.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {i: r["valid"] for i, r in got.items()} == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, None: False}
    assert chat.digest(chat.format_chats(table.limit(0))).count() == 0


def test_chat_marks_cannot_be_forged(spark):
    _, table = chats(spark)
    marks = [m for a, b, _ in chat.TEMPLATE.values() for m in (a, b)] + list(chat.OTHER)
    for r in chat.format_chats(table).collect():
        inner = [s["text"] for s in r["segments"] if s["text"] not in marks]
        assert not any(m in t for m in marks for t in inner)
        assert [s["loss"] for s in r["segments"]].count(True) == (r["segments"][0]["text"] == "<s>")


# Toxicity.


def test_toxicity(make_docs, spark, none, hard):
    bad = ("vileword", "nastyword", "foulword")
    draw = random.Random(5)
    rows = []
    for k in range(600):
        text = words(3000 + k, 40)
        if k % 4 == 0:
            text[draw.randrange(40)] = draw.choice(bad) + "!"
        rows.append((k, " ".join(text)))
    docs = make_docs(rows)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(0, 600) if k % 3] + [(None, 1, 1), (5, None, 0)], "doc_id long, toxic int, score int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score2"] for r in toxicity.with_score(docs, model, "score2").collect()}
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in range(0, 600) if k % 3 == 0)
    scored = toxicity.with_score(hard, model, "score2")
    assert all(0 <= r["score2"] < 0.7 for r in scored.collect()) and scored.columns == [*hard.columns, "score2"]
    assert toxicity.with_score(none, model, "score2").count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert all(r["score2"] < 1e-9 for r in toxicity.with_score(docs, blank, "score2").collect())


def test_counterfactual_penalty_spares_neutral_mentions(make_docs, spark):
    """One group is named in most toxic texts only; with the penalty its name alone says little."""
    draw = random.Random(9)
    rows, marks = [], []
    for k in range(800):
        text, toxic = words(7000 + k, 25), k % 2
        if toxic and draw.random() < 0.9:
            text[3] = "vileword"
        if toxic and draw.random() < 0.7 or not toxic and draw.random() < 0.05:
            text[8] = "muslims"
        rows.append((k, " ".join(text)))
        marks.append((k, toxic))
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    neutral = make_docs([(k, prose(9000 + k, 15) + " muslims " + prose(9500 + k, 15)) for k in range(40)])
    mean = {}
    for weight in (0.0, 5.0):
        model = toxicity.fit(docs, labels, fairness=weight)
        mean[weight] = np.mean([r["s"] for r in toxicity.with_score(neutral, model, "s").collect()])
    assert mean[5.0] < mean[0.0] / 2


# Decontamination.


def test_leaks(make_docs, spark, hard, none):
    items = [(k, prose(100 + k, 15 + 5 * k).capitalize() + ".\n" + prose(300 + k, 8).capitalize() + ".") for k in range(8)]
    benchmark = spark.createDataFrame([(*i, "x") for i in items] + [(90, None, ""), (None, "a b c", ""), (91, " ", "")], "item_id long, text string, leaks string")
    clean = [(k, prose(5000 + k, 200)) for k in range(60)]
    leaked = [(500 + k, f"{prose(6000 + k, 70)} {text} {prose(6500 + k, 30)}") for k, text in items]
    shouted = [(600, prose(6900, 50) + " " + items[2][1].upper())]
    changed = items[4][1].split(" ")
    for k in range(3, len(changed) - 10, 7):
        changed[k] = "other"
    paraphrase = [(601, prose(6901, 30) + " " + " ".join(changed) + " " + prose(6902, 30))]
    only_question = [(602, prose(6903, 30) + " " + items[3][1].split("\n")[0][:40])]
    docs = make_docs(clean + leaked + shouted + paraphrase + only_question)
    got = {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in decontaminate.with_leaks(docs, benchmark, "found").collect()}
    want = {i: [] for i, _ in clean} | {500 + k: [k] for k, _ in items} | {600: [2], 601: [4], 602: []}
    assert got == want
    on_hard = decontaminate.with_leaks(hard, benchmark, "found")
    assert on_hard.columns == [*hard.columns, "found"] and all(not r["found"] for r in on_hard.collect())
    assert decontaminate.with_leaks(none, benchmark, "found").count() == 0
    assert all(not r["found"] for r in decontaminate.with_leaks(docs, benchmark.limit(0), "found").collect())


def test_blocks_of_items_and_recall(make_docs, spark, monkeypatch):
    """Latent candidates hold at least nine tenths of what exact cosines find."""
    rows = [(k, prose(100 + k, 120)) for k in range(60)]
    items = [(k, " ".join(rows[k][1].split(" ")[40:70])) for k in range(40)]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1500)
    docs, benchmark = make_docs(rows), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {x["item_id"] for x in r["found"]} for r in decontaminate.with_leaks(docs, benchmark, "found").collect()}
    assert got == {k: {k} if k < 40 else set() for k, _ in rows}
    idf = decontaminate.weights(*decontaminate.document_frequencies(docs))
    own = decontaminate.Items.of([i for i, _ in items], [t.encode() for _, t in items], idf)
    latent = decontaminate.Searcher(idf, own, decontaminate.latent_space(docs, own, idf))
    exact = decontaminate.Searcher(idf, own, np.eye(len(own.terms), dtype=np.float32))
    hits = [set(), set()]
    for k, text in rows:
        for _, counts, hashes in decontaminate.Words().of([text.encode()]):
            for held, searcher in zip(hits, (latent, exact)):
                held |= {(k, *c[1:]) for c in searcher.candidates(counts, hashes)}
    assert len(hits[0] & hits[1]) >= 0.9 * len(hits[1]) > 0


def test_recall_of_a_large_benchmark(make_docs, spark):
    """Far more passages than the rank of a latent space: all copies are found, and the candidates are those of full cosines."""
    items = [(k, prose(20_000 + k, 15 + k % 45)) for k in range(900)]
    docs = make_docs([(k, f"{prose(30_000 + k, k % 60)} {text} {prose(40_000 + k, 60)}") for k, text in items])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_leaks(docs, benchmark, "found").select("doc_id", "found.item_id").collect()
    assert {i: got for i, got in found} == {k: [k] for k, _ in items}
    idf = decontaminate.weights(*decontaminate.document_frequencies(docs))
    blocks = decontaminate.Items.blocks([k for k, _ in items], [t.encode() for _, t in items], idf)
    assert sum(len(b.rows) for b in blocks) > 4 * decontaminate.RANK and all(len(b.rows) < decontaminate.RANK for b in blocks)
    corpus = decontaminate.Corpus.of(docs, np.unique(np.concatenate([b.terms for b in blocks])), idf)
    ((_, counts, hashes),) = decontaminate.Words().of([r["text"].encode() for r in docs.select("text").collect()])
    both = full = 0
    for own in blocks:
        got, want = (set(decontaminate.Searcher(idf, own, x).candidates(counts, hashes)) for x in (corpus.space(own), np.eye(len(own.terms), dtype=np.float32)))
        both, full = both + len(got & want), full + len(want)
    assert both >= 0.99 * full > 900


@pytest.mark.parametrize("every", (1, 3, 5))
def test_a_frequent_item_is_found_everywhere(make_docs, spark, every):
    """An item that a fifth, a third or all of the documents hold does not hide itself."""
    items = [(k, prose(100 + k, n)) for k, n in enumerate((34, 15, 5))]
    docs = [(k, f"{prose(5000 + k, 40 + k % 30)} {items[k % 9 % 3][1] if k % every == 0 else ''} {prose(8000 + k, 40)}") for k in range(300)]
    found = decontaminate.with_leaks(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), "found")
    want = {k: [k % 9 % 3] if k % every == 0 else [] for k, _ in docs}
    assert {r["doc_id"]: [x["item_id"] for x in r["found"]] for r in found.collect()} == want
    same = make_docs([(k, items[0][1]) for k in range(50)])
    assert all([x["item_id"] for x in r["found"]] == [0] for r in decontaminate.with_leaks(same, spark.createDataFrame(items, "item_id long, text string"), "found").collect())


def test_word_runs_do_not_cross_rows():
    ((_, words, item),) = decontaminate.Words().of([b"a b c d e f g h i j"])
    ((_, counts, hashes),) = decontaminate.Words().of([b"x a b c d e", b"f g h i j", b"", b"y b c d e f g h i z"])
    assert list(decontaminate.Grams({4: item}).candidates(counts, hashes)) == [(3, 12, 20, 4)]


def test_a_long_item_lies_in_several_blocks(make_docs, spark):
    idf = np.ones(decontaminate.SLOTS, np.float32)
    texts = [prose(1, 30).encode(), prose(2, 6000).encode(), prose(3, 40).encode()]
    blocks = decontaminate.Items.blocks([7, 8, 9], texts, idf)
    assert len(blocks) > 2 and all(len(b.rows) <= decontaminate.PASSAGES for b in blocks)
    whole = decontaminate.Items.of([7, 8, 9], texts, idf)
    assert [b.ids[k] for b in blocks for k in b.owner] == [whole.ids[k] for k in whole.owner]
    assert np.isclose(sum(b.rows.sum() for b in blocks), whole.rows.sum())


@pytest.mark.parametrize("seed", range(20))
def test_subsequence(seed):
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(0, 6, draw.integers(1, 30)) for _ in range(2))
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert decontaminate.subsequence(a, b) == table[-1, -1]


def test_words_do_not_depend_on_neighbours():
    one = decontaminate.Words()
    texts = [b"", b"One, two", None, b"two one  TWO", "é É".encode()]
    ((first, counts, hashes),) = one.of(texts)
    assert first == 0 and counts.tolist() == [0, 2, 0, 3, 2]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] == hashes[4] and len(set(hashes.tolist())) == 4
    assert decontaminate.windows(np.array([0, 5, 24, 25, 60]), 12)[0].tolist() == [1, 2, 3, 3, 4, 4, 4, 4]
