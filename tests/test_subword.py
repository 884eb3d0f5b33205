"""Subword segmentation against all segmentations, and tokenizers made once per task."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gistworks.functions import tokenizer as tk
from gistworks.functions.subword import UNKNOWN_COST, UnigramModel
from gistworks.operators import vocab

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_way(word, model):
    """(score, [(end, id), …]) of each segmentation; unknown characters by their bytes or the unknown id."""
    unknown = min(s for _, s in model.pieces.values()) - UNKNOWN_COST
    out = []

    def walk(at, score, path, ends):
        if at == len(word):
            out.append((score, path, ends))
        for end in range(at + 1, len(word) + 1):
            known = model.pieces.get(word[at:end])
            if known:
                walk(end, score + known[1], [*path, known[0]], [*ends, end])
            elif end == at + 1:
                raw = [model.bytes_[b] for b in word[at:end].encode()] if model.bytes_ else [model.unknown]
                walk(end, score + unknown, path + raw, [*ends, end])

    walk(0, 0.0, [], [0])
    return out


@pytest.mark.parametrize("seed", range(12))
def test_best_path(seed):
    draw = random.Random(seed)
    letters = " ab" if seed % 2 else " abé"
    names = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 4))) for _ in range(14)}
    pieces = {p: (k + 300, float(-draw.randint(1, 9))) for k, p in enumerate(sorted(names))}
    model = UnigramModel(pieces, list(range(256)) if seed % 3 else None, 299)
    for _ in range(40):
        word = " " + "".join(draw.choice(letters[1:]) for _ in range(draw.randint(0, 7)))
        ways = every_way(word, model)
        best = max(score for score, _, _ in ways)
        # Among the best the longest last piece, then the longest before it.
        want = min((w for w in ways if w[0] == best), key=lambda w: [e for e in w[2][-2::-1]])
        assert [i for _, i in model.segment(word)] == want[1]
        assert model.segment(word) is model.segment(word)


TEXTS = ["", " ", "  two  blanks ", "line\nbreak\ttab", "naïve café 😀 ▁ mark", "a" * 3000, "word " * 500, "Ünïcödé\x00end", "▁", " leading"]


def test_round_trip():
    model = UnigramModel.read(PATH)
    draw = random.Random(5)
    random_texts = ["".join(draw.choice("ab é▁😀\n.") for _ in range(draw.randint(0, 60))) for _ in range(100)]
    for text in TEXTS + random_texts:
        ids = model.encode(text)
        assert model.decode(ids) == text
        spans = model.spans(text)
        assert [i for *_, i in spans] == ids and "".join(text[a:b] for a, b, _ in spans) == text
        assert model.encode(text, 5) == ids[:5] and model.spans(text, 5) == spans[:5]


def test_columns(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "id long, text string").repartition(3)
    own, model = tk.subword_tokenizer(spark, PATH), UnigramModel.read(PATH)
    t = F.col("text")
    rows = frame.select("id", "text", own.ids(t, None).alias("ids"), own.count(t).alias("n"), own.tokens(t).alias("tokens"), own.cut(t, 3).alias("cut")).collect()
    for r in rows:
        if r["text"] is None:
            assert r["ids"] is r["n"] is r["tokens"] is r["cut"] is None
            continue
        assert r["ids"] == model.encode(r["text"]) and r["n"] == len(r["ids"]) == len(r["tokens"])
        assert r["text"].startswith(r["cut"]) and (r["n"] > 3 or r["cut"] == r["text"])
    encoded = vocab.encode_fixed(frame, None, 8, add_eos=True, tokenizer=own, keys=("id",))
    for r in encoded.join(frame, "id").collect():
        ids = model.encode(r["text"] or "", 7) + [vocab.EOS]
        assert r["input_ids"] == ids + [0] * (8 - len(ids)) and sum(r["attention_mask"]) == len(ids)
    back = vocab.decode_ids(frame.select("id", own.ids(t, None).alias("ids")), None, "ids", tokenizer=own, keys=("id",))
    assert {r["id"]: r["text"] for r in back.collect()} == {**dict(enumerate(TEXTS)), 99: ""}
    with pytest.raises(ValueError):
        vocab.encode_fixed(frame, None, 8, keys=("id",))
    with pytest.raises(ValueError):
        vocab.decode_ids(back, None, "text", keys=("id",))


def test_hooks_are_made_once_per_task(spark):
    made = spark.sparkContext.accumulator(0)

    def words():
        made.add(1)
        import re

        return lambda texts: [[(m.start(), m.end(), m[0]) for m in re.finditer("[^ ]+", t)] for t in texts]

    def lengths():
        made.add(1)
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    def stars():
        made.add(1)
        return lambda lists: [" ".join("*" * n for n in ids) for ids in lists]

    own = tk.batch_tokenizer(words, lengths, stars)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        frame = spark.range(0, 40, 1, 2).select("id", F.concat(F.lit("a bb "), F.col("id").cast("string")).alias("text"))
        assert frame.select(own.count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0] == 120
        assert made.value == 2
        rows = frame.select(own.ids(F.col("text"), 2).alias("ids")).select("ids", own.spell(F.col("ids")).alias("text")).collect()
        assert {(*r["ids"], r["text"]) for r in rows} == {(1, 2, "* **")}
        assert made.value <= 6
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_only_the_first_tokens_are_looked_up(spark):
    frame = spark.createDataFrame([(1, "İb K2 x " * 50), (2, None)], "id long, text string")
    words = vocab.build_vocab(frame, ("text",), 10)
    got = {r["id"]: r["input_ids"] for r in vocab.encode_fixed(frame, words, 5).collect()}
    listed = tk.Tokenizer(tk.RUNS.tokens, tk.RUNS.cut)
    assert got == {r["id"]: r["input_ids"] for r in vocab.encode_fixed(frame, words, 5, tokenizer=listed).collect()}
    assert got[2] == [0] * 5 and len(set(got[1])) > 1
