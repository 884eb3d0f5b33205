import pytest
from pyspark.sql import functions as F

from gistworks.operators import vocab


@pytest.fixture(scope="module")
def corpus(spark):
    data = [
        (1, "the cat saw the dog", "cat dog"),
        (2, "the dog, the dog!", ""),
        (3, "", "zebra"),
        (4, None, "the ant bee"),
        (5, "the " * 40, "ant"),
    ]
    return spark.createDataFrame(data, "id long, text string, summary string")


@pytest.fixture(scope="module")
def words(corpus):
    return vocab.build_vocab(corpus, size=5)


def test_vocab_order_and_cut(words):
    # ant, bee, saw and zebra follow cat; ties go by spelling and the cut falls among them.
    assert [tuple(r) for r in words.orderBy("token_id").collect()] == [
        ("the", 45, 3), ("dog", 4, 4), ("ant", 2, 5), ("cat", 2, 6), ("bee", 1, 7),
    ]


def test_a_vocab_larger_than_the_corpus_holds_every_token(corpus):
    assert vocab.build_vocab(corpus, size=100).count() == 7


def test_encoding(corpus, words):
    rows = {r["id"]: r for r in vocab.encode_fixed(corpus, words, 6).collect()}
    assert rows[1]["input_ids"] == [3, 6, 1, 3, 4, 0] and rows[1]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert rows[3]["input_ids"] == [0] * 6 == rows[4]["input_ids"]
    assert rows[5]["input_ids"] == [3] * 6 and rows[5]["attention_mask"] == [1] * 6
    assert {len(r["input_ids"]) for r in rows.values()} == {6}
    closed = {r["id"]: r["input_ids"] for r in vocab.encode_fixed(corpus, words, 6, add_eos=True).collect()}
    assert closed[5] == [3] * 5 + [2] and closed[3] == [2] + [0] * 5


def test_pairs_share_the_width(corpus, words):
    rows = {r["id"]: r for r in vocab.encode_pairs(corpus, words, 4, ignore_padding=True).collect()}
    assert rows[1]["input_ids"] == [3, 6, 1, 3] and rows[1]["labels"] == [6, 4, -100, -100]
    assert rows[4]["input_ids"] == [0] * 4 and rows[4]["labels"] == [3, 5, 7, -100]
    assert rows[2]["labels"] == [-100] * 4


def test_round_trip(corpus, words):
    encoded = vocab.encode_fixed(corpus, words, 8)
    decoded = {r["id"]: r["text"] for r in vocab.decode_ids(encoded, words, "input_ids").collect()}
    assert decoded == {1: "the cat the dog", 2: "the dog the dog", 3: "", 4: "", 5: "the " * 7 + "the"}
    again = vocab.encode_fixed(vocab.decode_ids(encoded, words, "input_ids"), words, 8)
    assert vocab.decode_ids(again, words, "input_ids").exceptAll(vocab.decode_ids(encoded, words, "input_ids")).count() == 0


def test_masked_labels_decode_like_padded_ones(corpus, words):
    masked = vocab.encode_pairs(corpus, words, 4, ignore_padding=True)
    unmasked = masked.withColumn("labels", vocab.unmask(F.col("labels")))
    decoded = {r["id"]: r["text"] for r in vocab.decode_ids(unmasked, words, "labels").collect()}
    assert decoded == {1: "cat dog", 2: "", 3: "", 4: "the ant bee", 5: "ant"}


def test_causal_prompt_ends_with_the_marker(spark, corpus, words):
    rows = vocab.causal_prompt_ids(corpus.where("text is not null"), words, max_length=32, max_new_tokens=12).collect()
    assert {len(r["input_ids"]) for r in rows} == {20}
    assert {r["input_ids"][-1] for r in rows} == {1}  # "summary" is unknown here
    known = vocab.build_vocab(spark.createDataFrame([(1, "summary", "")], corpus.schema))
    assert vocab.causal_prompt_ids(corpus, known, 32, 12).first()["input_ids"][-1] == 3


def test_encoding_and_decoding_shuffle_nothing(corpus, words, plan_of):
    encoded = vocab.encode_pairs(corpus, words, 4)
    assert "Exchange" not in plan_of(encoded)
    assert "Exchange" not in plan_of(vocab.decode_ids(encoded, words, "labels"))


def test_a_large_vocabulary_is_joined(corpus, words, monkeypatch):
    want = sorted(map(str, vocab.encode_pairs(corpus, words, 6).collect()))
    texts = sorted(map(str, vocab.decode_ids(vocab.encode_fixed(corpus, words, 6), words, "input_ids").collect()))
    monkeypatch.setattr(vocab, "is_small", lambda df: False)
    assert sorted(map(str, vocab.encode_pairs(corpus, words, 6).collect())) == want
    assert sorted(map(str, vocab.decode_ids(vocab.encode_fixed(corpus, words, 6), words, "input_ids").collect())) == texts


def test_size_is_in_bytes(spark):
    rows = spark.createDataFrame([("x" * 1000, 1)], "token string, token_id int")
    assert vocab.is_small(rows, 2000) and not vocab.is_small(rows, 1000)


@pytest.mark.parametrize("joined", (False, True))
def test_corpora_may_share_ids(spark, words, joined, monkeypatch):
    if joined:
        monkeypatch.setattr(vocab, "is_small", lambda df: False)
    data = [("arxiv", 1, "the cat"), ("pubmed", 1, "the dog"), ("pubmed", 1, "ant")]
    df = spark.createDataFrame(data, "dataset string, id long, text string")
    encoded = vocab.encode_fixed(df, words, 2)
    assert sorted((r["dataset"], r["id"], r["input_ids"]) for r in encoded.collect()) == [
        ("arxiv", 1, [3, 6]), ("pubmed", 1, [3, 4]), ("pubmed", 1, [5, 0]),
    ]
    assert sorted(map(tuple, vocab.decode_ids(encoded, words, "input_ids").collect())) == sorted(data)
