from datetime import datetime

from pyspark.sql import functions as F

from gistworks.functions import runkeys, text as tx


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return df.select(column).first()[0]


def test_tokens_and_bigrams(spark):
    assert one(spark, tx.tokens(F.col("t")), t="L'Élève 3x, (Don't)") == ["l", "l", "ve", "3x", "don", "t"]
    assert one(spark, tx.bigrams(tx.tokens(F.col("t"))), t="a b c") == ["a b", "b c"]
    assert one(spark, tx.bigrams(tx.tokens(F.col("t"))), t="a") == []


def test_answer(spark):
    def answer(o):
        return one(spark, tx.extract_answer(F.col("o")), o=o)

    assert answer("p SUMMARY:\n  yes \t SUMMARY: no") == "yes"
    assert answer("no marker") is None
    assert answer("p SUMMARY:") == ""


def test_budget(spark):
    assert tx.CHAT_BUDGET == 3832

    def cut(n, t):
        return one(spark, tx.truncate_tokens(F.col("t"), n), t=t)

    assert cut(2, "a  b c") == "a  b" and cut(9, "a\nb c. ") == "a\nb c. "
    assert cut(2, "ab-cd.ef\ngh") == "ab-cd" and cut(1, " élan été") == " élan" and cut(3, "a b c !") == "a b c !"
    long = "\n".join(["w"] * 10_000)
    kept = cut(tx.CHAT_BUDGET, long)
    assert len(kept.split("\n")) == tx.CHAT_BUDGET
    assert one(spark, tx.token_count(F.col("t")), t=cut(700, "\u0130\u212a-a.b " * 400)) == 700
    message = one(spark, tx.chat_messages(F.col("t"), 13), t="first second")
    assert message[0]["role"] == "system" and message[0]["content"].endswith("text. first")


def test_suffix_keeps_the_width(spark):
    def reserved(t):
        suffix = F.array(F.lit("S"), F.lit(":"))
        return one(spark, tx.reserve_suffix(F.split("t", " "), suffix), t=t)

    assert reserved("a b c") == ["a", "S", ":"]
    assert reserved("a b") == ["S", ":"] and reserved("a") == [":"]


def test_own_tokenizer(spark):
    from gistworks.functions.tokenizer import batch_tokenizer

    def make():
        return lambda texts: [[(i, i + 1, c) for i, c in enumerate(t) if c != " "] for t in texts]

    own = batch_tokenizer(make)
    df = spark.createDataFrame([("a bc",), (None,), ("",)], "t string")
    got = df.select(own.tokens(F.col("t")), tx.truncate_tokens(F.col("t"), 2, own), own.count(F.col("t"))).collect()
    assert [tuple(r)[:2] for r in got] == [(["a", "b", "c"], "a b"), (None, None), ([], "")] and got[0][2] == 3


def test_clip_leaves_other_types(spark):
    df = spark.createDataFrame([("x" * 30, 12345678901234)], "s string, n long")
    assert tx.clip_strings(df).first() == ("x" * 10, 12345678901234)


def test_run_names_round_trip(spark):
    df = spark.createDataFrame([("gpt-3.5-turbo-16k", "arxiv", 4096, datetime(2023, 6, 15, 19, 33, 53))], "m string, d string, n int, t timestamp_ntz")
    folder = runkeys.run_folder(runkeys.run_key(F.col("m"), F.col("d"), F.col("n")), F.col("t"))
    named = df.select(folder.alias("f")).first()["f"]
    assert named == "gpt-3.5-turbo-16k-arxiv-4096-15062023193353"
    parsed = spark.createDataFrame([(named,), ("bart-pubmed",), ("odd",)], "f string").select(
        *[c.alias(n) for n, c in runkeys.parse_folder(F.col("f")).items()]
    )
    assert [tuple(r) for r in parsed.collect()] == [
        ("gpt-3.5-turbo-16k", "arxiv", 4096, datetime(2023, 6, 15, 19, 33, 53)),
        ("bart", "pubmed", None, None),
        (None, None, None, None),
    ]
    assert one(spark, runkeys.strip_checkpoint(F.col("p")), p="/a/run/checkpoint-1600") == "/a/run"
    assert one(spark, runkeys.route_corpus(F.col("f")), f="pubmed-arxiv") == "arxiv"
    assert one(spark, runkeys.route_corpus(F.col("f")), f="x-bigpatent") == "govreport"
