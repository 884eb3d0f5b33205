"""The whole pipeline over a small folder with planted cases, and over empty tables."""

import base64
import random
import zlib

import public_tokenizers
import pytest
import tiktoken

import __spark_entry__ as driver
import corpus_pipeline

from .conftest import CLASHING, SCHEMA, prose, words

ITEM = prose(900, 40).capitalize() + ". " + prose(901, 8).capitalize() + "."


def planted():
    draw = random.Random(1)
    clean = [(k, "\n".join(prose(1000 * k + j, 25) for j in range(5))) for k in range(60)]
    bad = []
    for k in range(200, 320):
        text = words(40_000 + k, 60)
        for spot, word in zip(draw.sample(range(60), 2), draw.sample(["vileword", "nastyword", "foulword"], 2)):
            text[spot] = word
        bad.append((k, " ".join(text)))
    leaked = [(400 + k, f"{prose(70_000 + k, 60)}\n{ITEM}\n{prose(80_000 + k, 60)}") for k in range(3)]
    shared = "\n".join(prose(95_000 + j, 20) for j in range(4))
    sharing = [(500, shared + "\n" + clean_text(1)), (501, clean_text(2) + "\n" + shared)]
    return clean, bad, leaked, sharing, shared


def clean_text(k):
    return "\n".join(prose(99_000 + 10 * k + j, 25) for j in range(5))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    clean, bad, leaked, sharing, _ = planted()
    rows = [*clean, *bad, *leaked, *sharing, (600, None), (601, ""), (602, clean[7][1]), clean[5], (None, prose(88, 70))]
    full = [(i, t, "en", "s", None if t is None else len(t), *("x" for _ in CLASHING)) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i >= 200)) for i, _ in [*clean, *bad]] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_planted_cases(spark, folder):
    clean, bad, leaked, sharing, shared = planted()
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"]: r for r in got}
    assert len(got) == len(kept)
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") if x.strip())}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in [*clean, sharing[0]]:
        assert kept[i]["text"] == text and kept[i]["ids"] == plain.encode_ordinary(text) and kept[i]["n_tokens"] == len(kept[i]["ids"])
    # The first document with the item goes; the others lose it as a shared line before, and stay.
    assert leaked[0][0] not in kept and not any(ITEM in (r["text"] or "") for r in got)
    for i, text in leaked[1:]:
        assert kept[i]["text"] == text.replace(ITEM + "\n", "")
    # Labels are learnt from two folds of three; the third is judged too.
    judged = [i for i, _ in bad]
    assert any(zlib.crc32(str(i).encode()) % 3 == 1 for i in judged) and not set(judged) & set(kept)
    # The later document loses what it shares, the copy everything; empty texts are one group.
    assert kept[501]["text"].strip("\n") == sharing[1][1].replace(shared, "").strip("\n")
    empty = [i for i in (600, 601, 602) if i in kept]
    assert len(empty) == 1 and not kept[empty[0]]["text"] and kept[None]["text"] == prose(88, 70)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    own = [n for n in driver.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 14))
