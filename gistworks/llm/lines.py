"""Line dedup by pairwise alignment: common blocks go from the later document.

Documents overlap if they share a rare enough line, or a run of short lines
that reaches as many words together. A line or run that ``n`` documents hold
proposes no pairs among them but links each to its first holder, so the pairs
are never more than the shared lines' occurrences, however frequent a line is;
chance meetings over few words propose nothing. Each pair is aligned with
patience diff over its line hashes, and runs of aligned lines with enough words
are deleted from the later document. Blocks that stand in another order in the
earlier document are aligned again in what is left, until nothing more aligns:
so of a line with enough words only its first holder's copy stays.

Texts equal as a whole align line by line with the first of them, so only
distinct texts are compared, and all later copies lose their whole text. Texts
are told apart by 128 bits, lines by 64.

"Earlier" means a smaller identifier (nulls last), then the text's hash. Rows
with one identifier and one text are one document and keep the same text. A
null text stays null and shares nothing; an empty text stays empty; lines
without words propose and delete nothing of their own. Every row and column
stays; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistworks.llm.common import Stored, binary, prepare

#: Words that a line needs to propose a pair, and an aligned block to be deleted.
LINE_WORDS = 8
BLOCK_WORDS = 8
_LAST = (1 << 63) - 1


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line; zero for a line without words."""
    from xxhash import xxh3_64_intdigest

    hashes, words = [], []
    for line in text.split(b"\n"):
        n = len(line.split())
        words.append(n)
        hashes.append(xxh3_64_intdigest(line.strip()) - (1 << 63) if n else 0)
    return hashes, words


def proposals(hashes: list[int], words: list[int], least: int) -> list[int]:
    """What a text may share with others, once each: lines of ``least`` words, and from each shorter line the first run of such lines that reaches them."""
    from xxhash import xxh3_64_intdigest

    out = {x for x, n in zip(hashes, words) if n >= least}
    held: list[tuple[int, int]] = []  # the short lines in a row so far, from the run's start
    total = 0
    for x, n in zip(hashes, words):
        if n >= least:
            held, total = [], 0
            continue
        if not n:
            continue
        held.append((x, n))
        total += n
        while total >= least:
            out.add(xxh3_64_intdigest(b"".join((y + (1 << 63)).to_bytes(8, "little") for y, _ in held)) - (1 << 63))
            total -= held.pop(0)[1]
    return list(out)


def _sequences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_hashes(t) for t in binary(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("h"), pa.array([m[0] for m in made], pa.list_(pa.int64())),
                    pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([proposals(*m, least) for m in made], pa.list_(pa.int64())),
                ],
                ["id", "h", "lines", "words", "proposed"],
            )

    return run


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines found once in either range, as the longest run of pairs that rises in both."""
    count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {x: k for k, x in enumerate(a[a0:a1], a0) if count_a[x] == 1 and count_b.get(x) == 1}
    met = [(place[x], k) for k, x in enumerate(b[b0:b1], b0) if x in place]
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (x, _) in enumerate(met):
        at = bisect_left(tops, x)
        tops[at:at + 1] = [x]
        last[at:at + 1] = [k]
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(met[k])
        k = back[k]
    return out[::-1]


def _last_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _subsequence(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in linear memory (Hirschberg)."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 == 1:
            out += [(a0, b0 + int(k)) for k in np.flatnonzero(b[b0:b1] == a[a0])[:1]]
        elif a1 > a0 and b1 > b0:
            mid = (a0 + a1) // 2
            ahead, behind = _last_row(a[a0:mid], b[b0:b1]), _last_row(a[mid:a1][::-1], b[b0:b1][::-1])
            cut = b0 + int(np.argmax(ahead + behind[::-1]))
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences of line hashes, by patience diff; by an LCS where no common line is unique."""
    found = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        inner = _anchors(a, b, a0, a1, b0, b1)
        if not inner:
            both = set(a[a0:a1]) & set(b[b0:b1])
            at_a, at_b = ([k for k in range(lo, hi) if s[k] in both] for s, lo, hi in ((a, a0, a1), (b, b0, b1)))
            pairs = _subsequence(np.array([a[k] for k in at_a], np.int64), np.array([b[k] for k in at_b], np.int64))
            found += [(at_a[x], at_b[y]) for x, y in pairs]
            continue
        found += inner
        at_a, at_b = a0, b0
        for x, y in [*inner, (a1, b1)]:
            todo.append((at_a, x, at_b, y))
            at_a, at_b = x + 1, y + 1
    return sorted(found)


def aligned_blocks(a: list[int], b: list[int], words: list[int], least: int) -> set[int]:
    """Positions of ``b`` in runs of aligned lines that have at least ``least`` words, and all copies of their lines that have as many alone."""
    out, run, before = [], [], None
    for pair in [*patience(a, b), None]:
        if pair is None or before is None or pair != (before[0] + 1, before[1] + 1):
            if sum(words[k] for k in run) >= least:
                out += run
            run = []
        if pair:
            run.append(pair[1])
        before = pair
    alone = {b[k] for k in out if words[k] >= least}
    return {*out, *(k for k, x in enumerate(b) if x in alone and words[k] >= least)}


#: Alignments of one pair before the long lines left in common go one by one.
ROUNDS = 64


def common_blocks(a: list[int], b: list[int], words: list[int], least: int, rounds: int = ROUNDS) -> list[int]:
    """Positions of ``b`` to delete: its aligned blocks, then those of what is left, until none has ``least`` words.

    Every round deletes a block. Long lines that are left in common when none
    aligns any more (they cross short ones that were aligned in their place), or
    after ``rounds`` (texts whose lines stand in reverse), are blocks of their own.
    """
    out: set[int] = set()
    left, there = list(b), set(a)
    for _ in range(rounds):
        more = aligned_blocks(a, left, words, least)
        if not more:
            break
        out |= more
        for k in more:
            left[k] = -(1 << 64) - k  # no line's hash
    return sorted({*out, *(k for k, x in enumerate(left) if words[k] >= least and x in there)})


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("owner_lines", "lines", "words"))
            found = [common_blocks(a, b, w, least) for a, b, w in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.list_(pa.int32()))], ["h", "removed"])

    return run


def find_common(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(h, first, removed): for each text with copies or common blocks its hash, first holder and lines to delete."""
    prepare(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col).where("text is not null").select("id", "h", "text")
    rows = Stored(texts.mapInArrow(_sequences(line_words), "id long, h binary, lines array<long>, words array<int>, proposed array<long>"), "line-rows")
    firsts = rows.read().groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    some = Stored(
        rows.read().join(firsts, "h").where(F.col("id") == F.col("first")).dropDuplicates(["h"]).select("h", "first", "last", "lines", "words", "proposed"), "line-texts"
    )
    distinct = some.read()
    each = distinct.select("h", "first", F.explode("proposed").alias("line"))
    me = F.struct("first", "h")
    owners = each.groupBy("line").agg(F.min(me).alias("owner"), F.count("*").alias("n")).where("n > 1")
    pairs = each.join(owners, "line").where(F.col("owner.h") != F.col("h")).select("h", F.col("owner.h").alias("owner")).distinct()
    owned = distinct.select(F.col("h").alias("owner"), F.col("lines").alias("owner_lines"))
    both = pairs.join(distinct.select("h", "lines", "words"), "h").join(owned, "owner").select("h", "lines", "words", "owner_lines")
    gone = Stored(both.mapInArrow(_align(block_words), "h binary, removed array<int>").where("size(removed) > 0"), "line-blocks")
    merged = gone.read().select("h", F.explode("removed").alias("at")).groupBy("h").agg(F.array_sort(F.collect_set("at")).alias("removed"))
    return distinct.select("h", "first", "last").join(merged, "h", "left").where("removed is not null or first < last").drop("last")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)).alias("id"),
        F.unhex(F.md5(text)).alias("h"),
        text.alias("text"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )


def with_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(row, kept, n_lines, removed): every row as a struct, its text without the blocks, and the deleted lines."""
    common = Stored(find_common(docs, id_col, text_col, **options), "line-common").read()
    joined = _keyed(docs, id_col, text_col).join(common, "h", "left")
    parts = F.split("text", "\n")
    every = F.sequence(F.lit(0), F.size(parts) - 1)
    copy = F.col("first") != F.col("id")
    removed = F.when(copy & (F.col("text") != ""), every).otherwise(F.col("removed"))
    gone = F.coalesce(removed, F.array().cast("array<int>"))
    kept = F.array_join(F.filter(parts, lambda x, k: ~F.array_contains(F.col("removed"), k)), "\n")
    text = F.when(copy, F.when(F.col("text").isNotNull(), "")).when(F.col("removed").isNull(), F.col("text")).otherwise(kept)
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return joined.select("row", text.alias("kept"), count.alias("n_lines"), gone.alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options: int) -> DataFrame:
    """The rows with their remaining texts, and their lengths where the table has such a column."""
    made = with_kept(docs, id_col, text_col, **options)
    changed = {text_col: F.col("kept")}
    if length_col:
        changed[length_col] = F.when(F.size("removed") > 0, F.length("kept").cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return made.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
