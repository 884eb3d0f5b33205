"""Near duplicates by SimHash, found through anchors of a covering code.

Two fingerprints that differ in at most k of 64 bits differ in at most k // 2
bits of one 32-bit half. 31 bits of each half are covered by the perfect
Hamming code of that length: every word lies within one bit (the covering
radius) of exactly one code word, its home. So a fingerprint is replicated to
every anchor of either half within that radius plus k // 2 bits (16 anchors a
half for k = 3), and a pair always meets at the home of one of the two.

Distinct fingerprints are compared, not documents; an anchor with very many
of them is split into blocks, every two of which meet in one task. Each task
reports a spanning set of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistworks.llm.common import Stored, binary, components, pick, prepare

#: Fingerprints of one anchor that are compared in one go; more are split into blocks of this many.
BLOCK = 4096
_LENGTH = 31


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a text's word shingles, as an unsigned integer; zero without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())), "<u8", len(starts))
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str, out_col: str, shingle: int = 3) -> DataFrame:
    """Adds the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t, shingle) for t in binary(texts).to_pylist()), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))


def _flips(radius: int) -> dict[int, list[int]]:
    """For each syndrome of the Hamming code, the words of at most ``radius`` bits that have it."""
    found: dict[int, list[int]] = {s: [] for s in range(_LENGTH + 1)}
    for weight in range(radius + 1):
        for places in combinations(range(1, _LENGTH + 1), weight):
            syndrome, mask = 0, 0
            for p in places:
                syndrome ^= p
                mask |= 1 << (p - 1)
            found[syndrome].append(mask)
    return found


def anchors(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor within reach of each fingerprint, over both halves."""
    near, home = _flips(1 + distance // 2), _flips(1)
    rows, keys, homes = [], [], []
    for half in range(2):
        word = (prints >> np.uint64(32 * half)).astype(np.int64) & ((1 << _LENGTH) - 1)
        syndrome = np.zeros(len(word), np.int64)
        for p in range(1, _LENGTH + 1):
            syndrome ^= ((word >> (p - 1)) & 1) * p
        for s in np.unique(syndrome).tolist():
            at = np.flatnonzero(syndrome == s)
            masks = np.array(near[s], np.int64)
            rows.append(np.repeat(at, len(masks)))
            keys.append(((word[at, None] ^ masks) | (half << _LENGTH)).ravel())
            homes.append(np.tile(np.isin(masks, home[s]), len(at)))
    return (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (keys, np.int64), (homes, bool)))


def _replicate(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys, homes = anchors(prints.view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows]), pa.array(homes)], ["anchor", "fp", "home"])

    return run


def spanning(key: np.ndarray, fp: np.ndarray, home: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links (fingerprint, other) that connect all rows of equal key within the distance; rows are sorted by key."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(fp[a].tolist(), fp[b].tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)

    bits = fp.view(np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    small = np.repeat(np.where(sizes <= 32, sizes, 0), sizes)
    for step in range(1, int(small.max(initial=0))):
        a = np.flatnonzero((key[:-step] == key[step:]) & (small[:-step] > step))
        b = a + step
        near = (home[a] | home[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= distance)
        link(a[near], b[near])
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
        for a in range(start, start + size - 1):
            rest = slice(a + 1, start + size)
            near = np.flatnonzero(np.bitwise_count(bits[rest] ^ bits[a]) <= distance)
            if not home[a]:
                near = near[home[rest][near]]
            link(np.full(len(near), a), near + a + 1)
    nodes = list(parent)
    return nodes, [root(x) for x in nodes]


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            anchor, pair = (table.column(c).to_numpy() for c in ("anchor", "pair"))
            key = np.cumsum(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1]))))
            a, b = spanning(key, table.column("fp").to_numpy(), table.column("home").to_numpy(), distance)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            anchor, pair = (table.column(c).to_numpy() for c in ("anchor", "pair"))
            whole = np.flatnonzero((anchor[1:] != anchor[:-1]) | (pair[1:] != pair[:-1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield links(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield links(held)

    return run


def link_prints(prints: DataFrame, distance: int) -> DataFrame:
    """(node, label) over distinct fingerprints ``fp``: the components of those within ``distance`` bits."""
    spread = Stored(prints.select("fp").mapInArrow(_replicate(distance), "anchor long, fp long, home boolean"), "anchors")
    rows = spread.read()
    met = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    met = met.select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    code = F.transform(others, lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    pairs = rows.join(met, "anchor").withColumn("block", block).select("anchor", F.explode(code).alias("pair"), "fp", "home")
    sorted_pairs = pairs.repartition("anchor", "pair").sortWithinPartitions("anchor", "pair")
    links = sorted_pairs.mapInArrow(_compare(distance), "a long, b long")
    found = Stored(links, "print-links")
    spread.drop()
    made = components(found.read(), "a", "b")
    found.drop()
    return made


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``component_id`` is the smallest identifier reachable over links of at
    most ``distance`` bits, the row's own included. A null or wordless text
    has fingerprint zero and is linked like any other. Null identifiers are
    left out of the minimum (null if a component has no other). Repeated rows
    all stay; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    texts = with_fingerprint(pick(docs, doc_id=id_col, text=text_col), "text", "fp", shingle).select("doc_id", "fp")
    found = Stored(texts, "fingerprints")
    by_print = _smallest(found.read().groupBy("fp").agg(F.min("doc_id").alias("first")), "first", "component_id", distance)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.read().join(by_print, "fp").select("doc_id", hexed, "component_id")


def _smallest(prints: DataFrame, value: str, out: str, distance: int) -> DataFrame:
    """(fp, out): the smallest ``value`` in each fingerprint's component."""
    least = Stored(prints, "prints")
    labels = Stored(link_prints(least.read(), distance), "print-labels")
    named = least.read().join(labels.read().withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min(value).alias(out))
    return named.join(smallest, "label").select("fp", out)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest identifier (nulls last).

    Rows that share it, repeated rows among them, are told apart by their
    place in the stored table.
    """
    prepare(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    keyed = docs.select(row.alias("row"), F.monotonically_increasing_id().alias("place"), F.col(f"`{text_col}`").alias("text"))
    rows = Stored(with_fingerprint(keyed, "text", "fp", shingle).drop("text"), "print-rows")
    key = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), F.col("place").alias("place"))
    firsts = _smallest(rows.read().groupBy("fp").agg(F.min(key).alias("first")), "first", "kept", distance)
    chosen = firsts.select("kept").distinct().select(F.col("kept.place").alias("place"))
    return rows.read().join(chosen, "place", "left_semi").select("row.*")
