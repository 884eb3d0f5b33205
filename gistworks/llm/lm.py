"""Scoring texts by a smoothed bigram model held as a weighted backoff automaton.

The automaton has a state for each word seen as a history, an arc for each
bigram of the training texts, and a failure arc from every state to the
unigram state:

    arc (h, w):      (c(h, w) + prior * p(w)) / (c(h) + prior)
    failure from h:  prior / (c(h) + prior), then p(w)
    unigram:         p(w) = (c(w) + 1) / (N + V + 1)

so each state's probabilities sum to one. The automaton grows with the corpus
and is never shipped whole: a block of texts asks for its own words and
bigrams only, in one shuffle bucketed by their hashes that also sums the
training counts, and gets back the part of the automaton that it walks.

A text ends with one end token, which is also the history of its first token.
A null text counts as empty: its only token is the end. A null learning mark
counts as false. Rows are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gistworks.llm.common import Bucketed, Stored, binary, blocks, bucket_count, pack, pack_words, pick, prepare, task_number, unpack, unpack_words

#: Weight of the unigram model in each state, in tokens.
PRIOR = 500.0
#: The end token; no word holds a line break.
END = b"\n"
_BITS = 56
#: Bytes of text in a block: its bigrams take about twenty times as much memory while they are counted.
BLOCK = 8 << 20


def _codes(texts: list[bytes | None], known: dict[bytes, int]) -> tuple[list[np.ndarray], list[int]]:
    codes, counts = [], []
    for text in texts:
        words = text.lower().split() if text else []
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        counts.append(len(words))
    return codes, counts


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Walk:
    """A block's tokens, their histories and distinct bigrams; bigrams in order of their hashes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, learn: np.ndarray, words: list[bytes], buckets: int):
        import xxhash

        n = counts + 1
        self.first = np.concatenate(([0], np.cumsum(n)))[:-1]
        ends = self.first + counts
        self.token = np.zeros(int(n.sum()), np.int64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = codes
        self.history = np.zeros(len(self.token), np.int64)
        self.history[1:] = self.token[:-1]
        taught = np.repeat(learn, n)
        self.word_counts = np.bincount(self.token[taught], minlength=len(words))
        pair, at = np.unique(self.history * len(words) + self.token, return_inverse=True)
        own = np.bincount(at[taught], minlength=len(pair))
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        h, w = np.divmod(pair, max(1, len(words)))
        keys = (_mixed(_mixed(hashes[h]) + hashes[w]) >> np.uint64(64 - _BITS)).astype(np.int64)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.pair_counts, self.pair_of_token = keys[order], own[order], place[at]
        self.lows = [(b << _BITS) // buckets for b in range(buckets + 1)]
        self.edges = np.searchsorted(self.keys, self.lows).tolist()


def _order(words: list[bytes], buckets: int) -> tuple[np.ndarray, list[int]]:
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(buckets + 1)).tolist()


_CUT = "kind string, block long, bucket int, start long, payload binary"


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = task_number()
        for number, table in enumerate(blocks(batches, "text", BLOCK)):
            known = {END: 0}
            codes, counts = _codes([t for c in table.column("text").chunks for t in binary(c).to_pylist()], known)
            words, every, counts = list(known), np.concatenate(codes), np.array(counts, np.int64)
            learn = np.array(table.column("learn").to_pylist(), bool)
            walk = Walk(every, counts, learn, words, buckets)
            rows = table.drop_columns(["text"]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            block = (task << 24) + number
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            out = [("block", block, 0, 0, pack(sink.getvalue().to_pybytes(), counts, every, lengths, b"".join(words)))]
            order, edges = _order(words, buckets)
            for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    body = pack_words([words[i] for i in order[a:b].tolist()]) + pack(walk.word_counts[order[a:b]])
                    out.append(("words", block, bucket, a, body))
            for bucket, (a, b) in enumerate(zip(walk.edges, walk.edges[1:])):
                if b > a:
                    gaps = np.diff(walk.keys[a:b], prepend=walk.lows[bucket])
                    out.append(("pairs", block, bucket, a, pack(gaps, walk.pair_counts[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                _names(_CUT),
            )

    return run


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


_SUMS = "kind string, block long, start long, payload binary, distinct_words long, tokens long"


def _sum_words(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
    total: dict[bytes, int] = {}
    parts = []
    for block, start, payload in rows:
        lengths, joined, counts = unpack(payload)
        words = unpack_words(lengths, joined)
        parts.append((block, start, words))
        for w, n in zip(words, counts.tolist()):
            total[w] = total.get(w, 0) + n
    out = [("words", block, start, pack(np.fromiter((total[w] for w in words), np.int64, len(words))), 0, 0) for block, start, words in parts]
    seen = [n for n in total.values() if n]
    return [*out, ("words", None, 0, None, len(seen), sum(seen))]


def _sum_pairs(rows: list[tuple[int, int, bytes]]) -> list[tuple]:
    parts = [(block, start, *unpack(payload)) for block, start, payload in rows]
    keys = np.concatenate([np.cumsum(gaps) for _, _, gaps, _ in parts])
    own = np.concatenate([counts for *_, counts in parts])
    _, at = np.unique(keys, return_inverse=True)
    rest = np.bincount(at, weights=own).astype(np.int64)[at] - own
    out, first = [], 0
    for block, start, gaps, _ in parts:
        mine = rest[first : first + len(gaps)]
        first += len(gaps)
        some = np.flatnonzero(mine)
        if len(some):
            out.append(("pairs", block, start, pack(np.diff(some, prepend=0), mine[some]), 0, 0))
    return out


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(key, rows):
        found = (_sum_words if key[0] == "words" else _sum_pairs)(rows)
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        columns = list(zip(*found)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _names(_SUMS))

    now, rows = None, []
    for batch in batches:
        for kind, bucket, *row in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block", "start", "payload"))):
            if (kind, bucket) != now:
                if rows:
                    yield done(now, rows)
                now, rows = (kind, bucket), []
            rows.append(row)
    if rows:
        yield done(now, rows)


def _score(buckets: int, distinct: int, tokens: int, prior: float, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        sums = {kind: [] for kind in ("words", "pairs")}
        for kind, start, payload in zip(*(right.column(c).to_pylist() for c in ("kind", "start", "payload"))):
            sums[kind].append((start, payload))
        for payload in left.column("payload").to_pylist():
            raw, counts, codes, lengths, joined = unpack(payload)
            rows = pa.ipc.open_stream(raw).read_all()
            words = unpack_words(lengths, joined)
            walk = Walk(codes, counts, np.array(rows.column("learn").to_pylist(), bool), words, buckets)
            order, _ = _order(words, buckets)
            seen = np.zeros(len(words), np.int64)
            for start, body in sums["words"]:
                (found,) = unpack(body)
                seen[order[start : start + len(found)]] = found
            arcs = walk.pair_counts.copy()
            for start, body in sums["pairs"]:
                gaps, rest = unpack(body)
                arcs[start + np.cumsum(gaps)] += rest
            unigram = (seen + 1) / (tokens + distinct + 1)
            fail = np.log10(prior / (seen + prior))
            count = arcs[walk.pair_of_token]
            with_arc = np.log10((count + prior * unigram[walk.token]) / (seen[walk.history] + prior))
            base = np.log10(unigram)
            step = np.where(count > 0, with_arc, fail[walk.history] + base[walk.token])
            add = np.add.reduceat
            made = [
                pa.array(counts + 1),
                pa.array(add((seen[walk.token] > 0).astype(np.int64), walk.first)),
                pa.array(np.full(len(counts), tokens, np.int64)),
                pa.array(add(base[walk.token], walk.first)),
                pa.array(add(step, walk.first)),
            ]
            out.append(pa.Table.from_arrays([*rows.drop_columns(["learn"]).columns, *made], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None, prior: float = PRIOR) -> DataFrame:
    """Per document: tokens, known tokens, training tokens, unigram score and the automaton's log10 probability.

    ``learn`` marks the rows that the model is counted from, all of them.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    prepare(spark)
    marked = docs.withColumn("__learn", F.coalesce(learn, F.lit(False)))
    texts = pick(marked, doc_id=id_col, text=text_col, learn="__learn", **(keep or {}))
    buckets = bucket_count(texts, "text")
    cut = Bucketed(texts.mapInArrow(_cut(buckets), _CUT), "lm", "block", buckets, "kind")
    asked = cut.read().where("kind != 'block'").select("kind", "bucket", "block", "start", "payload")
    order = ("kind", "bucket")
    sums = Stored(asked.repartition(*order).sortWithinPartitions(*order).mapInArrow(_sum, _SUMS), "lm-sums")
    distinct, tokens = sums.read().agg(F.sum("distinct_words"), F.sum("tokens")).first()
    held = cut.read().where("kind = 'block'").select("block", "payload")
    given = sums.read().where("block is not null").select("kind", "block", "start", "payload")
    kept = [f for f in texts.schema.fields if f.name not in ("text", "learn")]
    made = StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    schema = StructType([*kept, *made.fields])
    walk = _score(buckets, distinct or 0, tokens or 0, prior, to_arrow_schema(schema))
    return held.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(walk, schema)
