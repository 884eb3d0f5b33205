"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

A task cuts its texts into pre-tokens and keeps, for each block of texts, the
positions of the block's distinct pre-tokens. Only the distinct pre-tokens are
shuffled: bucketed by their hash, so each is encoded once for the whole table.
Their ids return to the blocks and are laid out by position. Decoding joins
the ids with the table of token bytes.

A block is worked off in sections, so that a worker holds a block's distinct
pre-tokens and one section's texts, positions or ids, however large the block.

A null text counts as empty and has no ids. Rows are kept as they are: repeated
rows and null identifiers stay, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gistworks.functions.batches import hand_back, handing_back, parts
from gistworks.llm.common import BLOCK_BYTES, Bucketed, bucket_count, pack, pack_words, pick, prepare, task_number, unpack, unpack_words

#: Bytes of rows that are Python objects at once; a larger row stands alone.
SECTION_BYTES = 512 << 10


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file; a few MB whatever the data."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merger(ranks: dict[bytes, int]) -> Callable[[bytes], list[int]]:
    """Encodes one pre-token: adjacent parts merge, lowest rank first."""
    import tiktoken

    encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return encoding._encode_single_piece


class TokenBytes:
    """The token-byte table as one byte array with offsets, for joins by id."""

    def __init__(self, ranks: dict[bytes, int]):
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


_CUT = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("start", pa.int64()), ("payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def _section(part: pa.RecordBatch, find: Callable[[str], list[str]], known: dict[str, int], kept: list[str]) -> bytes:
    """The kept columns of a few rows and the codes of their pre-tokens; new ones become known."""
    codes, counts = [], []
    for text in part.column("text").to_pylist():
        found = find(text) if text else []
        counts.append(len(found))
        codes.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.uint32, len(found)))
    rows = part.select(kept)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_batch(rows)
    return pack(sink.getvalue().to_pybytes(), np.array(counts), np.concatenate(codes))


def _words(block: int, known: dict[str, int], buckets: int) -> pa.RecordBatch:
    """A block's distinct pre-tokens by bucket, and where each code lies in that order."""
    words = [w.encode() for w in known]
    home = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(home, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = [("block", block, 0, -1, pack(rank))]
    edges = np.searchsorted(home[order], np.arange(buckets + 1)).tolist()
    for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            out.append(("words", block, bucket, a, pack_words([words[i] for i in order[a:b].tolist()])))
    return _rows(out)


def _cut(pattern: str, buckets: int, kept: list[str]):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, block = regex.compile(pattern).findall, task_number() << 24
        known: dict[str, int] = {}
        number = size = 0
        for batch in batches:
            for part in parts(batch, SECTION_BYTES):
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if number and size + more > BLOCK_BYTES:
                    yield _words(block, known, buckets)
                    block, known, number, size = block + 1, {}, 0, 0
                yield _rows([("block", block, 0, number, _section(part, find, known, kept))])
                number, size = number + 1, size + more
        if number:
            yield _words(block, known, buckets)

    return run


def _encode(ranks):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, now, known = merger(ranks.value), None, {}
        for batch in batches:
            for bucket, block, start, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "start", "payload"))):
                if bucket != now:
                    now, known = bucket, {}
                ids = []
                for word in unpack_words(*unpack(payload)):
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word)
                    ids.append(got)
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([pack(sizes, flat)], pa.binary())],
                    ["block", "start", "payload"],
                )

    return run


def _join(ranks, finish, schema: pa.Schema):
    held = []

    def laid(left: pa.Table, right: pa.Table) -> pa.Table:
        if not held:
            held.append(TokenBytes(ranks.value))
        starts, payloads = right.column("start").to_pylist(), right.column("payload")
        pieces = [unpack(payloads[k].as_py()) for k in sorted(range(len(starts)), key=starts.__getitem__)]
        sizes = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.int64)
        flat = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        del pieces
        numbers, payloads = left.column("start").to_pylist(), left.column("payload")
        first, *sections = sorted(range(len(numbers)), key=numbers.__getitem__)
        (rank,) = unpack(payloads[first].as_py())
        return pa.concat_tables([_lay(payloads[k].as_py(), rank, sizes, starts, flat, finish, held[0], schema) for k in sections])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:  # Spark counts the arguments
        try:
            return laid(left, right)
        finally:
            hand_back()

    return run


def _lay(payload: bytes, rank: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray, finish, table: TokenBytes, schema: pa.Schema) -> pa.Table:
    """A section's rows with what is made of their ids."""
    raw, counts, codes = unpack(payload)
    rows = pa.ipc.open_stream(raw).read_all()
    results, at = [], 0
    for n in counts.tolist():
        words = rank[codes[at : at + n]]
        at += n
        lengths = sizes[words]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if n else 0
        ids = flat[np.arange(total) + np.repeat(starts[words] - ends + lengths, lengths)] if total else flat[:0]
        results.append(finish(ids, table))
    made = (pa.array(c, f.type) for c, f in zip(zip(*results), list(schema)[rows.num_columns :]))
    return pa.Table.from_arrays([*rows.columns, *made], schema=schema)


def as_digest(ids: np.ndarray, table: TokenBytes) -> tuple:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(table.decode(ids)).hexdigest()


def as_ids(ids: np.ndarray, table: TokenBytes) -> tuple:
    return ids.astype(np.int32), table.decode(ids)


#: What may be made of each document's ids: columns and the function for one document.
FORMS = {
    "digest": ("n_tokens long, ids_sha256 string, decoded_sha256 string", as_digest),
    "ids": ("ids array<int>, decoded binary", as_ids),
}


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", form: str = "ids", keep: dict[str, str] | None = None) -> DataFrame:
    """Every text's ids and their decoded bytes, or digests of both, by identifier.

    ``keep`` names further columns to carry along (new name: old name).
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = pick(docs, doc_id=id_col, text=text_col, **(keep or {}))
    kept = [c for c in texts.columns if c != "text"]
    buckets = bucket_count(texts, "text")
    # Kept: shipped once to each executor, a few MB by the vocabulary's size.
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    cut = Bucketed(
        texts.mapInArrow(_cut(pattern, buckets, kept), "kind string, block long, bucket int, start long, payload binary"),
        "bpe", "block", buckets, "kind",
    )
    words = cut.read().where("kind = 'words'").select("bucket", "block", "start", "payload")
    shared = words.repartition("bucket").sortWithinPartitions("bucket")
    coded = shared.mapInArrow(_encode(ranks), "block long, start long, payload binary")
    columns, finish = FORMS[form]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([*texts.select(*kept).schema.fields, *StructType.fromDDL(columns).fields])
    held = cut.read().where("kind = 'block'").select("block", "start", "payload")
    return held.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(_join(ranks, finish, to_arrow_schema(schema)), schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of a column of ids; null ids give null bytes."""
    spark = coded.sparkSession
    prepare(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def to_bytes(ids: pa.Array) -> pa.Array:
        table = TokenBytes(ranks.value)
        return pa.array([None if x is None else table.decode(np.array(x, np.int64)) for x in ids.to_pylist()], pa.binary())

    return coded.withColumn(out_col, to_bytes(F.col(f"`{ids_col}`")))
