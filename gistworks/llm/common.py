"""Shared pieces: stored stages, packed payloads, blocks of texts, components."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from gistworks.session import scratch_path, ship_package

#: Bytes of text that one block holds; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Make the operators importable in Python workers."""
    ship_package(spark)


class Stored:
    """A table written once to the shared folder; ``drop`` deletes it when no later step reads it."""

    def __init__(self, df: DataFrame, label: str, *partition: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = scratch_path(self.spark, label)
        (df.write.partitionBy(*partition) if partition else df.write).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: Most buckets a table is laid out in; Spark takes 100,000.
LAID = 50_000


class Bucketed(Stored):
    """A stored table laid out by a key in ``n`` buckets (LAID at most), so that a later grouping by it moves only the other side.

    The layout is of whole blocks, several to a bucket, and bounds nothing: a
    grouping by the key still holds one block at a time.
    """

    def __init__(self, df: DataFrame, label: str, key: str, n: int, *partition: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = scratch_path(self.spark, label)
        self.name = f"scratch_{label.replace('-', '_')}_{self.path[-32:]}"
        df.write.partitionBy(*partition).bucketBy(min(n, LAID), key).option("path", self.path).format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        super().drop()


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def task_number() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# Packed payloads: arrays of integers in their smallest width, byte planes apart, compressed.


def pack(*parts: np.ndarray | bytes) -> bytes:
    out = []
    for part in parts:
        if isinstance(part, bytes):
            kind, n, raw = 0, len(part), part
        else:
            top = int(part.max()) if len(part) else 0
            kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            n = len(part)
            raw = part.astype(f"<u{kind}").view(np.uint8).reshape(n, kind).T.tobytes() if n else b""
        body = zstandard.ZstdCompressor(level=1).compress(raw)
        out += [struct.pack("<BQQ", kind, n, len(body)), body]
    return b"".join(out)


def unpack(payload: bytes) -> list:
    out, at = [], 0
    while at < len(payload):
        kind, n, size = struct.unpack_from("<BQQ", payload, at)
        at += 17
        raw = zstandard.ZstdDecompressor().decompress(payload[at : at + size], max_output_size=max(1, n * max(kind, 1)))
        at += size
        if kind == 0:
            out.append(raw)
        else:
            planes = np.frombuffer(raw, np.uint8).reshape(kind, n)
            out.append(np.ascontiguousarray(planes.T).view(f"<u{kind}").reshape(n).astype(np.int64 if kind < 8 else np.uint64))
    return out


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return pack(lengths, b"".join(words))


def unpack_words(lengths: np.ndarray, joined: bytes) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends)] if ends else []


def binary(column: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column, without decoding; nulls stay."""
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The task's rows in runs of at most ``limit`` bytes of text; a longer row stands alone."""
    held, size = [], 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, n in enumerate(lengths.tolist()):
            if size and size + n > limit:
                if k > start:
                    held.append(batch.slice(start, k - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k
            size += n
        if len(batch) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def bucket_count(texts: DataFrame, text: str, per_bucket: int = 8 << 20) -> int:
    """Buckets for a shuffle of distinct words: one for each ``per_bucket`` bytes of text, at least 24."""
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(24, -(-total // per_bucket))


# Connected components.


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) with the smallest node reachable as label, for each node that has a link.

    Large-star and small-star steps: every node is linked to the smallest
    neighbour until nothing changes. Each step is a map-side minimum by node
    and a join on it, so a node with very many links is aggregated before it
    is shuffled and split by the skew join after; each round is stored.
    """
    x, y = F.col(a), F.col(b)
    links = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = Stored(links, "links")
    seen = None
    while True:
        e = now.read()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        step = Stored(large, "links")
        e = step.read()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        small = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = Stored(small, "links")
        now.drop()
        step.drop()
        now = after
        mark = now.read().agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


# Labelled samples.


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", one_each: bool = False) -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows, those whose identifiers' hashes are smallest.

    An identifier labelled more than once counts once, with its largest label;
    null identifiers, labels and texts are left out. The bound on the sample
    is what makes its identifiers safe to broadcast. With ``one_each`` an
    identifier of several rows gives the one whose text has the smallest hash,
    so that rows are bounded too.
    """
    known = pick(labels, doc_id=label_id_col, label=label).where("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    found = texts.join(F.broadcast(chosen), "doc_id")
    if one_each:
        found = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"), F.first("label").alias("label")).withColumn("text", F.col("least.text"))
    return found.select("text", "label")
