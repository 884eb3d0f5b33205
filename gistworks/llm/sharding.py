"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

Below each node of the tree every child draws -ln(u) / weight with u hashed
from the row's key, the tree level and the child's name; the row goes down to
the smallest draw. Draws depend on nothing else, so a changed weight moves
rows only into (or out of) the subtree whose weight changed: rows of other
subtrees keep all their draws and their place.

Shards fill racks of four and regions of two racks. A shard that opens a new
region is that region's only leaf, so growing from 40 to 41 shards takes rows
only into the new shard. Growing inside a region also deals that region's own
rows anew between its shards.

A null key hashes as the text "null"; a null text has no bytes and CRC 0.
Repeated rows have one key and so one shard, and slots of their own. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gistworks.llm.common import Stored, pick

LEVELS = ("region", "rack", "shard")
#: Shards below one node of each level.
SPANS = (8, 4, 1)
_SCALE = float(1 << 48)


def _looked_up(values: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def shard_of(rows: DataFrame, key: Column, shards: int, out: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Adds the shard: level by level, the child of the current node with the smallest draw.

    A node weighs what its shards weigh, 1 each by default. A draw takes 48
    bits of the MD5 of the node's name and the key.
    """
    weights = weights or {}
    leaves = [float(weights.get(s, 1.0)) for s in range(shards)]
    above = shards
    rows = rows.withColumn("__node", F.lit(0))
    for level, span in zip(LEVELS, SPANS):
        weight = [sum(leaves[at : at + span]) for at in range(0, shards, span)]
        fan = -(-above // span)
        drawn = []
        for k in range(min(fan, len(weight))):
            child = F.col("__node") * fan + k
            digits = F.substring(F.md5(F.concat(F.lit(level), child.cast("string"), F.lit(":"), key)), 1, 12)
            u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(_SCALE)
            there = F.when(child < len(weight), F.struct((-F.log(u) / _looked_up(weight, F.least(child, F.lit(len(weight) - 1)))).alias("at"), child.alias("child")))
            drawn.append(there)
        taken = F.least(*drawn) if len(drawn) > 1 else drawn[0]
        rows = rows.withColumn("__node", taken["child"])
        above = span
    return rows.withColumnRenamed("__node", out)


def place(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", weights: dict[int, float] | None = None) -> DataFrame:
    """Each row's shard, its gapless slot in it, and its shard with one shard more.

    Slots number a shard's rows by identifier, CRC and size. Rows are sorted
    by range over all tasks, counted by (shard, task), and numbered from their
    place in the task: no task holds a whole shard, nor all of one identifier.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = shard_of(pick(docs, doc_id=id_col, text=text_col), key, shards, "shard", weights)
    placed = shard_of(placed, key, shards + 1, "grown_shard", weights)
    rows = placed.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        "shard", "grown_shard",
        F.monotonically_increasing_id().alias("row"),
    )
    stored = Stored(rows, "shards")
    order = ("shard", "doc_id", "text_crc32", "size", "row")
    ranged = stored.read().repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = Stored(
        ranged.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "slots"
    )
    stored.drop()
    # One row for each task's share of a shard: tasks + shards rows, as ranges are contiguous.
    shares = numbered.read().groupBy("shard", "task").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    slots = numbered.read().join(F.broadcast(shares.select("shard", "task", "offset")), ["shard", "task"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") + F.col("offset")).alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )
