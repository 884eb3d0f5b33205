"""A Merkle manifest of a table by time-forward processing.

Each row is a leaf, each group of rows a tree, the trees' tops the leaves of the
last tree. A node's label is (chunk, last leaf below it, level): children come
before parents. Digests travel upwards as messages through an external priority
queue ordered by label; what a node took in is logged. A second sweep goes
through the log from its end, in reversed order of labels, and sends every child
its siblings and what its parent was sent: the proof's rest up to the root.

A chunk is 256 neighbouring nodes of one tree, two levels of 16. Chunks are
dealt out by Spark, their tops are the nodes of the next round, so a tree that
holds most of the rows is many chunks, and a round shrinks the table 256-fold:
five rounds for 10^12 rows. Texts are read once and never shuffled.

A null value counts as ``-``, an empty text as ``0:``; rows with equal
identifiers are ordered by their leaves, equal rows are leaves of their own.
A null group is a tree, the first. An empty table gives no rows. Columns
beyond the named ones play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gistworks.llm.common import Stored, pick, prepare
from gistworks.llm.queues import MessageQueue
from gistworks.llm.ranks import ranked

FAN, LEVELS = 16, 2
CHUNK = FAN**LEVELS

_STEP = "struct<left:string,right:string>"
_NODE = "tree string, at long, size long, digest string"


def sha(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 over the values, each as its UTF-8 size, a colon and itself, or ``-`` if null."""
    told = []
    for v in values:
        text = v.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to, with built-in functions only."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


# Sweeps over one chunk.


def levels_of(size: int) -> int:
    """Levels that a chunk of a tree of ``size`` nodes rises."""
    n, up = size, 0
    while n > 1 and up < LEVELS:
        n, up = -(-n // FAN), up + 1
    return up


def _label(chunk: int, level: int, index: int, count: int) -> tuple:
    return (chunk, min((index + 1) * FAN**level, count) - 1, level)


def sweep_up(queue: MessageQueue, chunk: int, digests: list[str], size: int) -> tuple[str, list]:
    """The chunk's top digest, and the log of (level, index, children) in the order of labels."""
    count, top, log = len(digests), levels_of(size), []
    if not top:
        return digests[0], log
    root = ""

    def settle(before: tuple) -> None:
        nonlocal root
        while queue and queue.next_label() < before:
            label, digest = queue.receive()
            children = [digest]
            while queue and queue.next_label()[:4] == label[:4]:
                children.append(queue.receive()[1])
            _, _, level, index, _ = label
            log.append((level, index, children))
            if level == top:
                root = sha(children)
            else:
                up = index // FAN
                queue.send((*_label(chunk, level + 1, up, count), up, index), sha(children))

    for at, digest in enumerate(digests):
        settle((chunk, at, -1))
        queue.send((*_label(chunk, 1, at // FAN, count), at // FAN, at), digest)
    settle((chunk, count))
    return root, log


def sweep_down(queue: MessageQueue, log: list, count: int, top: int, rest: list) -> Iterator[tuple[int, list]]:
    """(position, proof) of each leaf, from the last to the first; ``rest`` is what the chunk's top was sent."""
    if not top:
        yield 0, rest
        return
    back = lambda level, index: tuple(-x for x in _label(0, level, index, count))
    queue.send((*back(top, 0), 0), rest)
    for level, index, children in reversed(log):
        _, sent = queue.receive()
        for k, child in enumerate(range(index * FAN, index * FAN + len(children))):
            step = ("".join(children[:k]), "".join(children[k + 1 :]))
            queue.send((*back(level - 1, child), -child), [step, *sent])
        while queue and queue.next_label()[2] == 0:
            label, proof = queue.receive()
            yield -label[3], proof


# Tasks: rows come by tree, chunk and position.


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["tree"], row["chunk"])
            if held and now != key:
                yield held
                held = []
            key = now
            held.append(row)
    if held:
        yield held


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == each:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _up(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            queue = MessageQueue()
            for number, chunk in enumerate(_chunks(batches)):
                size = chunk[0]["size"]
                root, _ = sweep_up(queue, number, [r["digest"] for r in chunk], size)
                yield chunk[0]["tree"], chunk[0]["chunk"], -(-size // CHUNK), root

        return _batches(rows(), schema)

    return run


def _down(finish, kept: list[str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            queue = MessageQueue()
            for chunk in _chunks(batches):
                message, nodes = chunk[0], chunk[1:]
                size = nodes[0]["size"]
                _, log = sweep_up(queue, 0, [r["digest"] for r in nodes], size)
                rest = [(s["left"], s["right"]) for s in message["proof"]]
                for at, proof in sweep_down(queue, log, len(nodes), levels_of(size), rest):
                    row = nodes[at]
                    yield (*(row[c] for c in kept), message["subroot"], *finish(row, proof))

        return _batches(rows(), schema)

    return run


def as_proof(row: dict, proof: list) -> tuple:
    return ([{"left": a, "right": b} for a, b in proof],)


def as_digest(row: dict, proof: list) -> tuple:
    """Hash of all siblings; root that the changed leaf, or else the leaf, leads to."""
    digest = row["digest"] if row.get("changed") is None else row["changed"]
    for left, right in proof:
        digest = sha((left, digest, right))
    return sha(s for step in proof for s in step), digest


FORMS = {
    "proof": (f"proof array<{_STEP}>", as_proof),
    "digest": ("proof_sha256 string, folded_root string", as_digest),
}


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "at")


def _rise(nodes: Stored) -> tuple[list[Stored], DataFrame | None]:
    """Rounds of nodes from the given ones up, and the trees' tops as (tree, digest)."""
    schema = StructType.fromDDL(_NODE)
    rounds, tops = [nodes], None
    while True:
        here = rounds[-1].read().withColumn("chunk", F.shiftright("at", 8))
        above = Stored(_dealt(here.select("tree", "chunk", "at", "size", "digest")).mapInArrow(_up(_arrow(schema)), schema), "merkle-nodes")
        done = above.read().where("size = 1").select("tree", "digest")
        tops = done if tops is None else tops.unionByName(done)
        more = above.read().where("size > 1")
        if more.isEmpty():
            return rounds, tops
        rounds.append(Stored(more, "merkle-nodes"))


def _sink(rounds: list[Stored], sent: DataFrame, kept: list[str], form: str) -> DataFrame:
    """Proofs of the first round's nodes from the messages (tree, subroot, proof) to the trees' tops.

    A message to a tree goes to the round in which the tree has a single chunk.
    """
    for k in range(len(rounds) - 1, -1, -1):
        nodes = rounds[k].read().withColumn("chunk", F.shiftright("at", 8))
        own = kept if k == 0 else ["tree", "at"]
        columns, finish = FORMS[form if k == 0 else "proof"]
        extra = [c for c in nodes.columns if c not in ("tree", "chunk", "at", "size", "digest")] if k == 0 else []
        rows = nodes.select("tree", "chunk", "at", "size", "digest", *extra)
        # Trees that end in this round hear from the last tree; all others from the round above.
        ends = rows.where(f"at = 0 and size <= {CHUNK}").select(F.col("tree").alias("t"))
        first = sent.join(ends, sent["tree"].eqNullSafe(F.col("t"))).select("tree", F.lit(0).cast("long").alias("chunk"), "subroot", "proof")
        if k < len(rounds) - 1:
            first = first.unionByName(below.select("tree", F.col("at").alias("chunk"), "subroot", "proof"))
        messages = first.withColumn("at", F.lit(-1).cast("long"))
        both = rows.unionByName(messages, allowMissingColumns=True)
        types = {f.name: f for f in both.schema.fields}
        schema = StructType([types[c] for c in own] + [StructField("subroot", StringType())] + StructType.fromDDL(columns).fields)
        below = _dealt(both).mapInArrow(_down(finish, own, _arrow(schema)), schema)
        if k:
            below = Stored(below, "merkle-proofs").read()
    return below


def manifest(
    docs: DataFrame, fields: list[str], group_col: str, order_col: str, changed: Column | None = None, form: str = "proof", keep: dict[str, str] | None = None
) -> tuple[DataFrame, str | None]:
    """Every row's leaf, its tree's top and its proof; and the root.

    ``fields`` make up a leaf, in this order; ``changed`` may give, under their
    own names, a leaf digest to be checked against the proof in place of the
    row's own (null: its own). Columns: those of ``keep`` (new name: old name),
    leaf, subroot, and by ``form`` the proof itself or its digests. The root is
    one digest, brought to the driver; null for an empty table.
    """
    prepare(docs.sparkSession)
    keep = keep or {}
    taken = [
        docs[f"`{group_col}`"].cast("string").alias("tree"), docs[f"`{order_col}`"].alias("place"),
        leaf_digest([docs[f"`{c}`"] for c in fields]).alias("digest"),
        (F.lit(None) if changed is None else changed).cast("string").alias("changed"),
        *(docs[f"`{old}`"].alias(f"keep_{new}") for new, old in keep.items()),
    ]
    leaves = Stored(docs.select(*taken), "merkle-leaves")
    placed, held = ranked(leaves.read(), "tree", [F.col("place"), F.col("digest")], "merkle-ranked")
    nodes = Stored(placed.drop("place"), "merkle-nodes")
    held.drop()
    rounds, tops = _rise(nodes)
    ordered, held = ranked(tops.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", [F.col("name")], "merkle-trees")
    last, crowns = _rise(Stored(ordered, "merkle-tops"))
    root = (crowns.first() or [None, None])[1]
    start = crowns.select("tree", F.lit(None).cast("string").alias("subroot"), F.array().cast(f"array<{_STEP}>").alias("proof"))
    named = _sink(last, start, ["name", "digest"], "proof")
    sent = Stored(named.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof"), "merkle-sent").read()
    kept = ["digest", *(f"keep_{c}" for c in keep)]
    out = _sink(rounds, sent, kept, form)
    names = [c for c in out.columns if c not in (*kept, "subroot")]
    return out.select(*(F.col(f"keep_{c}").alias(c) for c in keep), F.col("digest").alias("leaf"), "subroot", *names), root


def without_capitals(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
