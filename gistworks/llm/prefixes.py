"""The trie of conversation prefixes from sorted conversations and their common prefixes.

Conversations are sorted as sequences of turns, range-partitioned. A task cuts
its sorted rows into chunks, takes the common prefix (LCP) of neighbours and
builds a sparse table of range minima over them. Every prefix of every row is a
candidate: it binary-searches, independently of all others and without a stack,
how far to the left and to the right the minimum stays at least as long as
itself. That interval holds the prefix's members; it is a node, and sums over
it are differences of running sums:

* a row is a leaf's last if its successor shares less than the whole row;
* with S(d) the code points of a row's first d turns, a row repeats S(LCP) of
  them, so a subtree's saved tokens are the sum of S(LCP) over the interval's
  rows but the first, less S(depth - 1) for each.

A node whose interval touches a chunk's end is *open*: it may go on in the next
chunk. Its sums are added up by key in Spark, with corrections for the rows at
the border, which each chunk takes for strangers. There are at most two paths
of open nodes a chunk.

A turn is known by the first 128 bits of its SHA-256 (role and text): texts are
not shuffled. Turns are numbered by a range sort, in blocks of 64, so a
conversation with most of all turns is no single task's. Only the turns up to
the end of the first block that no other conversation shares are sorted; what
follows is a chain of nodes with one member, made from the turns as they lie.
So a row's size is bounded by the length of a prefix that two conversations
share, 16 bytes a turn.

Null roles and texts count as empty; turns are ordered by turn (null first),
then role, then the text's digest; repeated turns stay. Rows without a conv_id
belong to no conversation. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from gistworks.llm.common import Stored, pick, prepare, task_number
from gistworks.llm.ranks import ranked

#: Turns in a block, bytes of a turn's digest.
BLOCK, WIDTH = 64, 16
#: Rows and bytes of turns that a chunk holds at most (a longer row stands alone).
CHUNK_ROWS, CHUNK_BYTES = 1 << 15, 16 << 20

ROOT = b"root"
_OUT = (
    "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, node binary, parent binary, part int, keys binary, lens binary, n_turns long, ids binary"
)
#: Kinds of rows: whole nodes, parts of open nodes, rows at a task's ends, identifiers of an open node's whole members.
CLOSED, OPEN, EDGE, ENDS = range(4)
EMPTY = hashlib.sha256().hexdigest()


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, Stored]:
    """(conv_id, at, size, key, len): each turn's position, digest and code points."""
    rows = pick(turns, conv_id=conv, turn=turn, role=role, text=text).where("conv_id is not null")
    said, who = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256)
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", who.alias("role"), F.sha2(said, 256).alias("order"),
        F.unhex(F.substring(digest, 1, 2 * WIDTH)).alias("key"), F.length(said).cast("long").alias("len"),
    )
    kept = Stored(slim, "trie-turns")
    made, held = ranked(kept.read(), "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("order")], "trie-ranked")
    return made.select("conv_id", "at", "size", "key", "len"), held


def rebuilt(turns: DataFrame, base: Callable[[Column], Column], heads: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another: (conv_id, pos, key, len) and (conv_id, n_turns).

    The first ``heads`` turns of conversation ``base`` (all, if it has fewer),
    then the conversation's own turns after its first ``heads``. ``heads`` must
    be bounded; only so many turns of a base are copied.
    """
    rows = Stored(turns, "trie-numbered")
    t = rows.read()
    sizes = t.where("at = 0").select("conv_id", "size")
    convs = sizes.withColumn("base", base(F.col("conv_id"))).withColumn("h", heads(F.col("conv_id")).cast("long"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("n_base", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = Stored(convs.withColumn("n_turns", F.col("n_base") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-convs").read()
    wanted = convs.where("n_base > 0").select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_base") - 1)).alias("pos"), "base")
    first = wanted.join(t.select(F.col("conv_id").alias("base"), F.col("at").alias("pos"), "key", "len"), ["base", "pos"])
    own = t.join(convs.select("conv_id", "h", "n_base"), "conv_id").where("at >= h").withColumn("pos", F.col("at") - F.col("h") + F.col("n_base"))
    columns = ["conv_id", "pos", "key", "len"]
    return first.select(*columns).unionByName(own.select(*columns)), convs.select("conv_id", "n_turns")


def _rows_to_sort(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per conversation with its turns up to the first block it shares with nobody; and the turns after."""
    # A block's turns in order: at most BLOCK values to a group.
    packed = F.sort_array(F.collect_list(F.struct("pos", "key", "len")))
    blocks = turns.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("conv_id", "block").agg(packed.alias("turns"))
    blocks = blocks.select("conv_id", "block", F.expr("aggregate(turns.key, cast('' as binary), (a, x) -> concat(a, x))").alias("keys"), F.col("turns.len").alias("lens"))
    blocks = Stored(blocks, "trie-blocks").read()
    # Whole prefixes at the blocks' ends, known by 128 bits: which of them are shared?
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    whole = blocks.where(F.octet_length("keys") == BLOCK * WIDTH)
    marks = whole.select(
        "conv_id", "block",
        F.bit_xor(F.xxhash64("block", "keys")).over(so_far).alias("a"), F.bit_xor(F.xxhash64("keys", F.col("block") + 1, F.lit("b"))).over(so_far).alias("b"),
    )
    shared = marks.groupBy("block", "a", "b").agg(F.count("*").alias("n")).where("n > 1").select("block", "a", "b")
    deepest = marks.join(shared, ["block", "a", "b"]).groupBy("conv_id").agg(F.max("block").alias("deepest"))
    limits = convs.join(deepest, "conv_id", "left").select("conv_id", "n_turns", (F.coalesce("deepest", F.lit(-1)) + 1).alias("last"))
    limits = Stored(limits, "trie-limits").read()
    kept = blocks.join(limits, "conv_id", "right").where("block is null or block <= last")
    parts = F.sort_array(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "keys", "lens"))))
    rows = kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), parts.alias("parts"))
    rows = rows.select(
        "conv_id", "n_turns", F.expr("aggregate(parts.keys, cast('' as binary), (a, x) -> concat(a, x))").alias("keys"), F.flatten("parts.lens").alias("lens")
    )
    long = limits.where(F.col("n_turns") > (F.col("last") + 1) * BLOCK)
    after = turns.join(long, "conv_id").where(F.col("pos") >= (F.col("last") + 1) * BLOCK)
    return rows, after.select("conv_id", "pos", "n_turns")


# One chunk of sorted rows.


class Chunk:
    """Rows in order: identifiers, turns' digests, code points, number of all turns."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.total = np.array([r[1] for r in rows], np.int64)
        self.keys = np.frombuffer(bytearray(b"".join(r[2] for r in rows)), f"V{WIDTH}")
        self.m = np.array([len(r[2]) // WIDTH for r in rows], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.m)))
        lens = np.concatenate([np.asarray(r[3], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        run = np.concatenate(([0], np.cumsum(lens)))
        #: S(d) of row i stands at start[i] + i + d.
        self.s_start = self.start + np.arange(len(self.m) + 1)
        self.sums = np.concatenate([run[a : b + 1] - run[a] for a, b in zip(self.start[:-1], self.start[1:])])
        self.n = len(rows)
        self.lcp = self._common()

    def _common(self) -> np.ndarray:
        """LCP of each row with the row before, -1 for the first."""
        out = np.zeros(self.n, np.int64)
        out[:1] = -1
        rows = np.arange(1, self.n)
        for d in range(int(self.m.max(initial=0))):
            rows = rows[(self.m[rows] > d) & (self.m[rows - 1] > d)]
            rows = rows[self.keys[self.start[rows] + d] == self.keys[self.start[rows - 1] + d]]
            if not len(rows):
                break
            out[rows] += 1
        return out

    @staticmethod
    def table(values: np.ndarray) -> list[np.ndarray]:
        """Sparse table: level k holds minima of 2^k neighbours."""
        levels = [values]
        while 2 << (len(levels) - 1) <= len(values):
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        return levels

    @staticmethod
    def least(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima over a..b, both included."""
        k = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), levels[0].dtype)
        for level in np.unique(k):
            x = k == level
            out[x] = np.minimum(levels[level][a[x]], levels[level][b[x] - (1 << level) + 1])
        return out

    def extents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, depth, left, right) of every candidate prefix."""
        row = np.repeat(np.arange(self.n), self.m)
        depth = np.arange(len(row)) - self.start[row] + 1
        levels = self.table(self.lcp)
        left, low = row.copy(), np.zeros(len(row), np.int64)  # the answer is in low..left
        while True:
            open_ = np.flatnonzero(low < left)
            if not len(open_):
                break
            mid = (low[open_] + left[open_]) // 2
            fits = self.least(levels, mid + 1, row[open_]) >= depth[open_]
            left[open_[fits]] = mid[fits]
            low[open_[~fits]] = mid[~fits] + 1
        right, high = row.copy(), np.full(len(row), self.n - 1)  # the answer is in right..high
        while True:
            open_ = np.flatnonzero(right < high)
            if not len(open_):
                break
            mid = (right[open_] + high[open_] + 1) // 2
            fits = self.least(levels, row[open_] + 1, mid) >= depth[open_]
            right[open_[fits]] = mid[fits]
            high[open_[~fits]] = mid[~fits] - 1
        return row, depth, left, right

    def prefix(self, i: int, d: int) -> bytes:
        """What tells the node of row i's first d turns apart, for open nodes."""
        if not d:
            return ROOT
        return hashlib.sha256(self.keys[self.start[i] : self.start[i] + d].tobytes()).digest()[:WIDTH]

    def rows(self) -> Iterator[tuple]:
        """The chunk's closed nodes, its parts of open nodes and the members that end at them."""
        row, depth, left, right = self.extents()
        later = np.concatenate((self.lcp[1:], [-1]))
        leaf = np.concatenate(([0], np.cumsum(later < self.total)))
        shared = np.where(self.lcp > 0, self.sums[self.s_start[:-1] + np.maximum(self.lcp, 0)], 0)
        shared = np.concatenate(([0], np.cumsum(shared)))
        least = self.table(self.ids)
        # A node is told by its first row; the rest of its candidates agree with it.
        own = np.flatnonzero(left == row)
        i, d, r = row[own], depth[own], right[own]
        n, conv = r - i + 1, self.least(least, i, r)
        # Its parent is the node one turn up that holds its first row.
        up = left[np.maximum(self.start[i] + d - 2, 0)]
        place = np.full(len(row), -1)
        place[own] = np.arange(len(own))
        parent = np.where(d > 1, place[self.start[up] + d - 2], -1)
        children = np.bincount(parent[parent >= 0], minlength=len(own))
        tail = np.flatnonzero((self.total > self.m) & (self.m > 0))
        np.add.at(children, place[self.start[left[self.start[tail] + self.m[tail] - 1]] + self.m[tail] - 1], 1)
        saved = shared[r + 1] - shared[i + 1] - (n - 1) * self.sums[self.s_start[i] + d - 1]
        leaves = leaf[r + 1] - leaf[i]
        ends = self._ends(place, left)
        open_ = (i == 0) | (r == self.n - 1)
        whole = {k: hashlib.sha256(x).hexdigest() for k, (_, x) in ends.items() if not open_[k]}
        ids = conv.tolist()
        for k, (a, b, c, e, f, g, p) in enumerate(zip(i.tolist(), d.tolist(), n.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), parent.tolist())):
            # Above an open node all nodes are open, and only those are named by their prefix.
            above = None if p >= 0 and not open_[p] else self.prefix(a, b - 1)
            if open_[k]:
                name = self.prefix(a, b)
                yield OPEN, ids[k], b, None, c, e, f, g, None, name, above, None, None, None, None, None
                if k in ends:
                    yield ENDS, ends[k][0], b, None, None, None, None, None, None, name, None, None, None, None, None, ends[k][1]
            else:
                yield CLOSED, ids[k], b, ids[p] if above is None else None, c, e, f, g, whole.get(k, EMPTY), None, above, None, None, None, None, None
        top = int(((self.lcp < 1) & (self.m > 0)).sum())
        yield OPEN, int(self.ids.min()), 0, None, self.n, top, int(leaf[-1]), int(shared[-1]), None, ROOT, None, None, None, None, None, None
        none = np.flatnonzero(self.m == 0)
        if len(none):
            yield ENDS, int(self.ids[none[0]]), 0, None, None, None, None, None, None, ROOT, None, None, None, None, None, ",".join(map(str, self.ids[none].tolist())).encode()

    def _ends(self, place: np.ndarray, left: np.ndarray) -> dict[int, tuple[int, bytes]]:
        """For each node the first and all identifiers of conversations that end there; rows of equal turns lie by identifier."""
        done = np.flatnonzero((self.total == self.m) & (self.m > 0))
        if not len(done):
            return {}
        at = self.start[done] + self.m[done] - 1
        node = place[self.start[left[at]] + self.m[done] - 1]
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        groups = zip(np.split(node, cuts), np.split(self.ids[done], cuts))
        return {int(k[0]): (int(x[0]), ",".join(map(str, x.tolist())).encode()) for k, x in groups}


def border(a: tuple, b: tuple) -> Iterator[tuple]:
    """What two neighbouring rows, each taken for a stranger by the other, owe the nodes they share.

    The second is no first row of those nodes: it repeats their turns and adds
    no child; the first, if the second goes on from it, ends no leaf.
    """
    m = min(len(a[2]), len(b[2])) // WIDTH
    common = next((d for d in range(m) if a[2][d * WIDTH : (d + 1) * WIDTH] != b[2][d * WIDTH : (d + 1) * WIDTH]), m)
    sums = np.concatenate(([0], np.cumsum(np.asarray(b[3], np.int64)[:common]))).tolist()
    no_leaf = -1 if common >= a[1] else 0
    for d in range(common + 1):
        name = ROOT if not d else hashlib.sha256(b[2][: d * WIDTH]).digest()[:WIDTH]
        above = None if not d else ROOT if d == 1 else hashlib.sha256(b[2][: (d - 1) * WIDTH]).digest()[:WIDTH]
        # saved: S(common) - S(d - 1), where the root has no turn of its own.
        saved = sums[common] - sums[max(d - 1, 0)]
        yield OPEN, b[0], d, None, 0, -1 if d < common else 0, no_leaf, saved, None, name, above, None, None, None, None, None


def _pack(lens) -> bytes:
    return np.asarray(lens, np.int64).tobytes()


def _build(schema: pa.Schema, chunk_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = task_number()
        edge = lambda r: (EDGE, r[0], None, None, None, None, None, None, None, None, None, part, r[2], _pack(r[3]), r[1], None)

        def chunks() -> Iterator[list[tuple]]:
            held, size = [], 0
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "keys", "lens"))):
                    if held and (len(held) == chunk_rows or size + len(row[2]) > CHUNK_BYTES):
                        yield held
                        held, size = [], 0
                    held.append(row)
                    size += len(row[2])
            if held:
                yield held

        def rows() -> Iterator[tuple]:
            before = None
            for held in chunks():
                if before is None:
                    yield edge(held[0])
                else:
                    yield from border(before, held[0])
                yield from Chunk(held).rows()
                before = held[-1]
            if before is not None:
                yield edge(before)

        return _batches(rows(), schema)

    return run


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 4000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == each:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _borders(schema: pa.Schema):
    """Corrections between the last row of a task and the first of the next; rows come as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda x: (x["conv_id"], x["n_turns"], x["keys"], np.frombuffer(x["lens"], np.int64))
        return _batches((out for batch in batches for pair in batch.to_pylist() for out in border(row(pair["a"]), row(pair["b"]))), schema)

    return run


def _hash_ends(schema: pa.Schema):
    """One digest for each open node over the pieces of its list, in order; only one piece is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, sha = None, None
            for batch in batches:
                for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                    if node != now:
                        if now is not None:
                            yield now, sha.hexdigest()
                        now, sha = node, hashlib.sha256(ids)
                    else:
                        sha.update(b",")
                        sha.update(ids)
            if now is not None:
                yield now, sha.hexdigest()

        return _batches(rows(), schema)

    return run


def trie(turns: DataFrame, convs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, pos, key, len) and ``convs`` (conv_id, n_turns).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = turns.sparkSession
    prepare(spark)
    turns, convs = Stored(turns, "trie-rebuilt").read(), Stored(convs, "trie-sizes").read()
    rows, after = _rows_to_sort(turns, convs)
    rows = Stored(rows, "trie-rows").read()
    schema = StructType.fromDDL(_OUT)
    arrow = to_arrow_schema(schema)
    dealt = rows.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    made = Stored(dealt.select("conv_id", "n_turns", "keys", "lens").mapInArrow(_build(arrow, chunk_rows), schema), "trie-nodes").read()

    # Two rows a task: neighbouring tasks' ends, paired in order.
    edges = made.where(f"kind = {EDGE}")
    bounds = edges.groupBy("part").agg(*(agg(F.struct("conv_id", "n_turns", "keys", "lens"), F.struct("keys", "conv_id")).alias(n) for agg, n in ((F.min_by, "first"), (F.max_by, "last"))))
    pairs = bounds.select(F.lag("last").over(Window.orderBy("part")).alias("a"), F.col("first").alias("b")).where("a is not null")
    owed = pairs.mapInArrow(_borders(arrow), schema)

    pieces = made.where(f"kind = {ENDS}").select("node", "conv_id", "ids")
    hashed = StructType.fromDDL("node binary, ends_sha256 string")
    ends = pieces.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hash_ends(to_arrow_schema(hashed)), hashed)

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    opened = made.where(f"kind = {OPEN}").unionByName(owed).groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.first("parent", True).alias("parent"), *sums)
    opened = Stored(opened.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-open").read()
    closed = made.where(f"kind = {CLOSED}")
    above = opened.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = closed.where("parent is not null").join(above, "parent").withColumn("parent_conv_id", F.col("parent_conv"))
    spans = opened.join(above, "parent", "left").withColumn("parent_conv_id", F.col("parent_conv"))
    one = F.lit(1).cast("long")
    chain = after.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("pos") + 1 < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("pos") + 1 == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    out = closed.where("parent is null").select(*columns)
    for more in (below, spans, chain):
        out = out.unionByName(more.select(*columns))
    return out
