"""Removes byte strings that stand in an earlier document, by suffix sorting in shards.

A byte goes if it is covered by a string of ``width`` bytes that also starts in
a document with a smaller identifier. Which strings those are is read off
suffixes sorted by external induced sorting (:mod:`gistworks.llm.induced`), with
the common prefixes that its queues carry: neighbours that share ``width`` bytes
start with the same string, and the smallest identifier among them is its first
document.

Equal strings must meet in one shard. Each window of ``width`` bytes is known by
the least hash of the 24-byte strings in it, its mark. Runs of windows with one
mark are *stretches*; equal windows have equal marks, so shards are dealt by
mark. Only stretches whose mark stands in two documents are sent, and each
distinct one once from a block of texts, with its smallest identifier; a group
of copies, whatever its size, is one stretch to a block. Marks are compared by
40 bits beside their bucket; a chance agreement sends a stretch in vain and
changes nothing, the sorting decides. Texts are stored once, in blocks laid out
by number, and not shuffled again: what the shards found comes to them.

Identifiers are integers; null counts as smaller than all others. Rows with the
same identifier are no earlier than each other, so repeated rows stay alike.
Null texts count as empty; what remains of a text need not be valid UTF-8 and is
binary. Empty tables give empty results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType, StructType

from gistworks.llm import induced
from gistworks.llm.common import Bucketed, Stored, binary, blocks, bucket_count, pack, pick, prepare, task_number, unpack

#: Bytes hashed to a mark.
MARK = 24
#: Windows that a stretch holds at most; longer runs (repetitive texts) are cut, at the same places if equal.
STRETCH = 4096
#: Bytes of text of a block, and of text for each bucket of marks and each shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
_STEP = 1 << 20
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SIGN = np.uint64(1 << 63)


def marks(joined: bytes, a: int, b: int, width: int) -> np.ndarray:
    """The marks of the windows that start at a..b-1."""
    n = b - a + width - MARK  # hashed strings
    x = np.ndarray((n + 16,), "<u8", joined, a, (1,)).copy()
    h = x[:n] * _M1
    h ^= h >> np.uint64(29)
    h += x[8 : 8 + n]
    h *= _M2
    h ^= h >> np.uint64(32)
    h += x[16 : 16 + n]
    h *= _M3
    h ^= h >> np.uint64(29)
    many, s = width - MARK + 1, 1
    while 2 * s <= many:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (many - s)], h[many - s :]) if many > s else h


def stretches(joined: bytes, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, mark, text) of the stretches of texts that lie one after the other."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    total = len(joined) - width + 1
    empty = np.zeros(0, np.int64)
    starts, values, before = [empty], [empty.astype(np.uint64)], None
    for a in range(0, max(total, 0), _STEP):
        v = marks(joined, a, min(a + _STEP, total), width)
        new = np.concatenate(([before is None or v[0] != before], v[1:] != v[:-1]))
        # A text's first window starts a stretch; where its windows end, so does the stretch.
        x = begins[(begins >= a) & (begins < a + len(v))] - a
        y = ends - width + 1
        new[x] = True
        new[y[(y >= a) & (y < a + len(v))] - a] = True
        at = np.flatnonzero(new)
        starts.append(at + a)
        values.append(v[at])
        before = v[-1]
    start, value = np.concatenate(starts), np.concatenate(values)
    windows = np.diff(np.concatenate((start, [max(total, 0)])))
    text = np.searchsorted(ends, start, side="right")
    good = start + width <= ends[np.minimum(text, len(ends) - 1)] if len(ends) else np.zeros(0, bool)
    start, value, windows, text = start[good], value[good], windows[good], text[good]
    if len(windows) and windows.max() > STRETCH:
        pieces = -(-windows // STRETCH)
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, value, windows, text = (np.repeat(c, pieces) for c in (start, value, windows, text))
        start, windows = start + k * STRETCH, np.minimum(windows - k * STRETCH, STRETCH)
    return start, windows, value, text


def _keys(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A mark's bucket, and 40 other bits of it."""
    return (value % np.uint64(buckets)).astype(np.int64), ((value * _M1) >> np.uint64(24)).astype(np.int64)


def _several(home: np.ndarray, bits: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, bits), and whether they stand in texts of more than one identifier."""
    order = np.lexsort((bits, home))
    home, bits, owner = home[order], bits[order], owner[order]
    new = np.concatenate(([True], (home[1:] != home[:-1]) | (bits[1:] != bits[:-1]))) if len(home) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    several = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at) if len(at) else np.zeros(0, bool)
    return home[at], bits[at], several


def _ordered(ids: pa.Array) -> np.ndarray:
    """Identifiers as unsigned numbers in the same order, null first."""
    plain = pc.fill_null(ids.cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)
    return plain.astype(np.int64).view(np.uint64) ^ _SIGN


def _cut(width: int, buckets: int, kept: list[str], block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = task_number()
        for number, table in enumerate(blocks(batches, "text", block_bytes)):
            texts = [t or b"" for chunk in table.column("text").chunks for t in binary(chunk).to_pylist()]
            lengths, joined = np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)
            sink = pa.BufferOutputStream()
            rows = table.select(kept).combine_chunks()
            with pa.ipc.new_stream(sink, rows.schema) as writer:
                writer.write_table(rows)
            ids = _ordered(table.column("number").combine_chunks())
            block = (task << 24) + number
            out = [("block", block, 0, pack(sink.getvalue().to_pybytes(), ids, lengths, joined))]
            _, _, value, text = stretches(joined, lengths, width)
            home, bits, several = _several(*_keys(value, buckets), ids[text])
            edges = np.searchsorted(home, np.arange(buckets + 1)).tolist()
            for bucket, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    x, s = bits[a:b], several[a:b]
                    out.append(("marks", block, bucket, pack(x[~s], x[s])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.binary()))], ["kind", "block", "bucket", "payload"])

    return run


def _by(batches: Iterator[pa.RecordBatch], key: str, *columns: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of sorted batches by key."""
    now, held = None, []
    for batch in batches:
        for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *columns))):
            if held and k != now:
                yield now, held
                held = []
            now = k
            held.append(row)
    if held:
        yield now, held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each block those of its marks that also stand elsewhere."""
    for bucket, rows in _by(batches, "bucket", "block", "payload"):
        parts = [(block, *(x.astype(np.int64) for x in unpack(payload))) for block, payload in rows]
        every = np.sort(np.concatenate([x for _, one, some in parts for x in (one, some)]))
        twice = every[1:][every[1:] == every[:-1]]
        known = np.unique(np.concatenate([twice, *(some for _, _, some in parts)]))
        found = [(block, bucket, pack(one[np.isin(one, known, assume_unique=True)])) for block, one, _ in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int32(), pa.binary()))], ["block", "bucket", "payload"])


_SENT = "kind string, block long, shard int, start long, payload binary"


def _send(width: int, buckets: int, shards: int, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's distinct stretches with shared marks, by shard; and where they stand."""
        out = []
        known = [np.zeros(0, np.int64)]
        for bucket, payload in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist()):
            known.append((bucket << 40) | unpack(payload)[0].astype(np.int64))
        known = np.concatenate(known)
        for block, payload in zip(left.column("block").to_pylist(), left.column("payload").to_pylist()):
            _, ids, lengths, joined = unpack(payload)
            ids = ids.astype(np.uint64)
            start, windows, value, text = stretches(joined, lengths, width)
            home, bits = _keys(value, buckets)
            a, b, several = _several(home, bits, ids[text])
            both = np.unique(np.concatenate((known, (a[several] << 40) | b[several])))
            sent = np.flatnonzero(np.isin((home << 40) | bits, both))
            start, windows, text = start[sent], windows[sent], text[sent]
            seen: dict[bytes, int] = {}
            code = np.fromiter((seen.setdefault(joined[s:e], len(seen)) for s, e in zip(start.tolist(), (start + windows + width - 1).tolist())), np.int64, len(start))
            first = np.full(len(seen), ~np.uint64(0))
            np.minimum.at(first, code, ids[text])
            shard = np.empty(len(seen), np.int64)
            shard[code] = ((value[sent] >> np.uint64(3)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            strings = list(seen)
            sizes = np.fromiter(map(len, strings), np.int64, len(strings))
            out.append(("layout", block, 0, 0, pack(start, rank[code])))
            edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                if b > a:
                    some = order[a:b]
                    out.append(("strings", block, k, a, pack(sizes[some], b"".join(strings[i] for i in some.tolist()), first[some])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()

    return run


def first_documents(strings: list[bytes], first: np.ndarray, width: int, limit: int = induced.QUEUE, bulk: int = induced.BULK) -> tuple[np.ndarray, np.ndarray]:
    """For each window of distinct strings, one after the other, the least ``first`` of the strings that hold it.

    Returns the windows' values and where each string's windows start.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    # Bytes are symbols from 2, strings end with 1, the end is 0. UTF-8 has no bytes that need a wider symbol.
    joined = (b"".join(strings[a : a + (1 << 16)]) for a in range(0, len(strings), 1 << 16))
    kind = np.uint8 if all(not x or np.frombuffer(x, np.uint8).max() < 0xFE for x in joined) else np.int16
    symbols = induced.alloc(int(begins[-1]), kind)
    for a in range(0, len(strings), 1 << 16):
        part = np.frombuffer(b"".join(x + b"\0" for x in strings[a : a + (1 << 16)]), np.uint8)
        symbols[begins[a] : begins[a] + len(part)] = part.astype(kind) + kind(2)
    symbols[begins[1:] - 1] = 1
    windows = np.maximum(sizes - width + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(windows)))
    found = induced.alloc(int(offsets[-1]), np.uint64)
    for a in range(0, len(strings), 1 << 16):
        b = min(len(strings), a + (1 << 16))
        found[offsets[a] : offsets[b]] = np.repeat(first[a:b], windows[a:b])
    if not len(found):
        return found, offsets
    text = induced.Text.of(symbols)

    def settle(pos: np.ndarray, groups: np.ndarray) -> None:
        """All windows of a group (they start at ``groups``) have one first document."""
        owner = np.searchsorted(begins, pos, side="right") - 1
        # What runs past a string's end is no window; equal ones all do or all don't.
        whole = pos - begins[owner] < windows[owner]
        if not whole.all():
            head = np.zeros(len(pos), bool)
            head[groups] = True
            pos, owner, groups = pos[whole], owner[whole], np.flatnonzero(head[whole])
        if not len(pos):
            return
        least = np.minimum.reduceat(first[owner], groups)
        sizes_of = np.diff(np.concatenate((groups, [len(pos)])))
        found[offsets[owner] + pos - begins[owner]] = np.repeat(least, sizes_of)

    for pos, lcp in induced.sorted_with_prefixes(text, width, limit, bulk):
        a = 0
        while a < len(pos):
            b = min(len(pos), a + bulk)
            while b < len(pos) and lcp[b] >= width:  # a group stays whole
                b += 1
            same = lcp[a:b] >= width
            same[0] = False
            member = same | np.concatenate((same[1:], [False]))
            at = np.flatnonzero(member)
            if len(at):
                settle(np.asarray(pos[a:b])[at], np.flatnonzero(~same[at]))
            a = b
    # Windows of one byte repeated may be of either type: they are one group by byte.
    flat = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    begin, end = np.concatenate(([0], flat)), np.concatenate((flat, [len(symbols)]))
    long = np.flatnonzero(end - begin >= width)
    for symbol in np.unique(symbols[begin[long]]).tolist():
        of = long[symbols[begin[long]] == symbol]
        many = end[of] - begin[of] - width + 1
        pos = np.repeat(begin[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        settle(pos, np.zeros(1, np.int64))
    return found, offsets


def _sort(width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's strings sorted together; to each block its strings' first documents, as runs."""
        for _, rows in _by(batches, "shard", "block", "start", "payload"):
            seen: dict[bytes, int] = {}
            codes, first = [], np.zeros(0, np.uint64)
            for _, _, payload in rows:
                sizes, joined, least = unpack(payload)
                ends = np.cumsum(sizes).tolist()
                code = np.fromiter((seen.setdefault(joined[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends)), np.int64, len(sizes))
                first = np.concatenate((first, np.full(len(seen) - len(first), ~np.uint64(0))))
                np.minimum.at(first, code, least.astype(np.uint64))
                codes.append(code)
            found, offsets = first_documents(list(seen), first, width)
            del seen
            new = np.concatenate(([True], found[1:] != found[:-1]))
            new[offsets[:-1]] = True
            at = np.flatnonzero(new)
            value, size = found[at], np.diff(np.concatenate((at, [len(found)])))
            begin = np.searchsorted(at, offsets)
            for (block, start, _), code in zip(rows, codes):
                runs = begin[code + 1] - begin[code]
                pick_ = np.repeat(begin[code] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
                out = ("runs", block, 0, start, pack(runs, size[pick_], value[pick_]))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, schema)], schema=schema)

    return run


def removed(
    start: np.ndarray, string: np.ndarray, owner: np.ndarray, ends: np.ndarray, runs: np.ndarray, size: np.ndarray, value: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of the maximal removed runs of bytes, in order.

    Strings stand at ``start`` in texts that end at ``ends``, in such of identifiers ``owner``; string k has
    ``runs[k]`` runs of windows with ``size`` and first document ``value``.
    """
    begin = np.cumsum(runs) - runs
    inside = np.cumsum(size) - size
    many = runs[string]
    at = np.repeat(begin[string] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    a = np.repeat(start - inside[np.minimum(begin[string], max(len(inside) - 1, 0))], many) + inside[at] if len(inside) else np.zeros(0, np.int64)
    earlier = value[at] < np.repeat(owner, many)
    a, b = a[earlier], (a + size[at] + width - 1)[earlier]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    reach = np.maximum.accumulate(b) if len(b) else b
    text = np.searchsorted(ends, a, side="right")
    new = np.concatenate(([True], (a[1:] > reach[:-1]) | (text[1:] != text[:-1]))) if len(a) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return text[first], a[first], reach[np.concatenate((first[1:] - 1, [len(a) - 1]))] if len(first) else reach


def as_digest(text: memoryview, spans: list[tuple[int, int]]) -> tuple:
    kept, at = hashlib.sha256(), 0
    for a, b in spans:
        kept.update(text[at:a])
        at = b
    kept.update(text[at:])
    return len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest()


def as_kept(text: memoryview, spans: list[tuple[int, int]]) -> tuple:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return [{"begin": a, "end": b} for a, b in spans], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


FORMS = {
    "digest": ("n_bytes long, n_removed long, n_spans long, kept_sha256 string", as_digest),
    "kept": ("removed array<struct<begin:long,end:long>>, kept binary", as_kept),
}


def _remove(width: int, finish, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = sorted(zip(right.column("kind").to_pylist(), right.column("start").to_pylist(), right.column("payload").to_pylist()), key=lambda r: r[:2])
        for payload in left.column("payload").to_pylist():
            raw, ids, lengths, joined = unpack(payload)
            rows = pa.ipc.open_stream(raw).read_all()
            ends = np.cumsum(lengths)
            layout = [unpack(p) for kind, _, p in found if kind == "layout"]
            parts = [unpack(p) for kind, _, p in found if kind == "runs"]
            spans: dict[int, list] = {}
            if parts:
                start, string = layout[0]
                # Unpacked numbers are signed or not by their size.
                runs, size, value = (np.concatenate([x.astype(kind) for x in c]) for c, kind in zip(zip(*parts), (np.int64, np.int64, np.uint64)))
                owner = ids.astype(np.uint64)[np.searchsorted(ends, start, side="right")]
                text, a, b = removed(start, string, owner, ends, runs, size, value, width)
                base = (ends - lengths)[text]
                for k, x, y in zip(text.tolist(), (a - base).tolist(), (b - base).tolist()):
                    spans.setdefault(k, []).append((x, y))
            view = memoryview(joined)
            results = [finish(view[e - n : e], spans.get(k, [])) for k, (e, n) in enumerate(zip(ends.tolist(), lengths.tolist()))]
            columns = [*rows.columns, *(pa.array(c, f.type) for c, f in zip(zip(*results), list(schema)[rows.num_columns :]))]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def remove_repeats(
    docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", form: str = "kept", keep: dict[str, str] | None = None,
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Every row's identifier, and by ``form`` what is removed and what is kept, or digests of it.

    ``keep`` names further columns to carry along (new name: old name).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if width <= MARK:
        raise ValueError(f"strings must be longer than {MARK} bytes")
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    prepare(docs.sparkSession)
    texts = pick(docs, doc_id=id_col, number=id_col, text=text_col, **(keep or {})).withColumn("number", F.col("number").cast("long"))
    kept = [c for c in texts.columns if c not in ("text", "number")]
    buckets = bucket_count(texts, "text", shard_bytes)
    cut = Bucketed(
        texts.mapInArrow(_cut(width, buckets, kept, block_bytes), "kind string, block long, bucket int, payload binary"), "repeats", "block", buckets, "kind"
    )
    held = cut.read().where("kind = 'block'").select("block", "payload")
    stood = cut.read().where("kind = 'marks'").select("bucket", "block", "payload")
    common = stood.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, "block long, bucket int, payload binary")
    sent_schema = StructType.fromDDL(_SENT)
    arrow = to_arrow_schema(sent_schema)
    sent = Stored(held.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(_send(width, buckets, buckets, arrow), sent_schema), "repeats-strings", "kind")
    strings = sent.read().where("kind = 'strings'").select("shard", "block", "start", "payload")
    sorted_ = strings.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sort(width, arrow), sent_schema)
    layout = sent.read().where("kind = 'layout'").select(*sent_schema.names)
    columns, finish = FORMS[form]
    schema = StructType([*texts.select(*kept).schema.fields, *StructType.fromDDL(columns).fields])
    answers = sorted_.unionByName(layout)
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remove(width, finish, to_arrow_schema(schema)), schema)
