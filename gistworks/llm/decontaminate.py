"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of words weighed by TF-IDF over hashed terms; document
frequencies count every passage of the corpus. A randomised singular value
decomposition finds the latent space: each task multiplies its passages with
the same random test matrix and back (one pass, Y = A'A W), the sums are
added up by blocks of terms, and the driver finishes the small factor. The
benchmark's own passages are rows of the matrix too, weighing together as
much as several corpora, so that the leading directions tell its items apart.

A second pass projects the corpus windows, takes as candidates those whose
cosine to a benchmark passage is high enough, and checks each against the
words around: the longest common subsequence with the item, and the item's
answer (its last sentence). Windows that cannot reach the cosine, because too
little of their weight lies on benchmark terms, are passed over; that bound is
exact. Where an item's words are so common that its copies weigh little beside
the words around, cosines miss them; so runs of words that an item and a text
share exactly are candidates too, whatever they weigh.

The benchmark is a query set: it is dealt into parts of bounded text, each of
which is shipped to the tasks and held against all documents. A part's passages
are dealt into blocks with a latent space each, of higher rank than the block
has passages, so that the space holds all of them nearly whole and a cosine in
it is nearly the full one. The corpus is decomposed once for all blocks of a
part, over the part's terms; a block takes its own terms of that.

Before the subsequence of a candidate is measured, two checks that need no order
are made for all candidates at once: the answer's words must stand around, and
so must enough of the item's words, each as often as it is matched. The second
bounds the subsequence from above, so nothing that would pass is passed over.

Null and empty texts have no passages; null or wordless items match nothing.
Repeated rows are judged each by itself; an empty table or benchmark gives no
leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gistworks.functions.batches import handing_back, values
from gistworks.llm.common import binary, pack, pick, prepare, unpack

WINDOW, STRIDE = 24, 12
SLOTS = 1 << 20
#: Words in a row that make a candidate by themselves; a shorter item is taken whole.
GRAM = 8
RANK, EXTRA = 256, 16
#: Benchmark passages of a block; the rest of the rank is left to the corpus.
PASSAGES = 192
#: Weight of the benchmark's passages in the decomposition, in corpora.
ITEM_WEIGHT = 8.0
COSINE, SUBSEQUENCE, ANSWER = 0.3, 0.6, 0.6
#: Benchmark text that is held against the corpus in one go, in bytes.
ITEM_BYTES = 512 << 10
#: Terms that more than this share of the passages hold are multiplied as dense columns.
DENSE = 0.04
#: Windows and candidates that are handled at once: about 20 MB of sums.
WINDOWS, CANDIDATES = 1024, 8192
_CHUNK = 1 << 20
_ROOT = 0x9E3779B97F4A7C15
_FOLDED = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 0 for c in range(256)], np.uint8)
_DEAL = 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Hashes of the words of many texts at once: a polynomial over their folded bytes, modulo 2 ** 64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            self.up = _powers(_ROOT, n)
            self.down = _powers(pow(_ROOT, -1, 1 << 64), n)

    def of(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, words by row, hashes) for runs of rows of about a megabyte."""
        first, held, size = 0, [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1]) + 1
            if size >= _CHUNK:
                yield (first, *self._hash(held))
                first, held, size = first + len(held), [], 0
        if held:
            yield (first, *self._hash(held))

    def _hash(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        folded = _FOLDED[np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)]
        inside = folded != 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        rows = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))) + 1)
        self._grow(len(folded) + 1)
        sums = np.cumsum(folded * self.up[: len(folded)], dtype=np.uint64)
        hashes = (sums[ends - 1] - sums[starts - 1]) * self.down[starts]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.diff(rows), hashes ^ (hashes >> np.uint64(32))


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def windows(counts: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each row's windows; the last one of a row may be short."""
    each = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // stride), 0) + 1, 0)
    rows = np.repeat(np.arange(len(counts)), each)
    first = np.cumsum(counts) - counts
    start = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * stride + first[rows]
    return rows, start, np.minimum(start + WINDOW, (first + counts)[rows])


@handing_back
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that hold each slot, of passages without overlap; one task's counts in a few packed parts."""
    words, total, passages = Words(), np.zeros(SLOTS, np.int64), 0
    for batch in batches:
        for _, counts, hashes in words.of(values(binary(batch.column("text")))):
            _, start, end = windows(counts, WINDOW)
            passages += len(start)
            if len(hashes):
                by_word = np.repeat(np.arange(len(start)), end - start)
                key = np.sort(by_word * SLOTS + slot(hashes))
                total += np.bincount(key[np.concatenate(([True], key[1:] != key[:-1]))] % SLOTS, minlength=SLOTS)
    parts = np.split(total, _DEAL)
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(_DEAL), pa.int32()), pa.array([pack(p) for p in parts], pa.binary()), pa.array([passages] + [0] * (_DEAL - 1), pa.int64())],
        ["part", "body", "passages"],
    )


def _add_counts(table: pa.Table) -> pa.Table:
    total = sum(unpack(b)[0] for b in table.column("body").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "body": pa.array([pack(total)], pa.binary()), "passages": pa.array([sum(table.column("passages").to_pylist())], pa.int64())})


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passage counts by slot and the number of passages, over all of ``text``; sized by SLOTS."""
    schema = "part int, body binary, passages long"
    rows = docs.select("text").mapInArrow(_frequencies, schema).groupBy("part").applyInArrow(_add_counts, schema).toArrow()
    if not rows.num_rows:
        return np.zeros(SLOTS, np.int64), 0
    parts = sorted(zip(rows.column("part").to_pylist(), rows.column("body").to_pylist()))
    return np.concatenate([unpack(b)[0] for _, b in parts]), sum(rows.column("passages").to_pylist())


def weights(frequency: np.ndarray, passages: int) -> np.ndarray:
    """Smoothed inverse document frequency by slot; no term weighs nothing, however common."""
    return (np.log((passages + 1) / (frequency + 1)) + 1).astype(np.float32)


@dataclass
class Items:
    """Benchmark items: their words, answers, and a run of their passages over its own terms."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    owner: np.ndarray
    rows: np.ndarray
    #: Place of the first item in the part of the benchmark.
    base: int = 0

    @classmethod
    def of(cls, ids: list, texts: list[bytes], idf: np.ndarray, passages: slice = slice(None), base: int = 0) -> Items:
        words = Words()
        split = [np.concatenate([np.zeros(0, np.uint64), *(h for *_, h in words.of([t]))]) for t in texts]
        last = [[s for s in re.split(rb"[.!?\n]+", t) if s.strip()][-1:] for t in texts]
        answers = [np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for *_, h in words.of(s))])) for s in last]
        every = np.concatenate([np.zeros(0, np.uint64), *split])
        counts = np.array([len(w) for w in split], np.int64)
        owner, start, end = (x[passages] for x in windows(counts, STRIDE))
        slots = slot(every)
        terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(slots[a:b] for a, b in zip(start.tolist(), end.tolist()))]))
        terms = terms[idf[terms] > 0]
        rows = np.zeros((len(owner), len(terms)), np.float32)
        place = np.full(SLOTS, -1)
        place[terms] = np.arange(len(terms))
        at = place[slots]
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
            inner = at[a:b][at[a:b] >= 0]
            np.add.at(rows[k], inner, idf[terms[inner]])
        norm = np.linalg.norm(rows, axis=1)
        keep = norm > 0
        return cls(ids, split, answers, terms, owner[keep], rows[keep] / norm[keep, None], base)

    @classmethod
    def blocks(cls, ids: list, texts: list[bytes], idf: np.ndarray) -> list[Items]:
        """All passages in blocks of at most ``PASSAGES``; a longer item's passages lie in several blocks."""
        words = Words()
        counts = np.array([sum(int(c.sum()) for _, c, _ in words.of([t])) for t in texts], np.int64)
        owner, *_ = windows(counts, STRIDE)
        out = []
        for part in np.array_split(np.arange(len(owner)), -(-len(owner) // PASSAGES)) if len(owner) else []:
            first, last = int(owner[part[0]]), int(owner[part[-1]]) + 1
            skip = int(part[0] - np.searchsorted(owner, first))
            own = cls.of(ids[first:last], texts[first:last], idf, slice(skip, skip + len(part)), first)
            if len(own.rows):
                out.append(own)
        return out


def _test_matrix(terms: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((terms, RANK + EXTRA), dtype=np.float32)


def _group_sums(matrix: np.ndarray, index: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows ``index`` of a matrix by runs that begin at ``edges``: the k-th rows of all runs are added at once."""
    sizes = np.diff(np.append(edges, len(index)))
    out = matrix[index[edges]]
    left = np.arange(len(edges))
    for k in range(1, int(sizes.max(initial=0))):
        left = left[sizes[left] > k]
        if len(left) < 8:
            for run in left.tolist():
                out[run] += matrix[index[edges[run] + k : edges[run] + sizes[run]]].sum(axis=0)
            break
        out[left] += matrix[index[edges[left] + k]]
    return out


def _passage_weights(start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(value, dtype=np.float64)))
    return sums[end] - sums[start]


def _sketch(shipped):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's share of A'(A W), and of the squared norm of A by term, in parts of the terms."""
        idf, terms, dense = shipped.value
        test, words = _test_matrix(len(terms)), Words()
        place = np.full(SLOTS, -1, np.int32)
        place[terms] = np.arange(len(terms))
        column = np.full(len(terms), -1, np.int32)
        column[dense] = np.arange(len(dense))
        # A term's weight is the same in every passage: it goes into the test matrix before and the sums after.
        heavy = test * idf[terms][:, None]
        out, raw, norm = np.zeros_like(test), np.zeros_like(test), np.zeros(len(terms))
        for batch in batches:
            for _, counts, hashes in words.of(values(binary(batch.column("text")))):
                _, start, end = windows(counts, WINDOW)
                if not len(start):
                    continue
                slots = slot(hashes)
                weight = idf[slots]
                size = np.sqrt(_passage_weights(start, end, weight * weight))
                at = np.flatnonzero((place[slots] >= 0) & (weight > 0))
                if not len(at):
                    continue
                row = np.searchsorted(start, at, side="right") - 1
                term, value = place[slots[at]], weight[at] / size[row].astype(np.float32)
                norm += np.bincount(term, value * value, len(terms))
                seen = np.zeros((len(start), test.shape[1]), np.float32)
                col = column[term]
                if len(dense):
                    often = np.flatnonzero(col >= 0)
                    held = np.bincount(row[often] * len(dense) + col[often], value[often], len(start) * len(dense))
                    held = held.reshape(len(start), len(dense)).astype(np.float32)
                    seen += held @ test[dense]
                    seldom = np.flatnonzero(col < 0)
                    row, term = row[seldom], term[seldom]
                if len(row):
                    edges = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                    part = row[edges]
                    seen[part] += _group_sums(heavy, term, edges) / size[part, None].astype(np.float32)
                    order = np.argsort(term, kind="stable")
                    cuts = np.flatnonzero(np.concatenate(([True], np.diff(term[order]) != 0)))
                    scaled = seen / np.maximum(size, 1e-9)[:, None].astype(np.float32)
                    raw[term[order][cuts]] += _group_sums(scaled, row[order], cuts)
                if len(dense):
                    out[dense] += held.T @ seen
        out += raw * idf[terms][:, None]
        parts = [p.tobytes() for p in np.array_split(out, _DEAL)]
        norms = [p.tobytes() for p in np.array_split(norm, _DEAL)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_DEAL), pa.int32()), pa.array(parts, pa.binary()), pa.array(norms, pa.binary())], ["part", "body", "norm"])

    return run


def _add_sketches(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in table.column("body").to_pylist())
    norm = sum(np.frombuffer(b) for b in table.column("norm").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "body": pa.array([np.asarray(total, np.float32).tobytes()], pa.binary()), "norm": pa.array([np.asarray(norm, np.float64).tobytes()], pa.binary())})


@dataclass
class Corpus:
    """The corpus passages over some terms: leading singular vectors times their values, and the squared norm by term."""

    terms: np.ndarray
    axes: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame, terms: np.ndarray, idf: np.ndarray, often: np.ndarray | None = None) -> Corpus:
        """``often``: which of the terms are multiplied as dense columns; the result is the same."""
        spark = docs.sparkSession
        schema = "part int, body binary, norm binary"
        dense = np.flatnonzero(often) if often is not None else np.zeros(0, np.int64)
        shipped = spark.sparkContext.broadcast((idf, terms, dense))
        rows = docs.select("text").mapInArrow(_sketch(shipped), schema).groupBy("part").applyInArrow(_add_sketches, schema).toArrow()
        test = _test_matrix(len(terms)).astype(float)
        parts = sorted(zip(*(rows.column(c).to_pylist() for c in ("part", "body", "norm"))))
        image = np.concatenate([np.zeros((0, test.shape[1])), *(np.frombuffer(b, np.float32).reshape(-1, test.shape[1]) for _, b, _ in parts)])
        norm = np.concatenate([np.zeros(0), *(np.frombuffer(n) for *_, n in parts)])
        if not image.any():
            return cls(terms, np.zeros((len(terms), 0)), np.zeros(len(terms)))
        # Nystroem form of the decomposition of A'A from its image of the test matrix.
        shift = 1e-7 * np.linalg.norm(image)
        image = image + shift * test
        inner = test.T @ image
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        good = values > values.max() * 1e-10
        left, sizes, _ = np.linalg.svd(image @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        return cls(terms, left[:, :RANK] * sizes[:RANK], norm)

    def space(self, items: Items) -> np.ndarray:
        """The leading right singular vectors (terms x rank) of corpus and benchmark passages, over the items' terms."""
        at = np.searchsorted(self.terms, items.terms)
        share = ITEM_WEIGHT * max(self.norm[at].sum(), 1.0) / len(items.rows)
        both = np.concatenate([self.axes[at], np.sqrt(share) * items.rows.T.astype(float)], axis=1)
        left, sizes, _ = np.linalg.svd(both, full_matrices=False)
        return left[:, :RANK][:, sizes[:RANK] > sizes[0] * 1e-6].astype(np.float32)


def latent_space(docs: DataFrame, items: Items, idf: np.ndarray) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of corpus and benchmark passages."""
    return Corpus.of(docs, items.terms, idf).space(items)


def subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits."""
    where: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if hit := where.get(x):
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Searcher:
    """Held against the texts of a task: weights, a block of items and their places in the latent space."""

    idf: np.ndarray
    items: Items
    space: np.ndarray

    def __post_init__(self):
        self.place = np.full(SLOTS, -1, np.int32)
        self.place[self.items.terms] = np.arange(len(self.items.terms))
        latent = self.items.rows @ self.space
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        #: What one unit of a term adds to the cosine with each passage, by way of the latent space; and the most of that.
        self.adds = self.space @ latent.T
        self.reach = np.zeros(SLOTS, np.float32)
        self.reach[self.items.terms] = np.abs(self.adds).max(axis=1, initial=0)
        #: The same for a word: a term's weight is the same everywhere.
        self.heavy = self.adds * self.idf[self.items.terms][:, None]

    def candidates(self, counts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, window start, window end, item) of each window and item whose passages are near enough."""
        for found in self.near(counts, hashes):
            yield from zip(*(x.tolist() for x in found))

    def near(self, counts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The same as arrays, for some windows at a time."""
        rows, start, end = windows(counts, STRIDE)
        if not len(rows):
            return
        slots = slot(hashes)
        weight = self.idf[slots]
        size = np.sqrt(_passage_weights(start, end, weight * weight))
        # A cosine cannot exceed what the window's terms add at most.
        most = _passage_weights(start, end, weight * self.reach[slots])
        some = np.flatnonzero((most >= COSINE * 0.9999 * size) & (size > 0))
        # A window is two halves of STRIDE words, which its neighbours share: each word is looked up once.
        each = np.bincount(rows, minlength=len(counts))
        owners = np.flatnonzero(each)
        halves = each[owners] + 1
        first_half = np.zeros(len(counts), np.int64)
        first_half[owners] = np.cumsum(halves) - halves
        nth_row = np.zeros(len(counts), np.int64)
        nth_row[owners] = np.arange(len(owners))
        row_end = np.cumsum(counts)
        for at in range(0, len(some), WINDOWS):
            part = some[at : at + WINDOWS]
            half = part + nth_row[rows[part]]
            needed = np.unique(np.concatenate((half, half + 1)))
            of = owners[np.searchsorted(first_half[owners], needed, side="right") - 1]
            low = np.minimum((row_end - counts)[of] + (needed - first_half[of]) * STRIDE, row_end[of])
            lengths = np.minimum(low + STRIDE, row_end[of]) - low
            flat = np.arange(lengths.sum()) + np.repeat(low - np.cumsum(lengths) + lengths, lengths)
            owner = np.repeat(np.arange(len(needed)), lengths)
            keep = (self.place[slots[flat]] >= 0) & (weight[flat] > 0)
            flat, owner = flat[keep], owner[keep]
            sums = np.zeros((len(needed), self.adds.shape[1]), np.float32)
            if len(flat):
                edges = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                sums[owner[edges]] = _group_sums(self.heavy, self.place[slots[flat]], edges)
            seen = sums[np.searchsorted(needed, half)] + sums[np.searchsorted(needed, half + 1)]
            near, passage = np.nonzero(seen >= COSINE * size[part][:, None])
            yield rows[part[near]], start[part[near]], end[part[near]], self.items.owner[passage]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in a row."""
    out = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(_ROOT)
        out ^= out >> np.uint64(29)
    return out


class Grams:
    """The word runs of all items of a part: of ``GRAM`` words, or of all words of a shorter item."""

    def __init__(self, items: dict[int, np.ndarray]):
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, words in items.items():
            if n := min(GRAM, len(words)):
                held.setdefault(n, []).append((grams(words, n), k))
        self.held = []
        for n, some in sorted(held.items()):
            keys = np.concatenate([g for g, _ in some])
            item = np.concatenate([np.full(len(g), k) for g, k in some])
            at = np.concatenate([np.arange(len(g)) for g, _ in some])
            order = np.argsort(keys, kind="stable")
            there = np.zeros(SLOTS, bool)
            there[slot(keys)] = True
            self.held.append((n, there, keys[order], item[order], at[order]))

    def candidates(self, counts: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, start, end, item), once for each run of matches in a row and each item."""
        ends = np.cumsum(counts)
        for n, there, keys, item, at in self.held:
            found = grams(hashes, n)
            some = np.flatnonzero(there[slot(found)])
            row = np.searchsorted(ends, some, side="right")
            inside = some + n <= ends[row]
            some, row = some[inside], row[inside]
            low, high = (np.searchsorted(keys, found[some], side) for side in ("left", "right"))
            seen = set()
            for k in np.flatnonzero(high > low).tolist():
                for x in range(int(low[k]), int(high[k])):
                    start = int(some[k])
                    line = int(row[k]), int(item[x]), start - int(at[x])
                    if line not in seen:
                        seen.add(line)
                        yield line[0], start, start + n, line[1]


class Bags:
    """The words of a part's items, each with how often it stands in the item and whether the answer has it."""

    def __init__(self, items: dict[int, tuple[np.ndarray, np.ndarray]]):
        top = max(items, default=-1) + 1
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for words, answer in items.values() for x in (words, answer))]))
        self.size, self.answer_size = np.zeros(top, np.int64), np.zeros(top, np.int64)
        keys, many, told = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for k, (words, answer) in sorted(items.items()):
            self.size[k], self.answer_size[k] = len(words), len(answer)
            every = np.unique(np.concatenate((words, answer)))
            own, n = np.unique(words, return_counts=True)
            count = np.zeros(len(every), np.int64)
            count[np.searchsorted(every, own)] = n
            keys.append(k * len(self.known) + np.searchsorted(self.known, every))
            many.append(count)
            told.append(np.isin(every, answer))
        self.keys, self.many, self.told = (np.concatenate(x) for x in (keys, many, told))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, or -1 for a word that no item has."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return np.where(self.known[at] == hashes, at, -1) if len(self.known) else np.full(len(hashes), -1)

    def shares(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each stretch of words and item: at most this share of the item's words found in order; the share of the answer's words that stand there."""
        lengths = high - low
        flat = np.arange(lengths.sum()) + np.repeat(low - np.cumsum(lengths) + lengths, lengths)
        owner, word = np.repeat(np.arange(len(low)), lengths), numbers[flat]
        keep = word >= 0
        pair = np.sort(owner[keep] * len(self.known) + word[keep])
        edges = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
        seen, times = pair[edges], np.diff(np.append(edges, len(pair)))
        owner, word = seen // max(len(self.known), 1), seen % max(len(self.known), 1)
        key = item[owner] * len(self.known) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        owner, at, times = owner[hit], at[hit], times[hit]
        bag = np.bincount(owner, np.minimum(times, self.many[at]), len(low))
        told = np.bincount(owner, self.told[at], len(low))
        answers = self.answer_size[item]
        return bag / self.size[item], np.where(answers > 0, told / np.maximum(answers, 1), 1.0)


@dataclass
class Search:
    """A part of the benchmark, held against the texts of a task block by block."""

    blocks: list[Searcher]

    def __post_init__(self):
        self.words, self.ids, self.items = Words(), {}, {}
        for b in self.blocks:
            for k, (i, *held) in enumerate(zip(b.items.ids, b.items.words, b.items.answers), b.items.base):
                self.ids[k], self.items[k] = i, held
        self.grams = Grams({k: words for k, (words, _) in self.items.items()})
        self.bags = Bags(self.items)

    def candidates(self, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Distinct (row, start, end, item), in order."""
        found = [np.zeros((0, 4), np.int64)]
        for b in self.blocks:
            found += [np.stack((rows, start, end, item + b.items.base), axis=1) for rows, start, end, item in b.near(counts, hashes)]
        found.append(np.array(list(self.grams.candidates(counts, hashes)), np.int64).reshape(-1, 4))
        every = np.concatenate(found)
        every = every[np.lexsort(every.T[::-1])]
        return every[np.concatenate(([True], (every[1:] != every[:-1]).any(axis=1)))] if len(every) else every

    def hopeful(self, counts: np.ndarray, hashes: np.ndarray, bounds: bool = True) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, first word around, last word around, item, share of the answer) of candidates that may pass."""
        every, begin = self.candidates(counts, hashes), np.cumsum(counts) - counts
        numbers = self.bags.numbers(hashes)
        for at in range(0, len(every), CANDIDATES):
            row, start, end, item = every[at : at + CANDIDATES].T
            size = self.bags.size[item]
            low, high = np.maximum(begin[row], start - size), np.minimum((begin + counts)[row], end + size)
            bag, told = self.bags.shares(numbers, low, high, item)
            good = (bag >= SUBSEQUENCE) & (told >= ANSWER) if bounds else np.ones(len(row), bool)
            yield from zip(*(x[good].tolist() for x in (row, low, high, item, told)))

    def leaks(self, texts: Iterable[bytes | None], bounds: bool = True) -> list[list[tuple[int, float, float]]]:
        """Per text its items, each with the best share of its words and of its answer found in order.

        ``bounds`` spares subsequences that cannot be long enough; the result is the same without.
        """
        found: list[dict[int, tuple[float, float]]] = []
        for first, counts, hashes in self.words.of(texts):
            found += [{} for _ in counts]
            for row, low, high, item, told in self.hopeful(counts, hashes, bounds):
                known = found[first + row].get(item)
                if known and known[0] == 1.0:
                    continue
                words = self.items[item][0]
                share = subsequence(words, hashes[low:high]) / len(words)
                if share >= SUBSEQUENCE and told >= ANSWER and (not known or share > known[0]):
                    found[first + row][item] = (share, told)
        return [sorted((self.ids[k], *v) for k, v in f.items()) for f in found]


_LEAK = "array<struct<item_id: long, common: double, answer: double>>"


def _search(shipped):
    @F.arrow_udf(_LEAK)
    @handing_back
    def run(texts: pa.Array) -> pa.Array:
        if not hasattr(shipped, "searcher"):
            idf, blocks = shipped.value
            shipped.searcher = Search([Searcher(idf, *b) for b in blocks])
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("common", pa.float64()), ("answer", pa.float64())]))
        made = shipped.searcher.leaks(values(binary(texts)))
        return pa.array([[dict(zip(("item_id", "common", "answer"), x)) for x in row] for row in made], kind)

    return run


def with_leaks(docs: DataFrame, benchmark: DataFrame, out_col: str = "leaks", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Adds the benchmark items found in each text; all rows and columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    items = pick(benchmark, item_id=item_id_col, text=item_text_col).where("text is not null and item_id is not null")
    bytes_in_all = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-bytes_in_all // ITEM_BYTES)
    found: list[Column] = []
    if blocks:
        texts = pick(docs, text=text_col)
        frequency, passages = document_frequencies(texts)
        idf = weights(frequency, passages)
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
        for block in range(blocks):
            rows = dealt.where(F.col("block") == block).orderBy("item_id", "text").collect()  # of bounded size, see ITEM_BYTES
            own = Items.blocks([r["item_id"] for r in rows], [r["text"].encode() for r in rows], idf)
            if own:
                terms = np.unique(np.concatenate([b.terms for b in own]))
                corpus = Corpus.of(texts, terms, idf, frequency[terms] > DENSE * passages)
                shipped = spark.sparkContext.broadcast((idf, [(b, corpus.space(b)) for b in own]))
                found.append(_search(shipped)(F.col(f"`{text_col}`")))
    leaks = F.concat(*found) if found else F.array().cast(_LEAK)
    return docs.withColumn(out_col, leaks)
