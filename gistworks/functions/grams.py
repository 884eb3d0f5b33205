"""Clipped n-gram matches of many pairs of texts at once, on Arrow's buffers.

Tokens are found in the texts' bytes and numbered; an n-gram is then one integer
of its row and its tokens' numbers, and equal ones are counted by sorting. Nothing
is made a Python object.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Whether a byte of a lower-cased text is part of a token; no byte of other letters is.
_IN_TOKEN = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789"))

#: What an n-gram's integer may reach.
_MOST = np.iinfo(np.int64).max


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """All texts' tokens as numbers, how many each text has, and how many different ones there are. Null is no text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _IN_TOKEN[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = ends[1:] > ends[:-1]
    for edge, at in ((first, ends[:-1][filled]), (last, ends[1:][filled] - 1)):
        edge[at] = inside[at]
    starts = np.flatnonzero(first)
    bounds = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    found = spelled.dictionary_encode()
    numbers = found.indices.to_numpy().astype(np.int64)
    return numbers, np.diff(np.searchsorted(starts, ends)), len(found.dictionary)


def _grams(numbers: np.ndarray, rows: np.ndarray, n: int, different: int) -> np.ndarray:
    """Each n-gram inside a row as one integer, the row its highest part."""
    size = max(len(numbers) - n + 1, 0)
    grams = rows[:size]
    for k in range(n):
        grams = grams * different + numbers[k : k + size]
    return grams[rows[:size] == rows[n - 1 :]]


def _in_common(prediction: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that both have, and each one's count on the side with fewer."""
    (a, of_a), (b, of_b) = (np.unique(side, return_counts=True) for side in (prediction, reference))
    if not len(a) or not len(b):
        return a[:0], of_a[:0]
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = a[at] == b
    return b[both], np.minimum(of_a[at], of_b)[both]


def matches(prediction: pa.Array, reference: pa.Array, sizes: Sequence[int]) -> list[np.ndarray]:
    """Tokens of each prediction, of each reference, and for each n of ``sizes`` their clipped matches; texts are lower-cased."""
    n_rows = len(prediction)
    numbers, counts, different = _numbered(pa.concat_arrays([prediction, reference]))
    if n_rows > 1 and n_rows * different ** max(sizes, default=1) > _MOST:
        # An n-gram must fit an integer; a part with a very large text is cut in two.
        half = n_rows // 2
        halves = [matches(prediction[s], reference[s], sizes) for s in (slice(half), slice(half, None))]
        return [np.concatenate(both) for both in zip(*halves)]
    cut = counts[:n_rows].sum()
    sides = []
    for own, tokens in ((counts[:n_rows], numbers[:cut]), (counts[n_rows:], numbers[cut:])):
        sides.append((tokens, np.repeat(np.arange(n_rows), own)))
    found = [counts[:n_rows], counts[n_rows:]]
    for n in sizes:
        grams, hits = _in_common(*[_grams(tokens, rows, n, different) for tokens, rows in sides])
        found.append(np.bincount(grams // max(different**n, 1), hits, n_rows).astype(np.int64))
    return found
