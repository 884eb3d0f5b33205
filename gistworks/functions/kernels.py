"""Per-pair sequence measures over token lists."""

from __future__ import annotations

from collections import Counter
from math import isqrt


def _positions(tokens: list[str], wanted: set[str]) -> dict[str, int]:
    """For each wanted token a bit mask of the places it occurs at.

    Masks are built in bytes, as setting one bit of a long integer copies it.
    """
    places: dict[str, list[int]] = {}
    for i, token in enumerate(tokens):
        if token in wanted:
            places.setdefault(token, []).append(i)
    masks = {}
    for token, found in places.items():
        packed = bytearray(found[-1] // 8 + 1)
        for i in found:
            packed[i >> 3] |= 1 << (i & 7)
        masks[token] = int.from_bytes(packed, "little")
    return masks


def _lcs_rows(outer: list[str], masks: dict[str, int], full: int, row: int | None = None):
    """Bit-parallel LCS: after each outer token, the row in which a cleared bit is a step up."""
    row = full if row is None else row
    for token in outer:
        if token in masks:
            match = row & masks[token]
            row = ((row + match) | (row - match)) & full
        yield row


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the shorter list drives the loop."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    full = (1 << len(b)) - 1
    row = full
    for row in _lcs_rows(a, _positions(b, set(a)), full):
        pass
    return len(b) - row.bit_count()


def lcs_reference_places(reference: list[str], masks: dict[str, int], prediction: list[str]) -> set[int]:
    """Places of one longest common subsequence in the reference; ``masks`` are the prediction's.

    Walking back from the end, a step that could drop either side drops the
    reference's token, unless only dropping the prediction's keeps the length.
    So a common end is taken as it is, and reference tokens that the prediction
    lacks are dropped wherever they stand: neither needs a row. One row in every
    root of the length is kept; those between are made again when the walk comes
    to them, so memory grows with the power 1.5.
    """
    places: set[int] = set()
    i, j = len(reference), len(prediction)
    while i and j and reference[i - 1] == prediction[j - 1]:
        i, j = i - 1, j - 1
        places.add(i)
    at_of = [k for k in range(i) if reference[k] in masks]
    if not at_of or not j:
        return places
    tokens = [reference[k] for k in at_of]
    full = (1 << j) - 1
    i, step = len(tokens), isqrt(len(tokens)) + 1
    kept = [full]
    for n, row in enumerate(_lcs_rows(tokens, masks, full), 1):
        if n % step == 0:
            kept.append(row)
    at, rows = i + 1, []
    while i and j:
        if i - 1 < at:
            at = (i - 1) // step * step
            first = kept[at // step]
            rows = [first, *_lcs_rows(tokens[at:i], masks, full, first)]
        if tokens[i - 1] == prediction[j - 1]:
            i, j = i - 1, j - 1
            places.add(at_of[i])
            continue
        low = (1 << j) - 1
        here, before = rows[i - at], rows[i - at - 1]
        flat_here = here >> (j - 1) & 1
        if flat_here and (before & low).bit_count() > (here & low).bit_count():
            j -= 1
        else:
            i -= 1
    return places


def summary_lcs_hits(reference: list[list[str]], prediction: list[list[str]]) -> int:
    """Union-LCS hits over sentences, each token used at most as often as it occurs."""
    wanted = {t for s in reference for t in s}
    masks = [_positions(sentence, wanted) for sentence in prediction]
    left_ref = Counter(t for s in reference for t in s)
    left_pred = Counter(t for s in prediction for t in s)
    hits = 0
    for sentence in reference:
        union: set[int] = set()
        for mask, other in zip(masks, prediction):
            if len(union) == len(sentence):
                break
            union |= lcs_reference_places(sentence, mask, other)
        for i in sorted(union):
            token = sentence[i]
            if left_ref[token] and left_pred[token]:
                left_ref[token] -= 1
                left_pred[token] -= 1
                hits += 1
    return hits
