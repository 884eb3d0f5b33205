"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are made per text in the tasks. The trees are grown from a bounded
sample of labelled rows with second-order logistic boosting over binned
features; a constrained feature may only split so that the prediction falls
as the feature rises, and its bounds pass down to both children. The trees
are then flattened into arrays of nodes that score a batch at once.

A null text counts as empty: no words, all statistics zero, base rule failed.
Rows are kept as they are (null identifiers and repeated rows too). Without
usable labels, or with labels of one kind only, the trees pass everything and
the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gistworks.llm.common import binary, labelled_sample, pick, prepare

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTERS_BIG = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and whether quality may only fall (-1), only rise (1) or move freely (0) with them.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1, "repeated_words": -1,
    "distinct_words": 0, "capitals": 0, "digits": 0, "line_words": 0,
}
#: Labelled rows that the trees are grown from, at most.
SAMPLE = 20_000


def _repeated(codes: np.ndarray, distinct: int, window: int = 3) -> int:
    """Words in windows that occur twice or more."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    if distinct < 1 << 20:
        key = (codes[:-2] * distinct + codes[1:-1]) * distinct + codes[2:]
    else:
        _, pair = np.unique(codes[:-1] * distinct + codes[1:], return_inverse=True)
        key = pair[:-1] * distinct + codes[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    starts = order[again]
    covered = np.zeros(len(codes), bool)
    for k in range(window):
        covered[starts + k] = True
    return int(covered.sum())


def statistics(text: bytes | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts named in COUNTS and the features named in FEATURES."""
    text = text or b""
    words = text.split()
    n, joined = len(words), b"".join(words)
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    chars = len(joined.translate(None, _CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    again = _repeated(codes, len(known))
    per = max(1, n)
    share = lambda drop: (len(joined) - len(joined.translate(None, drop))) / max(1, chars)
    features = (
        np.log1p(n), chars / per, symbols / per, dup / max(1, len(lines)), again / per,
        len(known) / per, share(_LETTERS_BIG), share(_DIGITS), n / max(1, len(lines)),
    )
    return (n, chars, symbols, dup, again), features


@dataclass
class Trees:
    """All trees' nodes in flat arrays; a leaf has feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                f = np.where(inner, self.feature[at], 0)
                down = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for the probability of label 1."""
    if not len(y) or y.min() == y.max():
        return Trees(40.0, *(np.zeros(0, t) for t in (np.int64, np.int64, float, np.int64, np.int64, float)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    rate_of_one = y.mean()
    base = float(np.log(rate_of_one / (1 - rate_of_one)))
    total, nodes, roots = np.full(len(y), base), [], []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = leaf(gs, hs, low, high)
        nodes.append([-1, 0.0, me, me, rate * value])
        best = (1e-6, None)
        if level < depth:
            for f, sign in enumerate(signs):
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                gr, hr = gs - gl, hs - hl
                a, b = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * a + (hl + ridge) * a * a / 2) - (gr * b + (hr + ridge) * b * b / 2) + gs * value + (hs + ridge) * value * value / 2
                gain[(hl < least * 0.05) | (hr < least * 0.05) | (sign * (b - a) < 0)] = -1
                if size > 1 and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (f, k, float(a[k]), float(b[k])))
        if best[1]:
            f, k, a, b = best[1]
            middle, falls = (a + b) / 2, signs[f]
            below = binned[rows, f] <= k
            bounds = ((low, high), (low, high)) if not falls else ((middle, high), (low, middle)) if falls < 0 else ((low, middle), (middle, high))
            left = build(rows[below], g, h, level + 1, *bounds[0])
            right = build(rows[~below], g, h, level + 1, *bounds[1])
            nodes[me] = [f, float(cuts[f][k]), left, right, 0.0]
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        first = len(nodes)
        roots.append(build(np.arange(len(y)), p - y, p * (1 - p) + 1e-9, 0, -6.0, 6.0))
        feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes[first:]))
        one = Trees(0.0, np.array([0]), feature.astype(np.int64), threshold, left.astype(np.int64) - first, right.astype(np.int64) - first, value)
        p_one = np.clip(one.predict(x), 1e-12, 1 - 1e-12)
        total += np.log(p_one / (1 - p_one))
    feature, threshold, left, right, value = (np.array(c) for c in zip(*nodes))
    return Trees(base, np.array(roots), feature.astype(np.int64), threshold, left.astype(np.int64), right.astype(np.int64), value)


_FITTED = "label int, features array<double>"
_RATED = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [statistics(t)[1] for t in binary(batch.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(made, pa.list_(pa.float64()))], ["label", "features"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees grown from at most ``sample`` labelled rows."""
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, label, sample, id_col, text_col).mapInArrow(_features, _FITTED).toPandas()
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows["label"]])
    return grow(x[order], rows["label"].to_numpy(float)[order], list(FEATURES.values()))


def _rate(model, threshold: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            made = [statistics(t) for t in binary(batch.column("text")).to_pylist()]
            counts = np.array([m[0] for m in made], np.int64).reshape(-1, len(COUNTS))
            quality = trees.predict(np.array([m[1] for m in made], float).reshape(-1, len(FEATURES)))
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(~failed & (quality >= threshold)), pa.array(quality)], names
            )

    return run


def rate(docs: DataFrame, trees: Trees, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its counts, whether the base rule failed, the trees' probability and the verdict."""
    spark = docs.sparkSession
    prepare(spark)
    texts = pick(docs, doc_id=id_col, text=text_col)
    schema = _RATED.format(id=texts.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    # Shipped once to each executor: its size is set by the number and depth of the trees.
    return texts.mapInArrow(_rate(spark.sparkContext.broadcast(trees), threshold, names), schema)
