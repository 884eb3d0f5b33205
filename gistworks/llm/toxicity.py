"""Toxicity: a logistic word classifier whose scores hardly change when identity terms are swapped.

A text's features are its distinct words and their beginnings, hashed. The
features that separate the labels best, for either one, are chosen and weighed on
a bounded sample of labelled rows. For sentences of that sample that mention a group,
a copy with another group's term in its place is made, and the square of the
difference between both scores is penalised; so a neutral mention of a group
hardly moves the score, whatever texts that group is named in.

Groups are a parameter, with lists in four languages. A corpus may name groups
that no list has, so others are found in the sample: frequent words whose texts
have the labels of all texts, each paired with the one that stands most alike
between the same neighbours. A text gives a bounded number of pairs, those
sentences whose hashes are smallest; the model tells how many there were.

Because the score is a sum over distinct words, each task keeps what a word
adds and scores a text by looking its words up.

A null or empty text gets the score of no evidence. Null identifiers and
repeated rows are scored like others; an empty table gives no rows. Without
labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gistworks.functions.batches import handing_back, parts, values
from gistworks.llm.common import Stored, labelled_sample, prepare

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 12_000
#: Features that may carry a weight, at most.
CHOSEN = 1 << 14
_SLOTS = 1 << 22
_BEGINNINGS = (3, 4, 5, 6, 7, 8)
#: The chi-square that a feature must pass at most; on n texts it is 2 log n, which less than one word in n reaches by chance.
LEAST = 18
#: Sentences of a text that are swapped, at most; words that may be found as groups, and how alike their neighbours must be.
PAIRS, FOUND, ALIKE = 4, 200, 0.5
#: Hashed neighbours of a word.
_CONTEXTS = 256
#: Groups that a text may mention; terms of one row may stand in for each other (fixed values).
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "indian", "chinese", "mexican"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer", "türken", "deutsche"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques", "protestants"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos", "protestantes"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
_SPACED = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
#: Words whose slots or weights a task keeps at most before it starts anew.
CACHE = 1 << 17


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode().translate(_SPACED).split())


def slots(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    from xxhash import xxh3_64_intdigest

    letters = word.decode()
    parts = [b"=" + word, *(b"^" + letters[:n].encode() for n in _BEGINNINGS if len(letters) >= n)]
    return [xxh3_64_intdigest(p) % _SLOTS for p in parts]


def following(groups) -> dict[str, str]:
    """Each term's next one in its row; of a term in several rows the first row counts."""
    out: dict[str, str] = {}
    for row in groups:
        for k, term in enumerate(row):
            out.setdefault(term, row[(k + 1) % len(row)])
    return out


def counterfactuals(text: str | None, swap: dict[str, str] | None = None, most: int = PAIRS) -> list[tuple[str, str]]:
    """Sentences of the text that name a group, each with the next term of its row in that one's place; the ``most`` with the smallest hashes."""
    from xxhash import xxh3_64_intdigest

    swap = following(IDENTITIES) if swap is None else swap
    out = {}
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        words = re.findall(r"\w+", sentence)
        if any(w in swap for w in words):
            whole = " ".join(words)
            out[xxh3_64_intdigest(whole.encode()), whole] = " ".join(swap.get(w, w) for w in words)
    return [(whole, out[h, whole]) for h, whole in sorted(out)[:most]]


@handing_back
def _spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each word, and those of label 1 among them, in this task."""
    texts: dict[str, list[int]] = {}
    for batch in batches:
        for text, label in zip(values(batch.column("text")), batch.column("label").to_pylist()):
            for w in set(re.findall(r"\w+", (text or "").lower())):
                have = texts.setdefault(w, [0, 0])
                have[0] += 1
                have[1] += label > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array(texts, pa.string()), pa.array([t[0] for t in texts.values()], pa.int64()), pa.array([t[1] for t in texts.values()], pa.int64())], ["word", "have", "ones"]
    )


def _neighbours(names: list[str]):
    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each hashed neighbour stands before or after the named words, in this task."""
        from xxhash import xxh3_64_intdigest

        place, half = {w: k for k, w in enumerate(names)}, _CONTEXTS // 2
        counts = np.zeros((len(names), _CONTEXTS), np.int64)
        for batch in batches:
            for text in values(batch.column("text")):
                words = re.findall(r"\w+", (text or "").lower())
                for k, w in enumerate(words):
                    own = place.get(w)
                    if own is None:
                        continue
                    if k:
                        counts[own, xxh3_64_intdigest(words[k - 1].encode()) % half] += 1
                    if k + 1 < len(words):
                        counts[own, half + xxh3_64_intdigest(words[k + 1].encode()) % half] += 1
        at, c = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c, pa.int32()), pa.array(counts[at, c], pa.int64())], ["at", "c", "n"])

    return run


def find_groups(sample: DataFrame, most: int = FOUND, alike: float = ALIKE) -> list[tuple[str, str]]:
    """Pairs of frequent words that say nothing about the label and stand between the same neighbours.

    Of words that at least a two-hundredth of the texts hold, and a chi-square
    of presence below 4, the ``most`` frequent; each is paired with the one of
    most similar neighbours, if their cosine is at least ``alike``.
    """
    n, ones = sample.agg(F.count("*"), F.sum((F.col("label") > 0).cast("long"))).first()
    if not n or not ones or ones == n:
        return []
    words = sample.mapInArrow(_spoken, "word string, have long, ones long")
    found = words.groupBy("word").agg(F.sum("have").alias("have"), F.sum("ones").alias("ones"))
    expected = F.col("have") * (ones / n)
    spread = expected * (1 - ones / n) * (1 - F.col("have") / n) + 1e-9
    usual = found.where((F.col("have") >= max(5, n / 200)) & (F.col("have") < n) & ((F.col("ones") - expected) ** 2 / spread < 4))
    names = [r["word"] for r in usual.orderBy(F.desc("have"), "word").limit(most).select("word").collect()]
    if len(names) < 2:
        return []
    near = sample.mapInArrow(_neighbours(names), "at int, c int, n long").groupBy("at", "c").agg(F.sum("n").alias("n")).toPandas()  # ``most`` words
    counts = np.zeros((len(names), _CONTEXTS))
    counts[near["at"], near["c"]] = near["n"]
    unit = counts / np.maximum(np.linalg.norm(counts, axis=1), 1e-9)[:, None]
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -1)
    return [(w, names[k]) for w, k, c in zip(names, cosines.argmax(axis=1).tolist(), cosines.max(axis=1).tolist()) if c >= alike]


_ROW = "label int, slots array<int>, counts array<float>"


class Slots:
    """A task's words and their slots, kept up to CACHE words; with ``chosen``, only slots among those."""

    def __init__(self, chosen: np.ndarray | None = None):
        self.known: dict[bytes, list[int]] = {}
        self.chosen = None if chosen is None else set(chosen.tolist())

    def counted(self, words: set[bytes]) -> dict[int, float]:
        found: dict[int, float] = {}
        for w in words:
            own = self.known.get(w)
            if own is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                own = slots(w)
                if self.chosen is not None:
                    own = [s for s in own if s in self.chosen]
                self.known[w] = own
            for s in own:
                found[s] = found.get(s, 0.0) + 1.0
        return found

    def difference(self, pair: tuple[str, str]) -> dict[int, float]:
        a, b = (self.counted(words_of(x)) for x in pair)
        return {s: a.get(s, 0.0) - b.get(s, 0.0) for s in a.keys() | b.keys() if a.get(s, 0.0) != b.get(s, 0.0)}


@handing_back
def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have each slot, and those of label 1 among them, in this task."""
    table, have = Slots(), np.zeros((2, _SLOTS), np.int32)
    for batch in batches:
        for text, label in zip(values(batch.column("text")), batch.column("label").to_pylist()):
            found = np.fromiter(table.counted(words_of(text)), np.int64)
            have[int(label > 0), found] += 1
    some = np.flatnonzero(have.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array(have[:, some].sum(axis=0), pa.int64()), pa.array(have[1, some], pa.int64())], ["slot", "have", "ones"]
    )


def _featurise(shipped, swap: dict[str, str]):
    """A row for each text, and one with a null label for each counterfactual difference; chosen slots only."""

    @handing_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Slots(shipped.value)
        for part in (p for batch in batches for p in parts(batch)):
            out = []
            for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist()):
                out.append((label, table.counted(words_of(text))))
                out += [(None, table.difference(p)) for p in counterfactuals(text, swap)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int32()), pa.array([list(f) for _, f in out], pa.list_(pa.int32())), pa.array([list(f.values()) for _, f in out], pa.list_(pa.float32()))],
                ["label", "slots", "counts"],
            )

    return run


class Sparse:
    """Rows of (slot, value) entries."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    @classmethod
    def of(cls, slots: pa.ChunkedArray, values: pa.ChunkedArray, chosen: np.ndarray) -> Sparse:
        slots = slots.combine_chunks()
        sizes = slots.value_lengths().to_numpy()
        cols = np.searchsorted(chosen, slots.flatten().to_numpy())
        return cls(np.repeat(np.arange(len(sizes)), sizes), cols, values.combine_chunks().flatten().to_numpy().astype(float), (len(sizes), len(chosen)))

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.shape[0], -1, np.int64)
        place[rows] = np.arange(len(rows))
        at = place[self.rows]
        return Sparse(at[at >= 0], self.cols[at >= 0], self.values[at >= 0], (len(rows), self.shape[1]))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0])

    def back(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * v[self.rows], self.shape[1])


@dataclass
class Classifier:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    #: Counterfactual pairs that the penalty was taken over.
    pairs: int = 0

    def table(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist()))


def choose(sample: DataFrame, most: int = CHOSEN) -> np.ndarray:
    """The slots whose presence speaks most for either label, by the chi-square of presence; rare ones are left out.

    A word may speak for label 1 or against it. The least chi-square rises with
    the number of texts, as more of the words reach any given one by chance: a
    few dozen texts cannot give a high one.
    """
    n, ones = sample.agg(F.count("*"), F.sum((F.col("label") > 0).cast("long"))).first()
    if not n or not ones or ones == n:
        return np.zeros(0, np.int64)
    found = sample.mapInArrow(_presence, "slot int, have long, ones long").groupBy("slot").agg(F.sum("have").alias("have"), F.sum("ones").alias("ones"))
    expected = F.col("have") * (ones / n)
    spread = expected * (1 - ones / n) * (1 - F.col("have") / n) + 1e-9
    found = found.where(F.col("have") >= max(2, n / 1500))
    found = found.withColumn("score", (F.col("ones") - expected) ** 2 / spread).where(F.col("score") > min(LEAST, 2 * math.log(n)))
    best = found.orderBy(F.desc("score"), "slot").limit(most).select("slot").toPandas()
    return np.sort(best["slot"].to_numpy(np.int64))


def fit_weights(x: Sparse, y: np.ndarray, pairs: Sparse, ridge: float = 0.05, fairness: float = 1.0, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + fairness * mean squared counterfactual difference."""
    w, bias = np.zeros(x.shape[1]), float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    per_pair = 2 * fairness * len(y) / max(1, pairs.shape[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -35, 35)))
        h = p * (1 - p) + 1e-6
        right = -(x.back(p - y) + ridge * w + per_pair * pairs.back(pairs.dot(w)))
        right_bias = -(p - y).sum()

        def curved(v: np.ndarray, b: float, h=h) -> tuple[np.ndarray, float]:
            inner = h * (x.dot(v) + b)
            return x.back(inner) + ridge * v + per_pair * pairs.back(pairs.dot(v)), inner.sum() + 1e-3 * b

        step, step_b = np.zeros_like(w), 0.0
        r, r_b = right.copy(), right_bias
        d, d_b = r.copy(), r_b
        size = r @ r + r_b * r_b
        first = size
        for _ in range(60):
            if size <= 1e-6 * first + 1e-12:
                break
            q, q_b = curved(d, d_b)
            a = size / (d @ q + d_b * q_b)
            step, step_b = step + a * d, step_b + a * d_b
            r, r_b = r - a * q, r_b - a * q_b
            size, before = r @ r + r_b * r_b, size
            d, d_b = r + size / before * d, r_b + size / before * d_b
        w, bias = w + step, bias + step_b
        if np.abs(step).max(initial=0) < 1e-4:
            break
    return w, bias


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", fairness: float = 1.0,
    groups=IDENTITIES, found: int = FOUND,
) -> Classifier:
    """The classifier, from at most ``sample`` labelled rows; ``found`` groups at most are added to ``groups``."""
    prepare(docs.sparkSession)
    # Identifiers may repeat: the bound is on rows. A task for some dozens of texts.
    bounded = labelled_sample(docs, labels, label, sample, id_col, text_col, one_each=True).repartition(24, F.xxhash64("text"))
    rows = Stored(bounded, "toxic-sample")
    chosen = choose(rows.read())
    if not len(chosen):
        return Classifier(chosen, np.zeros(0), -np.inf)
    swap = following([*groups, *(find_groups(rows.read(), found) if found else ())])
    made = rows.read().mapInArrow(_featurise(docs.sparkSession.sparkContext.broadcast(chosen), swap), _ROW).toArrow()  # at most 1 + PAIRS rows to a text
    marks = np.array([-1 if v is None else v for v in made.column("label").to_pylist()], np.int64)
    x = Sparse.of(made.column("slots"), made.column("counts"), chosen)
    at, pairs = np.flatnonzero(marks >= 0), np.flatnonzero(marks < 0)
    weights, bias = fit_weights(x.take(at), (marks[at] > 0).astype(float), x.take(pairs), fairness=fairness)
    return Classifier(chosen, weights, bias, len(pairs))


def with_score(docs: DataFrame, model: Classifier, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """Adds the probability that a text is toxic; all rows and columns stay."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)  # bounded by CHOSEN

    @F.arrow_udf("double")
    @handing_back
    def run(texts: pa.Array) -> pa.Array:
        known = shipped.value
        if not hasattr(known, "adds"):
            known.adds, known.by_slot = {}, known.table()
        adds, by_slot = known.adds, known.by_slot
        out = []
        for text in values(texts):
            total = known.bias
            for word in words_of(text):
                add = adds.get(word)
                if add is None:
                    if len(adds) > CACHE:
                        adds.clear()
                    add = adds[word] = sum(by_slot.get(s, 0.0) for s in slots(word))
                total += add
            out.append(total)
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -700, 700))))

    return docs.withColumn(out_col, run(F.col(f"`{text_col}`")))
