"""N-gram matches of many pairs at once against their definition."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from gistworks.functions import grams


def plain(prediction, reference, n):
    sides = [re.findall("[a-z0-9]+", t or "") for t in (prediction, reference)]
    counts = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in sides]
    return (counts[0] & counts[1]).total()


@pytest.fixture
def texts():
    draw = random.Random(7)
    pieces = ["a", "b", "ab", "é", "ß9", "c3", "\n", "", "日本a", "x-y"]

    def text():
        return None if draw.random() < 0.1 else "".join(draw.choice(pieces) + draw.choice(" \n-") * draw.randint(0, 2) for _ in range(draw.randint(0, 30)))

    return [text() for _ in range(300)], [text() for _ in range(300)]


@pytest.mark.parametrize("most", [grams._MOST, 500, 1])
def test_against_the_definition(texts, most, monkeypatch):
    """Also where a part is cut in two, down to single rows."""
    monkeypatch.setattr(grams, "_MOST", most)
    predictions, references = (pa.array(t).slice(3) for t in texts)
    got = grams.matches(predictions, references, (1, 2))
    pairs = list(zip(*texts))[3:]
    want = [[len(re.findall("[a-z0-9]+", t or "")) for t in side] for side in zip(*pairs)]
    want += [[plain(p, r, n) for p, r in pairs] for n in (1, 2)]
    assert [g.tolist() for g in got] == want


def test_tokens_end_with_their_text_and_rows_without_any():
    predictions, references = pa.array(["ab", "c", "", None, "-", "a a a"]), pa.array(["a", "bc", "", "x", "é", "a a"])
    got = [g.tolist() for g in grams.matches(predictions, references, (1, 2))]
    assert got == [[1, 1, 0, 0, 0, 3], [1, 1, 0, 1, 0, 2], [0, 0, 0, 0, 0, 2], [0, 0, 0, 0, 0, 1]]
    nothing = pa.array([None, ""], pa.string())
    assert [g.tolist() for g in grams.matches(nothing, nothing, (2,))] == [[0, 0]] * 3
