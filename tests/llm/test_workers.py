"""What the Python steps hold at once, and what they leave to the next task of the same worker."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gistworks.functions.batches import PART_BYTES, handing_back, values
from gistworks.llm import decontaminate, toxicity

from .conftest import HARD


def batch(megabytes: int) -> pa.RecordBatch:
    """Texts of 10 KB of few long words."""
    draw = random.Random(5)
    known = [chr(97 + k) * 1000 for k in range(20)]
    texts = [" ".join(draw.choices(known, k=10)) for _ in range(100)] * megabytes
    return pa.RecordBatch.from_pydict({"text": texts, "label": pa.array([k % 2 for k in range(len(texts))], pa.int32())})


def peak(step, megabytes: int) -> float:
    """MB of Python objects and arrays at most, while a step works off one batch."""
    rows = batch(megabytes)
    tracemalloc.start()
    for _ in step(iter([rows])):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


class Shipped:
    value = np.arange(0, 1 << 22, 64)


STEPS = {
    "spoken": lambda: toxicity._spoken,
    "neighbours": lambda: toxicity._neighbours(["a" * 1000, "b" * 1000]),
    "presence": lambda: toxicity._presence,
    "featurise": lambda: toxicity._featurise(Shipped, {}),
    "frequencies": lambda: decontaminate._frequencies,
}


@pytest.mark.parametrize("name", STEPS)
def test_a_larger_batch_is_not_held_as_objects(name):
    step = STEPS[name]()
    peak(step, 1)
    assert peak(step, 24) - peak(step, 6) < 6


def test_featurised_rows_come_part_by_part():
    rows = batch(5)
    made = list(toxicity._featurise(Shipped, {})(iter([rows])))
    assert len(made) >= 5 * 10**6 // (PART_BYTES + 20_000) and sum(map(len, made)) == len(rows)
    alone = [b for k in range(0, len(rows), 50) for b in toxicity._featurise(Shipped, {})(iter([rows.slice(k, 50)]))]
    assert pa.Table.from_batches(made).to_pylist() == pa.Table.from_batches(alone).to_pylist()


def test_values_and_hashes_of_a_column_in_parts():
    texts = [t for _, t in HARD] * 30 + [None, ""]
    column = pa.array(texts)
    assert list(values(column)) == texts and list(values(column.slice(0, 0))) == []
    of = decontaminate.Words().of
    encoded = [None if t is None else t.encode() for t in texts]
    runs, again = list(of(encoded)), list(of(x for x in encoded))
    assert len(runs) > 1 and sum(len(c) for _, c, _ in runs) == len(texts) and [f for f, *_ in runs] == np.cumsum([0, *(len(c) for _, c, _ in runs)])[:-1].tolist()
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(runs, again, strict=True))
    assert list(of([])) == []


def test_handing_back_keeps_results_and_errors():
    @handing_back
    def three(n):
        yield from range(n)
        raise KeyError("end")

    made = three(3)
    assert [next(made) for _ in range(3)] == [0, 1, 2]
    with pytest.raises(KeyError):
        next(made)
    assert handing_back(lambda a, b: a - b)(5, 3) == 2


_LEFT = """
import random, re, sys
import pyarrow as pa, regex
import public_tokenizers
from gistworks.llm import bpe, decontaminate

bpe.task_number = lambda: 0
steps = {"frequencies": decontaminate._frequencies, "cut": bpe._cut(public_tokenizers.PATTERN, 48, ["doc_id"])}
step, draw = steps[sys.argv[1]], random.Random(2)
words = ["".join(draw.choices("abcdefghij", k=7)) for _ in range(200_000)]

def run(n):
    texts = [" ".join(draw.choices(words, k=400)) for _ in range(n)]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(n), "text": texts})
    del texts
    for _ in step(iter([batch])):
        pass

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

run(50)
before = held()
run(6000)
print(held() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
@pytest.mark.parametrize("name", ["frequencies", "cut"])
def test_a_worker_keeps_little_of_what_a_step_needed(name):
    said = subprocess.run([sys.executable, "-c", _LEFT, name], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, check=True)
    assert float(said.stdout.split()[-1]) < 30
