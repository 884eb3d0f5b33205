"""Line dedup against what must hold of any result, whichever way blocks are aligned."""

import random

import pytest

from gistworks.llm import lines

from .conftest import prose


def kept_of(make_docs, rows):
    return dict(map(tuple, lines.dedup_lines(make_docs(rows).repartition(4)).select("doc_id", "text").collect()))


def test_blocks_in_another_order(make_docs):
    p1, p2 = prose(1, 20), prose(2, 20)
    own = [prose(10 + k, 15) for k in range(8)]
    rows = [(1, "\n".join([p1, own[0], p2])), (2, "\n".join([own[1], p2, own[2], p1])), (3, "\n".join([p2, own[3], p1, own[4]])), (4, "\n".join([own[5], p1, p2, own[6]]))]
    assert kept_of(make_docs, rows) == {1: rows[0][1], 2: "\n".join(own[1:3]), 3: "\n".join(own[3:5]), 4: "\n".join(own[5:7])}


def test_passages_in_short_lines(make_docs):
    verse = [prose(100 + k, 5) for k in range(40)]
    own = [[prose(1000 + 10 * k + j, 5) for j in range(6)] for k in range(4)]
    rows = [(k, "\n".join([*own[k][:3], *(verse if k else verse + ["z"]), *own[k][3:]])) for k in range(3)] + [(3, "\n".join([*own[3], verse[7], "x", verse[9]]))]
    got = kept_of(make_docs, rows)
    assert got == {0: rows[0][1], 1: "\n".join(own[1]), 2: "\n".join(own[2]), 3: rows[3][1]}


@pytest.mark.parametrize("seed", range(6))
def test_of_a_long_line_only_the_first_copy_stays(make_docs, seed):
    draw = random.Random(seed)
    stock = [prose(2000 + k, draw.choice([1, 3, 9, 12])) for k in range(25)]
    rows = [(k, "\n".join(draw.choice(stock) if draw.random() < 0.6 else prose(5000 + 100 * k + j, 10) for j in range(draw.randint(1, 14)))) for k in range(40)]
    got = kept_of(make_docs, rows)
    seen = set()
    for k, text in rows:
        own = text.split("\n")
        left = got[k].split("\n") if got[k] else []
        # What stays is in order and from the text; lines that nobody had before stay, long ones that somebody had go.
        rest = iter(own)
        assert all(x in rest for x in left)
        assert [x for x in left if len(x.split()) >= 8] == [x for x in own if len(x.split()) >= 8 and x not in seen]
        assert not [x for x in own if x not in seen and x not in left]
        seen |= set(own)


def test_short_runs_go_and_single_short_lines_stay():
    hashes, words = lines.line_hashes(b"a b c\nd e\n\nf g h\none two three four five six seven eight nine\ni j")
    found = lines.proposals(hashes, words, 8)
    assert hashes[4] in found and len(found) == 2
    assert lines.proposals(hashes[:2], words[:2], 8) == []


def test_reversed_texts_are_bounded_work():
    a, b = list(range(1, 3001)), list(range(3000, 0, -1))
    assert lines.common_blocks(a, b, [9] * 3000, 8) == list(range(3000))
    # Short lines in blocks of two, the blocks in reverse: block by block, as far as the rounds go.
    pairs = [(2 * k, 2 * k + 1) for k in range(40)]
    flat, back = [x + 1 for p in pairs for x in p], [x + 1 for p in pairs[::-1] for x in p]
    assert lines.common_blocks(flat, back, [4] * 80, 8) == list(range(80))
