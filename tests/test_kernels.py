"""Sequence kernels and the stemmer against plain definitions."""

from collections import Counter

from hypothesis import given, strategies as st

from gistworks.functions import kernels
from gistworks.functions.kernels import lcs_length, lcs_reference_places, summary_lcs_hits
from gistworks.functions.porter import stem, stem_token

words = st.lists(st.sampled_from("abcd"), max_size=14)
sentences = st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), max_size=4)


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def places(reference, prediction):
    """The walk back over the full table; ties drop the reference's token."""
    t, i, j, found = table(reference, prediction), len(reference), len(prediction), set()
    while i > 0 and j > 0:
        if reference[i - 1] == prediction[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def union_hits(reference, prediction):
    left = [Counter(t for s in side for t in s) for side in (reference, prediction)]
    hits = 0
    for s in reference:
        union = set().union(*[places(s, p) for p in prediction]) if prediction else set()
        for i in sorted(union):
            if all(c[s[i]] > 0 for c in left):
                hits += 1
                for c in left:
                    c[s[i]] -= 1
    return hits


@given(words, words)
def test_lcs_length(a, b):
    assert lcs_length(a, b) == table(a, b)[-1][-1] == lcs_length(b, a)


def test_masks():
    tokens = [str(i * i % 7) for i in range(100)]
    plain = {w: sum(1 << i for i, t in enumerate(tokens) if t == w) for w in ("1", "2")}
    assert kernels._positions(tokens, {"1", "2", "9"}) == plain
    assert lcs_length(tokens * 30, tokens[::-1] + tokens * 30) == 3000


@given(words, words)
def test_places_follow_the_tie_rule(a, b):
    masks = {x: sum(1 << i for i, y in enumerate(b) if y == x) for x in set(b)}
    assert lcs_reference_places(a, masks, b) == places(a, b)


@given(sentences, sentences)
def test_summary_hits(r, p):
    hits = summary_lcs_hits(r, p)
    assert hits == union_hits(r, p)
    assert hits <= min(sum(map(len, r)), sum(map(len, p)))


def test_union_example():
    # The example of Lin 2004, 3.2: the union of w1 w2 and w1 w3 w5 has four words.
    reference = [["w1", "w2", "w3", "w4", "w5"]]
    prediction = [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    assert summary_lcs_hits(reference, prediction) == 4


def test_stems_of_the_paper():
    # Examples given in Porter 1980.
    examples = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
        "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
        "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform",
        "radicalli": "radic", "differentli": "differ", "vileli": "vile", "analogousli": "analog",
        "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
        "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formaliti": "formal",
        "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form",
        "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop",
        "adjustable": "adjust", "defensible": "defens", "irritant": "irrit", "replacement": "replac",
        "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog",
        "communism": "commun", "activate": "activ", "angulariti": "angular", "homologous": "homolog",
        "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
        "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {w: stem(w) for w in examples} == examples


def test_short_tokens_are_not_stemmed():
    assert stem_token("was") == "was" and stem_token("this") == "thi"


def test_places_of_long_lists():
    """Rows between the kept ones are made again: many of them here."""
    a = [str(i * 7919 % 23) for i in range(300)]
    b = [str(i * 104729 % 19) for i in range(270)]
    masks = {x: sum(1 << i for i, y in enumerate(b) if y == x) for x in set(b)}
    found = lcs_reference_places(a, masks, b)
    assert found == places(a, b) and len(found) == lcs_length(a, b)
