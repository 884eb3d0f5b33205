"""Sentences, with abbreviations found from the corpus itself (Kiss and Strunk 2006, types only).

A word that almost always stands with a period is an abbreviation, the more so
the shorter it is and the more periods it has inside. Its count with and without
period is set against the share of periods in the whole corpus by a likelihood
ratio. Counting is one aggregation with partial sums; the words that come out
are few, and are shipped to the tasks if their bytes allow it, else joined.

A sentence ends at a word with ``.``, ``!`` or ``?`` at its end (closing quotes
and brackets may follow), unless the next word starts with a small letter, or
the end is a single period after an abbreviation or a single letter. Text is
never changed: a sentence runs from its first to its last word.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gistworks.functions.tokenizer import per_task
from gistworks.operators.joins import is_small, keys_of
from gistworks.session import discard, materialize

# The paper's threshold and its probability of a period after an abbreviation.
THRESHOLD, SURE = 0.3, 0.99
BLANKS = r" \t\n\x0b\f\r"
OPENERS, _OPENERS, CLOSERS = "\"'([{«“‘", "\"'(\\[{«“‘", "\"')\\]}»”’"
WORD = f"[^{BLANKS}]+"
#: A word's last periods, exclamation and question marks, and closers.
_END = re.compile(f"([.!?]+)[{CLOSERS}]*$")
_WORD = re.compile(WORD)


def word_counts(texts: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(word, with_period, without) over all texts: lower-cased words with a letter, without what surrounds them.

    Words with one period at their end, and words with none of ``.!?`` there;
    other words and null texts are left out. Also the row of the empty word,
    which counts all words: those with a period, and all others.
    """
    listed = F.explode(F.concat(*[F.coalesce(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), F.array()) for c in columns]))
    words = texts.select(listed.alias("whole"))
    bare = F.lower(F.regexp_replace(F.regexp_replace("whole", f"[{CLOSERS},;:]+$", ""), f"^[{_OPENERS}]+", ""))
    words = words.select(bare.alias("bare"))
    dotted = F.col("bare").endswith(".")
    word = F.when(dotted, F.expr("substring(bare, 1, length(bare) - 1)")).otherwise(F.col("bare"))
    # One period, not several; something to count at all.
    fits = F.regexp_like(word, F.lit(r"\p{L}")) & ~F.regexp_like(word, F.lit("[.!?]$"))
    each = words.select(F.inline(F.array(F.struct(F.when(fits, word).alias("word"), dotted.alias("dotted")), F.struct(F.lit("").alias("word"), dotted.alias("dotted")))))
    return each.where("word is not null").groupBy("word").agg(F.count_if("dotted").alias("with_period"), F.count_if(~F.col("dotted")).alias("without"))


def abbreviation_score(share: Column) -> Column:
    """The score of a row of :func:`word_counts`; ``share`` is the part of all words that have a period."""
    a, b = F.col("with_period"), F.col("without")
    ratio = -2 * (a * F.log(share / SURE) + b * F.log((1 - share) / (1 - SURE)))
    letters = F.length(F.replace("word", F.lit(".")))
    inside = F.length("word") - letters
    return ratio * F.exp(-letters) * (inside + 1) * F.pow(letters.cast("double"), -b)


def find_abbreviations(texts: DataFrame, columns: tuple[str, ...] = ("text",), threshold: float = THRESHOLD) -> DataFrame:
    """(word, with_period, without, score) of the corpus' abbreviations; a stored table."""
    counts = materialize(word_counts(texts, columns), "words")
    total = counts.where("word = ''").select((F.col("with_period") / (F.col("with_period") + F.col("without"))).alias("share")).first()
    # Without periods, or with nothing else, there is nothing to tell apart.
    share = total["share"] if total else 0.0
    usual = counts.where("word <> '' and with_period > 0")
    scored = usual.withColumn("score", abbreviation_score(F.lit(share))) if 0 < share < 1 else usual.withColumn("score", F.lit(0.0))
    found = materialize(scored.where(F.col("score") >= threshold), "abbreviations")
    discard(counts)
    return found


def candidate_ends(text: str) -> list[tuple[int, str | None]]:
    """Where sentences may end, in characters, and the word that prevents it if it is an abbreviation (null: none does)."""
    out = []
    spans = [m.span() for m in _WORD.finditer(text)]
    for (a, b), (c, d) in zip(spans, spans[1:]):
        end = _END.search(text, a, b) if text[b - 1] in ".!?\"')]}»”’" else None
        if end is None:
            continue
        following = text[c:d].lstrip(OPENERS)
        if following and unicodedata.category(following[0]) == "Ll":
            continue
        word = None
        if end[1] == ".":
            word = text[a : end.start()].lstrip(OPENERS).lower()
            if len(word) == 1 and word.isalpha():
                continue
        out.append((b, word))
    return out


def cut_at(text: str, ends: list[int]) -> list[str]:
    """The sentences between ``ends`` (ascending), without the blanks around them."""
    edges = [0, *ends, len(text)]
    parts = (text[a:b].strip(" \t\n\x0b\f\r") for a, b in zip(edges, edges[1:]))
    return [p for p in parts if p]


def split_text(text: str, abbreviations: set[str] | frozenset[str]) -> list[str]:
    return cut_at(text, [end for end, word in candidate_ends(text) if word is None or word not in abbreviations])


def sentence_splitter(abbreviations: DataFrame) -> Callable[[Column], Column]:
    """A column function from texts to arrays of sentences; the abbreviations are shipped, so they must be small in bytes."""
    words = abbreviations.select("word")
    if not is_small(words):
        raise ValueError("too many abbreviations to ship; use split_sentences")
    shipped = abbreviations.sparkSession.sparkContext.broadcast(words.toArrow())

    def make():
        known = frozenset(shipped.value.column("word").to_pylist())
        return lambda texts: [split_text(t, known) for t in texts]

    return per_task(make, "array<string>")


def _candidates():
    return lambda texts: [[{"end": e, "word": w} for e, w in candidate_ends(t)] for t in texts]


def split_sentences(df: DataFrame, abbreviations: DataFrame, column: str = "text", into: str = "sentences") -> DataFrame:
    """``df`` with an array of each text's sentences; null texts have none.

    Shipped abbreviations cost one Arrow pass without a shuffle. If they are
    too large, the words at possible ends are joined with them by word, and the
    ends come back to their rows by number.
    """
    none = F.array().cast("array<string>")
    if is_small(abbreviations.select("word")):
        return df.withColumn(into, F.coalesce(sentence_splitter(abbreviations)(F.col(column)), none))
    return _split_by_join(df, abbreviations, column, into)


def _split_by_join(df: DataFrame, abbreviations: DataFrame, column: str, into: str) -> DataFrame:
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = per_task(_candidates, "array<struct<end:int,word:string>>")(F.col(column))
    each = stored.select("_row", F.inline(found))
    kept = each.join(abbreviations.select("word"), "word", "left_anti")
    ends = kept.groupBy("_row").agg(F.sort_array(F.collect_list("end")).alias("_ends"))

    def make():
        return lambda pairs: [cut_at(p["text"], p["ends"]) for p in pairs]

    back = stored.join(ends, "_row", "left")
    given = F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("text"), F.coalesce("_ends", F.array().cast("array<int>")).alias("ends")))
    return back.withColumn(into, F.coalesce(per_task(make, "array<string>")(given), F.array().cast("array<string>"))).select(*df.columns, into)


def sentence_lines(pairs: DataFrame, abbreviations: DataFrame, columns: tuple[str, ...] = ("prediction", "reference")) -> DataFrame:
    """Pairs with each sentence on a line of its own, as summary-level LCS takes them."""
    for c in columns:
        split = split_sentences(pairs.withColumn("_text", F.col(c)), abbreviations, "_text", "_sentences")
        broken = F.transform("_sentences", lambda s: F.regexp_replace(s, f"[{BLANKS}]*\n[{BLANKS}]*", "\n"))
        pairs = split.withColumn(c, F.when(F.col(c).isNotNull(), F.array_join(broken, "\n"))).drop("_text", "_sentences")
    return pairs


def sentences_of(df: DataFrame, abbreviations: DataFrame, column: str = "text") -> DataFrame:
    """(keys, nth, sentence), one row a sentence."""
    keys = keys_of(df)
    return split_sentences(df.select(*keys, column), abbreviations, column).select(*keys, F.posexplode("sentences").alias("nth", "sentence"))
