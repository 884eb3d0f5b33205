"""Token ids: building a vocabulary, encoding texts, decoding ids."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from gistworks.functions.batches import parts
from gistworks.functions.text import ANSWER_MARKER, prompt_prefix, reserve_suffix
from gistworks.functions.tokenizer import RUNS, TOKEN_PATTERN, Tokenizer, per_task
from gistworks.operators.joins import is_small, keys_of
from gistworks.operators.selection import kth_smallest
from gistworks.session import discard, materialize

# The reserved ids and the mark of a label to ignore.
PAD, UNK, EOS = 0, 1, 2
FIRST_FREE = 3
IGNORE = -100


def build_vocab(
    df: DataFrame, columns: tuple[str, ...] = ("text", "summary"), size: int = 32000, tokenizer: Tokenizer = RUNS
) -> DataFrame:
    """(token, n, token_id): the most frequent tokens, ties in token order.

    The counts are stored once. The size-th largest count is then found
    exactly, so that only tokens that can enter the vocabulary (and ties with
    the last one) reach the final top-n; ids are numbered over at most ``size``
    rows. Returns a stored table.
    """
    spelled = F.explode(F.concat(*[F.coalesce(tokenizer.tokens(F.col(c)), F.array()) for c in columns]))
    counts = materialize(
        df.select(spelled.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")), "counts"
    )
    least = kth_smallest(counts.select((-F.col("n")).alias("v")), "v", size)
    candidates = counts if least is None else counts.where(F.col("n") >= -least)
    by_rank = (F.desc("n"), F.asc("token"))
    top = candidates.orderBy(*by_rank).limit(size)
    numbered = F.row_number().over(Window.orderBy(*by_rank)) + (FIRST_FREE - 1)
    numbered_top = materialize(top.withColumn("token_id", numbered.cast("int")), "vocab")
    discard(counts)
    return numbered_top


def _close(ids: Column, max_len: int, add_eos: bool) -> Column:
    if not add_eos:
        return ids
    return F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(EOS)))


def pad_ids(ids: Column, max_len: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(ids)))


def attention_mask(ids: Column, max_len: int) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(max_len) - F.size(ids))
    )


def lookup_ids(
    df: DataFrame, sides: dict[str, str], vocab: DataFrame | None, max_len: int, keys: Sequence[str] | None = None, tokenizer: Tokenizer = RUNS
) -> DataFrame:
    """keys and the token ids of several text columns, cut to ``max_len``.

    Without a vocabulary the tokenizer's own ids are taken. A vocabulary of
    bounded bytes is shipped, and the ids are looked up row by row in one Arrow
    pass without a shuffle, under the default rule without listing the tokens
    beyond the cut; a larger one is joined.
    """
    keys = keys_of(df, keys=keys)
    if vocab is None:
        if tokenizer.ids is None:
            raise ValueError("a vocabulary is needed, or a tokenizer with ids of its own")
        none = F.array().cast("array<int>")
        return df.select(*keys, *[F.coalesce(tokenizer.ids(F.col(c), max_len), none).alias(s) for s, c in sides.items()])
    entries = vocab.select("token", "token_id")
    if is_small(entries):
        shipped = df.sparkSession.sparkContext.broadcast(entries.toArrow())
        if tokenizer is RUNS:
            find = _first_runs(shipped, max_len)
            return df.select(*keys, *[find(F.lower(F.coalesce(F.col(c), F.lit("")))).alias(s) for s, c in sides.items()])
        find = _finder(shipped)
        return df.select(*keys, *[find(_first(tokenizer, c, max_len)).alias(s) for s, c in sides.items()])
    return _join_ids(df.select(*keys, *[_first(tokenizer, c, max_len).alias(s) for s, c in sides.items()]), list(sides), entries, keys)


def _first(tokenizer: Tokenizer, column: str, n: int) -> Column:
    return F.slice(F.coalesce(tokenizer.tokens(F.col(column)), F.array().cast("array<string>")), 1, n)


def _known(shipped) -> dict[str, int]:
    table = shipped.value
    return dict(zip(table.column("token").to_pylist(), table.column("token_id").to_pylist()))


def _first_runs(shipped, n: int):
    """Ids of the first ``n`` tokens of lower-cased texts; the vocabulary's table is made once per task."""

    def make():
        known, each = _known(shipped), re.compile(TOKEN_PATTERN).finditer
        return lambda texts: [[known.get(m[0], UNK) for m in islice(each(t), n)] for t in texts]

    return per_task(make, "array<int>")


def _finder(shipped):
    def make():
        known = _known(shipped)
        return lambda lists: [[known.get(t, UNK) for t in tokens] for tokens in lists]

    return per_task(make, "array<int>")


def _join_ids(rows: DataFrame, sides: list[str], entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same by a join, for a vocabulary of any size.

    Rows are numbered and stored, so that equal keys stay apart; position and
    id travel as one number, which sorts by position.
    """
    sizes = [f"n_{s}" for s in sides]
    stored = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    listed = stored.select("_row", F.posexplode(F.concat(*sides)).alias("position", "token"))
    found = listed.join(entries, "token", "left")
    entry = F.shiftleft(F.col("position").cast("long"), 32) + F.coalesce("token_id", F.lit(UNK))
    grouped = found.groupBy("_row").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    back = stored.select("_row", *keys, *[F.size(s).alias(n) for s, n in zip(sides, sizes)]).join(grouped, "_row", "left")
    ids = back.withColumn("ids", F.transform(F.coalesce("entries", F.array().cast("array<long>")), lambda e: (e % (1 << 32)).cast("int")))
    starts = [sum((F.col(n) for n in sizes[:i]), F.lit(1)) for i in range(len(sizes))]
    return ids.select(*keys, *[F.slice("ids", at, F.col(n)).alias(s) for s, n, at in zip(sides, sizes, starts)])


def encode_fixed(
    df: DataFrame, vocab: DataFrame | None, max_len: int, column: str = "text", add_eos: bool = False,
    keys: Sequence[str] | None = None, tokenizer: Tokenizer = RUNS,
) -> DataFrame:
    """(keys, input_ids, attention_mask), cut to ``max_len`` and padded on the right."""
    found = lookup_ids(df, {"ids": column}, vocab, max_len, keys, tokenizer)
    ids = _close(F.col("ids"), max_len, add_eos)
    return found.select(
        *keys_of(df, keys=keys), pad_ids(ids, max_len).alias("input_ids"), attention_mask(ids, max_len).alias("attention_mask")
    )


def encode_pairs(
    df: DataFrame, vocab: DataFrame | None, max_len: int, add_eos: bool = False, ignore_padding: bool = False,
    keys: Sequence[str] | None = None, tokenizer: Tokenizer = RUNS,
) -> DataFrame:
    """Encoded text and summary; labels have the same width as the inputs.

    ``ignore_padding`` marks the padding of labels as positions to ignore.
    """
    found = lookup_ids(df, {"text_ids": "text", "label_ids": "summary"}, vocab, max_len, keys, tokenizer)
    ids, label_ids = (_close(F.col(c), max_len, add_eos) for c in ("text_ids", "label_ids"))
    labels = pad_ids(label_ids, max_len)
    if ignore_padding:
        labels = F.transform(labels, lambda x: F.when(x == PAD, F.lit(IGNORE)).otherwise(x))
    return found.select(
        *keys_of(df, keys=keys),
        pad_ids(ids, max_len).alias("input_ids"),
        attention_mask(ids, max_len).alias("attention_mask"),
        labels.alias("labels"),
    )


def decode_ids(df: DataFrame, vocab: DataFrame | None, column: str, keys: Sequence[str] | None = None, tokenizer: Tokenizer = RUNS) -> DataFrame:
    """(keys, text): reserved and unknown ids skipped, tokens joined by single blanks.

    Like encoding, one Arrow pass if the vocabulary is small in bytes, else a
    join. Without a vocabulary the tokenizer spells its own ids out.
    """
    keys = keys_of(df, keys=keys)
    plain = F.filter(F.coalesce(F.col(column), F.array().cast("array<int>")), lambda x: x >= FIRST_FREE)
    if vocab is None:
        if tokenizer.spell is None:
            raise ValueError("a vocabulary is needed, or a tokenizer that spells ids")
        return df.select(*keys, tokenizer.spell(plain).alias("text"))
    entries = vocab.select("token", "token_id")
    if is_small(entries):
        spell = _speller(df.sparkSession.sparkContext.broadcast(entries.toArrow()))
        return df.select(*keys, spell(plain).alias("text"))
    stored = materialize(df.select(*keys, plain.alias("ids"), F.monotonically_increasing_id().alias("_row")), "rows")
    spelled = stored.select("_row", F.posexplode("ids").alias("position", "token_id")).join(entries, "token_id")
    words = F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda e: e["token"])
    texts = spelled.groupBy("_row").agg(F.array_join(words, " ").alias("text"))
    return stored.join(texts, "_row", "left").select(*keys, F.coalesce("text", F.lit("")).alias("text"))


def _speller(shipped):
    def spelled(ids: pa.Array, table: pa.Table) -> pa.Array:
        at = pc.index_in(ids.flatten(), value_set=table.column("token_id").combine_chunks())
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))[known]
        tokens = pc.take(table.column("token").combine_chunks(), at.drop_null())
        offsets = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")

    @F.arrow_udf("string")
    def spell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (p for batch in batches for p in parts(batch)):
            yield spelled(part, shipped.value)

    return spell


def unmask(labels: Column) -> Column:
    """Ignored label positions become padding."""
    return F.transform(labels, lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x))


def causal_prompt_ids(
    df: DataFrame, vocab: DataFrame, max_length: int, max_new_tokens: int, keys: Sequence[str] | None = None, tokenizer: Tokenizer = RUNS
) -> DataFrame:
    """(keys, input_ids) of the prompted text, its last slots spelling the answer marker.

    The width leaves room for the answer: ``max_length - max_new_tokens``.
    """
    width = max_length - max_new_tokens
    keys = keys_of(df, keys=keys)
    prompted = df.select(*keys, prompt_prefix(F.col("text")).alias("text"))
    encoded = encode_fixed(prompted, vocab, width, keys=keys, tokenizer=tokenizer)
    return encoded.select(*keys, reserve_suffix(F.col("input_ids"), marker_ids(vocab)).alias("input_ids"))


def marker_ids(vocab: DataFrame) -> Column:
    """The answer marker as ids (here one token), as a one-row subquery."""
    word = ANSWER_MARKER.strip(":").lower()
    found = vocab.where(F.col("token") == word).agg(F.coalesce(F.max("token_id"), F.lit(UNK)))
    return F.array(found.scalar())
