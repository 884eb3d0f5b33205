"""Tokenizers: one rule for counting, cutting, encoding and decoding.

A tokenizer has a column form, an array of tokens, and cuts a text after its
n-th token; one with a vocabulary of its own also gives ids and spells them out
again. The default rule stays inside the JVM; a user's own batch functions or a
model of subword pieces can take its place. What a worker needs for them is made
once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, SparkSession, functions as F

from gistworks.functions.batches import parts
from gistworks.functions.subword import UnigramModel

TOKEN_PATTERN = "[a-z0-9]+"
# Lower-casing makes token characters of the Kelvin sign and, with a mark after it that ends the run, of the dotted I.
_CHARS = "A-Za-z0-9\u212a"
UP_TO_TOKEN = f"[^{_CHARS}\u0130]*(?:[{_CHARS}]*\u0130|[{_CHARS}]+)"

#: Turns a batch of texts into their tokens: (start, end, token) in characters.
BatchTokenizer = Callable[[list[str]], list[list[tuple[int, int, str]]]]
#: Turns a batch of texts into ids, and a batch of ids into texts.
BatchEncoder = Callable[[list[str]], list[list[int]]]
BatchDecoder = Callable[[list[list[int]]], list[str]]


@dataclass(frozen=True)
class Tokenizer:
    """``tokens`` maps a text column to an array of strings; ``cut`` keeps a text up to the end of its n-th token.

    ``sizes`` counts tokens without listing them. ``ids`` gives the ids of a
    text's first n tokens (all if None) and ``spell`` the text of ids, where the
    tokenizer has a vocabulary of its own.
    """

    tokens: Callable[[Column], Column]
    cut: Callable[[Column, int], Column]
    sizes: Callable[[Column], Column] | None = None
    ids: Callable[[Column, int | None], Column] | None = None
    spell: Callable[[Column], Column] | None = None

    def count(self, text: Column) -> Column:
        if self.sizes is not None:
            return self.sizes(text)
        return F.size(self.tokens(text)).cast("long")


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def _cut_runs(text: Column, n: int) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(UP_TO_TOKEN), F.lit(0))
    return F.when(F.size(pieces) <= n, text).otherwise(F.array_join(F.slice(pieces, 1, n), ""))


#: Lower-cased maximal runs of ``[a-z0-9]``; accented letters end a run, so "élève" gives "l", "ve".
RUNS = Tokenizer(_runs, _cut_runs)


def per_task(make: Callable[[], Callable[[list], list]], returns: str) -> Callable[[Column], Column]:
    """A column function from a function of some rows' values that are not null; ``make`` is called once per task.

    It is given a part of a batch at a time, bounded in bytes. Null values stay
    null.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(f"x {returns}")[0].dataType)

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = make()
        for part in (p for batch in batches for p in parts(batch)):
            values = part.to_pylist()
            found = iter(apply([v for v in values if v is not None]))
            yield pa.array([None if v is None else next(found) for v in values], kind)

    return run


def _cutter(make: Callable[[], BatchTokenizer], n: int):
    def made():
        find = make()

        def cut(texts: list[str]) -> list[str]:
            out = []
            for text, spans in zip(texts, find(texts)):
                out.append(text if len(spans) <= n else text[: spans[n - 1][1]] if n else "")
            return out

        return cut

    return made


def batch_tokenizer(
    make: Callable[[], BatchTokenizer], make_encoder: Callable[[], BatchEncoder] | None = None, make_decoder: Callable[[], BatchDecoder] | None = None
) -> Tokenizer:
    """A tokenizer from a user's batch functions; each ``make`` is called once per task in a worker.

    With an encoder and a decoder the tokenizer has ids of its own.
    """

    def listed():
        find = make()
        return lambda texts: [[token for *_, token in spans] for spans in find(texts)]

    def counted():
        find = make()
        return lambda texts: [len(spans) for spans in find(texts)]

    def encoded(most: int | None):
        def made():
            encode = make_encoder()
            return lambda texts: [list(ids)[:most] for ids in encode(texts)]

        return made

    return Tokenizer(
        per_task(listed, "array<string>"),
        lambda text, n: per_task(_cutter(make, n), "string")(text),
        per_task(counted, "bigint"),
        None if make_encoder is None else lambda text, n: per_task(encoded(n), "array<int>")(text),
        None if make_decoder is None else per_task(make_decoder, "string"),
    )


def subword_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    """The tokenizer of a model of scored pieces; ``path`` is read on the driver and its pieces shipped, a MB or two."""
    model = UnigramModel.read(path)
    shipped = spark.sparkContext.broadcast((model.pieces, model.bytes_, model.unknown))

    def own() -> UnigramModel:
        return UnigramModel(*shipped.value)

    def find():
        model = own()
        names = {i: p for p, (i, _) in model.pieces.items()}
        return lambda texts: [[(a, b, names.get(i, f"<{i}>")) for a, b, i in model.spans(t)] for t in texts]

    def find_first(n: int):
        def made():
            model = own()
            return lambda texts: [model.spans(t, n + 1) for t in texts]

        return made

    def listed():
        found = find()
        return lambda texts: [[token for *_, token in spans] for spans in found(texts)]

    def counted():
        model = own()
        return lambda texts: [len(model.encode(t)) for t in texts]

    def encoded(most: int | None):
        def made():
            model = own()
            return lambda texts: [model.encode(t, most) for t in texts]

        return made

    def spelled():
        model = own()
        return lambda lists: [model.decode(ids) for ids in lists]

    return Tokenizer(
        per_task(listed, "array<string>"),
        lambda text, n: per_task(_cutter(find_first(n), n), "string")(text),
        per_task(counted, "bigint"),
        lambda text, n: per_task(encoded(n), "array<int>")(text),
        per_task(spelled, "string"),
    )
