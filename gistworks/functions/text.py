"""Column expressions over text: tokens, prompts, clipping, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gistworks.functions.tokenizer import RUNS, Tokenizer

# The instruction put before a text, with and without its marker.
INSTRUCTION = "You are an expert at summarization. Proceed to summarize the following text. "
TEXT_MARKER = "TEXT: "
ANSWER_MARKER = "SUMMARY:"

# The chat budget. A message costs 4 tokens, a reply primer 3,
# and one is kept spare.
CONTEXT_TOKENS = 4096
NEW_TOKENS = 256
TOKENS_PER_MESSAGE = 4
TOKENS_PER_PROMPT = 3
CHAT_BUDGET = CONTEXT_TOKENS - NEW_TOKENS - TOKENS_PER_MESSAGE - TOKENS_PER_PROMPT - 1

_WHITESPACE = " \t\n\r\x0b\x0c"


def tokens(text: Column) -> Column:
    """Tokens by the default rule."""
    return RUNS.tokens(text)


def token_count(text: Column, tokenizer: Tokenizer = RUNS) -> Column:
    return tokenizer.count(text)


def bigrams(toks: Column) -> Column:
    """Neighbouring tokens joined by one blank (tokens hold none themselves)."""
    size = F.size(toks)
    return F.when(
        size > 1,
        F.zip_with(
            F.slice(toks, F.lit(1), size - 1),
            F.slice(toks, F.lit(2), size - 1),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))


def prompt_prefix(text: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + TEXT_MARKER), text)


def truncate_tokens(text: Column, budget: int, tokenizer: Tokenizer = RUNS) -> Column:
    """The text up to the end of its ``budget``-th token; shorter texts are unchanged."""
    return tokenizer.cut(text, budget)


def chat_messages(text: Column, budget: int = CHAT_BUDGET, tokenizer: Tokenizer = RUNS) -> Column:
    """One system message holding the instruction and the text, cut to ``budget`` tokens."""
    content = truncate_tokens(F.concat(F.lit(INSTRUCTION), text), budget, tokenizer)
    return F.array(F.struct(F.lit("system").alias("role"), content.alias("content")))


def reserve_suffix(ids: Column, suffix: Column) -> Column:
    """Overwrite the last slots of ``ids`` with ``suffix``; the length stays.

    Of a suffix longer than ``ids`` only the last slots fit.
    """
    size = F.size(ids)
    fitting = F.least(F.size(suffix), size)
    tail = F.slice(suffix, F.size(suffix) - fitting + 1, fitting)
    return F.concat(F.slice(ids, F.lit(1), size - fitting), tail)


def extract_answer(output: Column, marker: str = ANSWER_MARKER) -> Column:
    """The part between the first and the second marker, trimmed; null without one."""
    part = F.get(F.split(output, marker, 3), F.lit(1))
    return F.btrim(part, F.lit(_WHITESPACE))


def clip_strings(df: DataFrame, width: int = 10) -> DataFrame:
    """Every string column cut to its first ``width`` characters."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.substring(n, 1, width) for n in names})
