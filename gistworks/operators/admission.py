"""Which (text, summary) pairs enter a corpus, and why the others do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gistworks.functions.tokenizer import RUNS, Tokenizer

REASONS = ("null", "empty", "too_short_ratio", "too_long_ratio", "verbatim", "below_min")


def admissible(text: Column, summary: Column, min_input_size: int = 0) -> Column:
    """2·|summary| < |text| < 1000·|summary|, summary not inside text, text long enough.

    Lengths are in characters; both bounds are strict, the minimum inclusive.
    """
    n_text, n_summary = F.length(text).cast("long"), F.length(summary).cast("long")
    return (
        (n_text > 2 * n_summary)
        & (n_text < 1000 * n_summary)
        & (n_text >= min_input_size)
        & ~F.contains(text, summary)
    )


def drop_reason(text: Column, summary: Column, min_input_size: int = 0) -> Column:
    """The first rule a pair breaks, null for an admitted pair."""
    n_text, n_summary = F.length(text).cast("long"), F.length(summary).cast("long")
    return (
        F.when(text.isNull() | summary.isNull(), "null")
        .when(n_summary == 0, "empty")
        .when(n_text <= 2 * n_summary, "too_short_ratio")
        .when(n_text >= 1000 * n_summary, "too_long_ratio")
        .when(F.contains(text, summary), "verbatim")
        .when(n_text < min_input_size, "below_min")
    )


def admit(df: DataFrame, min_input_size: int = 0) -> DataFrame:
    return df.where(admissible(F.col("text"), F.col("summary"), min_input_size))


def admission_audit(df: DataFrame, min_input_size: int = 0) -> DataFrame:
    """Rows in, kept and dropped per corpus and split, with the reason of each drop."""
    reason = drop_reason(F.col("text"), F.col("summary"), min_input_size)
    marked = df.select("dataset", "split", reason.alias("reason"))
    dropped = F.count("reason")
    return marked.groupBy("dataset", "split").agg(
        F.count(F.lit(1)).alias("rows_in"),
        dropped.alias("rows_dropped"),
        F.round(100 * dropped / F.count(F.lit(1)), 6).alias("percent_dropped"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS],
    )


def fits_context(df: DataFrame, context: int, shots: int | bool | None = False, tokenizer: Tokenizer = RUNS, text: Column | None = None) -> DataFrame:
    """Rows whose text and summary together stay strictly below ``context / shots`` tokens.

    Without a number of shots nothing is filtered. ``text`` is what is counted
    in place of the text column, such as its prompt.
    """
    if not shots:
        return df
    joined = F.concat(F.col("text") if text is None else text, "summary")
    return df.where(tokenizer.count(joined) < int(context / shots))
