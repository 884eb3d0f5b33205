"""Names of runs: building them from their parts and taking them apart."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The known corpora, in the order a name is searched for them.
CORPORA = ("arxiv", "pubmed", "govreport", "bigpatent")
STAMP = "ddMMyyyyHHmmss"

_FOLDER = r"^(.+?)-(" + "|".join(CORPORA) + r")(?:-(\d+)-(\d{14}))?$"


def run_key(model: Column, dataset: Column, enc_max_len: Column) -> Column:
    return F.concat_ws("-", model, dataset, enc_max_len.cast("string"))


def hub_key(prefix: Column, enc_max_len: Column, dataset: Column) -> Column:
    return F.concat_ws("-", prefix, enc_max_len.cast("string"), dataset)


def run_folder(key: Column, started: Column) -> Column:
    return F.concat_ws("-", key, F.date_format(started, STAMP))


def strip_checkpoint(path: Column) -> Column:
    """``…/run/checkpoint-1600`` → ``…/run``."""
    return F.regexp_replace(path, "/[^/]*$", "")


def parse_folder(folder: Column) -> dict[str, Column]:
    """Model, corpus, length and start time of a run folder; absent parts are null."""

    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(folder, _FOLDER, i), F.lit(""))

    return {
        "model": part(1),
        "dataset": part(2),
        "enc_max_len": part(3).cast("long"),
        "started": F.try_to_timestamp(part(4), F.lit(STAMP)).cast("timestamp_ntz"),
    }


def route_corpus(folder: Column) -> Column:
    """arxiv if the name holds it, else pubmed if it holds that, else govreport."""
    return (
        F.when(folder.contains("arxiv"), "arxiv")
        .when(folder.contains("pubmed"), "pubmed")
        .otherwise("govreport")
    )
