"""Inputs derived from the stored tables: corpora, run logs, scores, vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gistworks.sources.corpus import CorpusSpec


class Views:
    """Lazily built frames over the tables in one folder.

    The planted cases: an empty summary, a summary equal to the text, a
    summary found word for word in the text, failed and retried generations,
    and runs with gaps.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def pairs(self) -> DataFrame:
        """id, dataset, split, text, summary, prediction; both spread over the whole text.

        A summary is every third word, a prediction two of every five.
        """
        key, words = F.col("doc_id"), F.col("w")

        def every(step: int, kept: tuple[int, ...]) -> Column:
            return F.array_join(F.filter(words, lambda _, i: (i % step).isin(*kept)), " ")

        names = F.array(*[F.lit(n) for n in ("arxiv", "pubmed", "govreport", "bigpatent")])
        return (
            self.table("documents")
            .select("doc_id", "text", F.split("text", " ").alias("w"))
            .select(
                key.alias("id"),
                F.element_at(names, (key % 4 + 1).cast("int")).alias("dataset"),
                F.when(key % 10 == 0, "test").when(key % 10 == 1, "validation").otherwise("train").alias("split"),
                "text",
                F.when(key % 17 == 0, "")
                .when(key % 13 == 0, F.col("text"))
                .when(key % 11 == 0, F.substring_index("text", "\n", -1))
                .otherwise(every(3, (0,)))
                .alias("summary"),
                every(5, (0, 3)).alias("prediction"),
            )
        )

    def corpora(self) -> DataFrame:
        """The pairs with ids counted anew in each corpus, so that corpora share ids."""
        return self.pairs().withColumn("id", F.expr("id div 4"))

    def raw_reader(self) -> Callable[[CorpusSpec], DataFrame]:
        """Each corpus under its own column names, as its source stores it."""

        def read(spec: CorpusSpec) -> DataFrame:
            corpus = self.pairs().where(F.col("dataset") == spec.name).drop("dataset", "prediction")
            return corpus.withColumnsRenamed({ours: theirs for theirs, ours in spec.columns.items()})

        return read

    def attempts(self) -> DataFrame:
        """id, attempt, ok, output: every fifth first attempt fails, then every fifth retry."""
        pairs = self.pairs()

        def tried(number: int, fails_every: int, output: Column) -> list[Column]:
            ok = F.col("id") % fails_every != 0
            return ["id", F.lit(number).alias("attempt"), ok.alias("ok"), F.when(ok, output).alias("output")]

        first = pairs.select(*tried(1, 5, F.col("prediction")))
        second = pairs.where(F.col("id") % 5 == 0).select(
            *tried(2, 25, F.concat(F.lit("retry "), F.col("prediction")))
        )
        return first.unionByName(second)

    def run_predictions(self) -> DataFrame:
        """run_id, id, prediction of three models; one has gaps, one repeats the summary. One scan."""

        def run(prefix: str, suffix: str, prediction: Column) -> Column:
            name = F.concat(F.lit(prefix), "dataset", F.lit(suffix))
            return F.struct(name.alias("run_id"), "id", prediction.alias("prediction"))

        answer, summary = F.col("prediction"), F.col("summary")
        skipped = F.when(F.col("id") % 9 != 0, run("skip-", "-4096-15062023193353", F.reverse(answer)))
        runs = F.array_compact(F.array(run("lead-3.5-turbo-", "", answer), skipped, run("echo-", "", summary)))
        return self.pairs().select(F.inline(runs))

    def run_scores(self) -> DataFrame:
        """folder, json: one score file per source, even ones nested, odd ones flat."""
        n = F.regexp_extract("source", "[0-9]+", 0).cast("long")
        factors = {"rouge1": 7, "rouge2": 3, "rougeL": 5, "rougeLsum": 6}
        entries = [F.format_string(f'"{v}": 0.%d', 100 + F.col("n") * f % 800) for v, f in factors.items()]
        flat = F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))
        names = F.array(*[F.lit(c) for c in ("arxiv", "pubmed", "govreport")])
        even = F.col("n") % 2 == 0
        return (
            self.table("documents")
            .select("source")
            .distinct()
            .withColumn("n", n)
            .select(
                F.concat(
                    "source",
                    F.lit("-"),
                    F.element_at(names, (F.col("n") % 3 + 1).cast("int")),
                    F.when(even, "-4096-15062023193353").otherwise(""),
                ).alias("folder"),
                F.when(even, F.concat(F.lit('{"rouge": '), flat, F.lit("}"))).otherwise(flat).alias("json"),
            )
        )

    def pred_logs(self) -> DataFrame:
        """folder, content: ten predictions per log, every fourth log a JSON list."""
        group = F.expr("id div 10").alias("g")
        plain = F.regexp_replace("prediction", "[^a-zA-Z0-9 ]", "").alias("p")
        names = F.array(*[F.lit(c) for c in ("arxiv", "pubmed", "govreport")])
        lines = F.transform(F.array_sort(F.collect_list(F.struct("id", "p"))), lambda x: x["p"])
        return (
            self.pairs()
            .select(group, "id", plain)
            .groupBy("g")
            .agg(lines.alias("l"))
            .select(
                F.concat(
                    F.lit("run"),
                    F.col("g").cast("string"),
                    F.lit("-"),
                    F.element_at(names, (F.col("g") % 3 + 1).cast("int")),
                ).alias("folder"),
                F.when(F.col("g") % 4 == 0, F.concat(F.lit('["'), F.array_join("l", '", "'), F.lit('"]')))
                .otherwise(F.concat(F.array_join("l", "\n"), F.lit("\n")))
                .alias("content"),
            )
        )

    def eval_log(self) -> DataFrame:
        """run_id, step, eval_rouge1; a few runs tie for their best step."""
        return self.table("events").select(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("step"),
            (F.floor("value") / 1000).alias("eval_rouge1"),
        )

    def token_vectors(self) -> DataFrame:
        """pair_id, side, pos, v: ten tokens on each side of a pair."""
        return self.table("embeddings").select(
            F.expr("vec_id div 20").alias("pair_id"),
            (F.col("vec_id") % 2).cast("int").alias("side"),
            F.col("vec_id").alias("pos"),
            F.col("embedding").cast("array<double>").alias("v"),
        )

    def references(self) -> DataFrame:
        return self.pairs().select("id", "summary")


