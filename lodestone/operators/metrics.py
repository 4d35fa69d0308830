"""Retrieval metrics and reports: recall, hit rate, reciprocal rank, slices by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import ABLATION_RECALL_K, FAILURE_ROWS


def matched(results: DataFrame, gold: DataFrame, on: list[str], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Every answer of every question with the first position of a result that matches it, null if none does.

    ``results``: position, and the columns ``by`` and ``on``; ``gold``: answer_id, and the same.
    """
    first = results.groupBy(*by, *on).agg(F.min("position").alias("position"))
    return gold.join(first, [*by, *on], "left").groupBy(*by, "answer_id").agg(F.min("position").alias("position"))


def question_metrics(answers: DataFrame, cutoffs: tuple[int, ...], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per question (and whatever else ``by`` names): recall_k and hit_k for each cutoff, and rr."""
    total = F.countDistinct("answer_id")
    cols = []
    for k in cutoffs:
        found = F.countDistinct(F.when(F.col("position") <= k, F.col("answer_id")))
        cols += [(found / total).alias(f"recall_{k}"), F.coalesce(F.max(F.col("position") <= k), F.lit(False)).alias(f"hit_{k}")]
    return answers.groupBy(*by).agg(*cols, F.coalesce(1 / F.min("position"), F.lit(0.0)).alias("rr"))


def score_evidence(evidence: DataFrame, gold: DataFrame, on: list[str], k: int = ABLATION_RECALL_K) -> DataFrame:
    """query_id, recall, rr over all that a configuration's attempts retrieved, in the order of first sight.

    ``evidence``: query_id, ord and the columns ``on``, as ``agent.merge_evidence`` gives it.
    """
    found = matched(evidence.withColumnRenamed("ord", "position"), gold, on)
    return question_metrics(found, (k,)).select("query_id", F.col(f"recall_{k}").alias("recall"), "rr")


def score_table(outcomes: DataFrame, cutoffs: tuple[int, ...], retriever: str = "retriever") -> DataFrame:
    """Each retriever's mean recalls and reciprocal rank: per split over all, each style and each repository.

    ``outcomes``: one row a retriever and question, with split, style, repo, recall_k and rr.
    """
    sets = [[retriever, "split"], [retriever, "split", "style"], [retriever, "split", "repo"]]
    means = {f"recall_{k}": mean_or_zero(F.col(f"recall_{k}")) for k in cutoffs} | {"mrr": mean_or_zero(F.col("rr"))}
    return slice_report(outcomes, sets, {"questions": F.count("*")} | means)


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def slice_report(rows: DataFrame, sets: list[list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """The aggregates over several grouping sets in one pass; columns outside a set are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(*[a.alias(name) for name, a in aggregates.items()])


def failures(outcomes: DataFrame, rows: int = FAILURE_ROWS) -> DataFrame:
    """The worst outcomes: accuracy below 1 (null counts as 0), by accuracy, then high recall first."""
    accuracy = F.coalesce("accuracy", F.lit(0.0))
    return outcomes.filter(accuracy < 1).orderBy(accuracy.asc(), F.desc("recall"), F.asc("question_id")).limit(rows)


def best_config(outcomes: DataFrame) -> DataFrame:
    """The configuration with the highest mean accuracy, null as 0; the first of equals."""
    means = outcomes.groupBy("config", "ord").agg(F.coalesce(F.avg("accuracy"), F.lit(0.0)).alias("accuracy"))
    return means.orderBy(F.desc("accuracy"), F.asc("ord")).limit(1).select("config", "accuracy")


def stratified_head(rows: DataFrame, strata: list[str], order: str, limit: int, groups: int) -> DataFrame:
    """The first max(1, limit / groups) rows of each stratum, in table order."""
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= max(1, limit // groups))


def cell(value: Column, places: int = 3) -> Column:
    """A number of a report; null prints as n/a."""
    return F.when(value.isNull(), "n/a").otherwise(F.format_string(f"%.{places}f", value))


def markdown(rows: list, columns: list[str]) -> str:
    """A small aggregated result as a Markdown table."""
    head = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(head + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])
