"""Weighted reciprocal-rank fusion of rankings, and rank provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import FINAL_TOP_K, RRF_K
from lodestone.operators.bm25 import ranked


def fuse(rankings: DataFrame, k: int = RRF_K, top_k: int = FINAL_TOP_K) -> DataFrame:
    """Rows (query_id, retriever, id, rank[, weight]) to query_id, id, score, rank, contributions.

    Every retriever gives weight / (k + rank); weight 0 takes it out, a missing weight is 1.
    All rankings meet in one aggregation instead of full outer joins.
    """
    if "weight" not in rankings.columns:
        rankings = rankings.withColumn("weight", F.lit(1.0))
    used = rankings.withColumn("weight", F.coalesce("weight", F.lit(1.0))).filter("weight <> 0")
    scored = used.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("contributions"),
    )
    return ranked(scored, top_k, F.desc("score"), F.asc(F.col("id").cast("string")))


def explain(contributions: Column) -> Column:
    """``bm25 #1 + vector #2``: the retrievers that gave a row, by name."""
    parts = F.transform(F.array_sort(F.map_entries(contributions)), lambda e: F.format_string("%s #%d", e["key"], e["value"]))
    return F.coalesce(F.nullif(F.array_join(parts, " + "), F.lit("")), F.lit("-"))


def arithmetic(contributions: Column, k: int = RRF_K) -> Column:
    """``1/(10+1) [bm25 #1] + 1/(10+2) [vector #2]``: a fused score term by term."""
    parts = F.transform(F.array_sort(F.map_entries(contributions)), lambda e: F.format_string(f"1/({k}+%d) [%s #%d]", e["value"], e["key"], e["value"]))
    return F.array_join(parts, " + ")
