"""Replay of answer streams: first token, drafts and resets, throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def timings(events: DataFrame, key: str, kind: str, seconds: Column, first_kinds: tuple[str, ...], end_kinds: tuple[str, ...]) -> DataFrame:
    """Per request: ttft_ms, total_ms, generation_ms (null before any token) and tokens (rows of the first kind)."""
    at = lambda kinds, f: f(F.when(F.col(kind).isin(*kinds), seconds))
    rows = events.groupBy(key).agg(
        F.min(seconds).alias("t0"),
        at(first_kinds, F.min).alias("t1"),
        at(end_kinds, F.max).alias("t2"),
        F.sum(F.col(kind).isin(*first_kinds).cast("int")).alias("tokens"),
    )
    ms = lambda a, b: F.bround((F.col(b) - F.col(a)) * 1000, 1)
    rows = rows.withColumns({"ttft_ms": ms("t0", "t1"), "total_ms": ms("t0", "t2"), "generation_ms": ms("t1", "t2")})
    rate = F.when((F.col("generation_ms") > 0) & (F.col("tokens") > 0), F.bround(F.col("tokens") / (F.col("generation_ms") / 1000), 1))
    return rows.select(key, "ttft_ms", "total_ms", "generation_ms", "tokens", rate.alias("tokens_per_second"))


def last_draft(events: DataFrame, key: str, kind: str, order: list[str], reset: str, token: str, payload: Column) -> DataFrame:
    """Per request the text of the tokens after its last reset, and the number of drafts."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("draft", F.sum((F.col(kind) == reset).cast("int")).over(run))
    rows = rows.withColumn("last", F.max("draft").over(Window.partitionBy(key)))
    text = F.array_sort(F.collect_list(F.when((F.col(kind) == token) & (F.col("draft") == F.col("last")), F.struct(*order, payload.alias("p")))))
    return rows.groupBy(key).agg((F.max("last") + 1).alias("drafts"), F.size(text).alias("tokens"), F.array_join(F.transform(text, lambda x: x["p"]), " ").alias("text"))


def error_status(kind: Column) -> Column:
    """HTTP status of an error class."""
    return F.when(kind.isin("missing_index", "missing_file"), 404).when(kind.isin("value", "clone"), 400).when(kind == "provider", 503).otherwise(500)


def valid_request(question: Column, k: Column, max_hunks: Column, repo: Column) -> Column:
    """The bounds of a request's fields; null fields are not given and pass."""
    within = lambda c, lo, hi: c.isNull() | c.between(lo, hi)
    return within(F.length(question), 1, 2000) & within(k, 1, 50) & within(max_hunks, 1, 200) & within(F.length(repo), 1, 500)
