"""Queries: answer streams replayed from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.plans.registry import register, table


def stream(spark, d):
    return table(spark, d, "events")


@register(
    "ttft_metrics",
    """WITH s AS (SELECT user_id, event_type, epoch_us(ts)::DOUBLE / 1000000 AS sec FROM events),
t AS (SELECT user_id, min(sec) AS t0, min(CASE WHEN event_type = 'click' THEN sec END) AS t1, max(CASE WHEN event_type IN ('purchase', 'error') THEN sec END) AS t2,
  count(CASE WHEN event_type = 'click' THEN 1 END) AS tokens FROM s GROUP BY user_id),
m AS (SELECT user_id, round_even((t1 - t0) * 1000, 1) AS ttft_ms, round_even((t2 - t0) * 1000, 1) AS total_ms, round_even((t2 - t1) * 1000, 1) AS generation_ms, tokens FROM t)
SELECT *, CASE WHEN generation_ms > 0 AND tokens > 0 THEN round_even(tokens / (generation_ms / 1000), 1) END AS tokens_per_second FROM m""",
)
def ttft_metrics(spark, d):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    return ev.timings(stream(spark, d), "user_id", "event_type", seconds, ("click",), ("purchase", "error"))


@register(
    "last_draft_after_reset",
    """WITH r AS (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS draft FROM events),
m AS (SELECT *, max(draft) OVER (PARTITION BY user_id) AS last_ FROM r)
SELECT user_id, (max(last_) + 1)::BIGINT AS drafts, count(CASE WHEN event_type = 'click' AND draft = last_ THEN 1 END)::INT AS tokens,
  coalesce(string_agg(CASE WHEN event_type = 'click' AND draft = last_ THEN event_id::VARCHAR END, ' ' ORDER BY ts, event_id), '') AS text FROM m GROUP BY user_id""",
)
def last_draft_after_reset(spark, d):
    found = ev.last_draft(stream(spark, d), "user_id", "event_type", ["ts", "event_id"], "signup", "click", F.col("event_id").cast("string"))
    return found


ERRORS = ["missing_index", "missing_file", "value", "clone", "provider", "other"]


@register("error_status", "SELECT * FROM (VALUES ('missing_index', 404), ('missing_file', 404), ('value', 400), ('clone', 400), ('provider', 503), ('other', 500)) t(kind, status)")
def error_status(spark, d):
    return spark.createDataFrame([(e,) for e in ERRORS], "kind string").select("kind", ev.error_status(F.col("kind")).alias("status"))


@register(
    "valid_requests",
    """SELECT doc_id, length(text) BETWEEN 1 AND 2000 AND doc_id % 60 BETWEEN 1 AND 50 AND doc_id % 250 BETWEEN 1 AND 200 AS valid FROM documents""",
)
def valid_requests(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", ev.valid_request(F.col("text"), i % 60, i % 250, F.lit(None).cast("string")).alias("valid"))
