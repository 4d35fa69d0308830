from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.streaming import drafts

ROWS = [
    ("r1", 1, "meta", 0.0, ""), ("r1", 2, "token", 0.5, "a"), ("r1", 3, "token", 0.6, "b"), ("r2", 1, "token", 0.1, "z"),
    ("r1", 4, "reset", 0.7, ""), ("r1", 5, "token", 0.9, "c"), ("r1", 6, "done", 1.5, ""), ("r3", 1, "error", 0.2, ""),
]
SCHEMA = "request string, seq long, kind string, at double, text string"


def test_stream_equals_batch(spark, tmp_path):
    for i in range(0, len(ROWS), 3):
        spark.createDataFrame(ROWS[i : i + 3], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = drafts.live_drafts(stream, "request", "kind", "seq", "at", "text").writeStream.outputMode("update").format("memory").queryName("drafts").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    last = spark.sql("SELECT request, max_by(struct(drafts, tokens, text), (drafts, tokens)) AS x FROM drafts GROUP BY request")
    streamed = {r["request"]: tuple(r["x"]) for r in last.collect()}
    batch = ev.last_draft(spark.createDataFrame(ROWS, SCHEMA), "request", "kind", ["seq"], "reset", "token", F.col("text"))
    assert streamed == {r["request"]: (r["drafts"], r["tokens"], r["text"]) for r in batch.collect()}
    assert streamed["r1"] == (2, 1, "c")


def test_timings(spark):
    found = {r["request"]: r for r in ev.timings(spark.createDataFrame(ROWS, SCHEMA), "request", "kind", F.col("at"), ("token",), ("done", "error")).collect()}
    assert found["r1"]["ttft_ms"] == 500 and found["r1"]["total_ms"] == 1500 and found["r1"]["generation_ms"] == 1000 and found["r1"]["tokens_per_second"] == 3
    assert found["r3"]["ttft_ms"] is None and found["r3"]["tokens_per_second"] is None


def test_rates(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b")], "ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    found = drafts.event_rates(rows, "ts", "kind").collect()
    assert sorted((r["kind"], r["n"]) for r in found) == [("a", 2), ("b", 1)]
