from pyspark.sql import functions as F

from lodestone.operators import index_build as ib
from lodestone.operators import review


def test_embedding_cache_computes_each_text_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, text string").withColumn("key", ib.cache_key("m", F.col("text")))
    calls = []

    def embed(missing):
        calls.append(missing.count())
        return missing.withColumn("vector", F.array(F.length("text").cast("float")))

    empty = spark.createDataFrame([], "key string, vector array<float>")
    full, cache = ib.embed_with_cache(rows, empty, embed)
    assert full.count() == 3 and cache.count() == 2 and calls == [2]
    stats = ib.cache_stats(rows, cache).first()
    assert tuple(stats) == (3, 0, 3, 1.0)
    assert tuple(ib.cache_stats(rows, empty).first()) == (3, 2, 0, 0.0)
    assert tuple(ib.cache_stats(rows.limit(0), empty).first()) == (0, 0, 0, 0.0)


def test_rebuild_prunes_but_never_to_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("ghost", 2)], "id string, v int")
    new = spark.createDataFrame([("a", 3)], "id string, v int")
    assert [tuple(r) for r in ib.rebuild(old, new, "id").collect()] == [("a", 3)]
    assert ib.rebuild(old, new.limit(0), "id").count() == 2
    assert ib.stale(old, new, "id").count() == 1 and {tuple(r) for r in ib.upsert(old, new, "id").collect()} == {("a", 3), ("ghost", 2)}


def parse(spark, text):
    return review.parse_diff(spark.createDataFrame([(1, text)], "diff_id int, text string")).orderBy("seq")


def test_diff_traps(spark):
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\t2024\n+++ b/x.py\t2024\n@@ -1,2 +1,2 @@\n-old\n+new\n-- \n2.40\n+after the end\n"
    found = [(r["kind"], r["text"], r["old_line"], r["new_line"]) for r in parse(spark, diff).collect()]
    assert found == [("remove", "old", 1, None), ("add", "new", None, 1), ("remove", "- ", 2, None)]
    assert parse(spark, "no diff at all\n@@ -1 +1 @@\n+x").count() == 0
    plain = parse(spark, "diff --git a/only.py\n@@ -0,0 +5 @@\n+x\n").first()
    assert plain["path"] == "only.py" and plain["new_line"] == 5


def test_identifiers_and_search(spark):
    diff = "diff --git a/m/y.py b/m/y.py\n@@ -1 +1,3 @@ def head():\n-        entry.close = value\n+    if not self.entry:\n+    x\n"
    row = review.hunk_identifiers(parse(spark, diff)).first()
    assert row["names"] == ["entry", "close", "value"] and row["search"] == "entry close value"
    none = review.hunk_identifiers(parse(spark, "diff --git a/m/y.py b/m/y.py\n@@ -1 +1 @@\n+if\n")).first()
    assert none["search"] == "y"


def test_comment_order_and_dedupe(spark):
    rows = [(1, "b.py", 3, "note", "Same message"), (2, "b.py", 3, "note", "same MESSAGE"), (3, "a.py", 9, "blocker", "x"), (4, "a.py", 1, "warning", "y")]
    df = spark.createDataFrame(rows, "ord int, path string, line int, severity string, message string")
    kept = review.dedupe_comments(df, ["ord"])
    assert [r["ord"] for r in review.sort_comments(kept).collect()] == [3, 4, 1]
    assert tuple(review.severity_counts(kept).first()) == (1, 1, 0, 1)


def test_comments_of_one_line_are_ordered_by_message(spark):
    rows = [("b.py", 1, "blocker", f"m{i}") for i in range(50, 9, -1)] + [(None, 1, "blocker", "a"), ("b.py", None, "blocker", "a"), ("a.py", 1, None, "a")]
    df = spark.createDataFrame(rows, "path string, line int, severity string, message string").repartition(3)
    found = [(r["path"], r["line"], r["message"]) for r in review.sort_comments(df).collect()]
    assert found == [("b.py", 1, f"m{i}") for i in range(10, 51)] + [("b.py", None, "a"), (None, 1, "a"), ("a.py", 1, "a")]
