"""Queries: diffs, hunks, identifiers, model replies, comments."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import review
from lodestone.plans.registry import register, table

DIFF = """commit message first
 stat | 2 +-
diff --git a/src/ledger.py b/src/ledger.py
index 1..2 100644
--- a/src/ledger.py
+++ b/src/ledger.py
@@ -10,6 +10,7 @@ class Ledger:
     def post(self, entry):
         self.rows.append(entry)

-        return entry.value
+        total = entry.value
+        return total

     def close(self):
@@ -48,3 +49,4 @@
 tail
 more
+appended = 1
\\ No newline at end of file
diff --git a/old.txt b/old.txt
deleted file mode 100644
--- a/old.txt
+++ /dev/null
@@ -1 +0,0 @@
-gone
diff --git a/new.md b/new.md
new file mode 100644
--- /dev/null
+++ b/new.md
@@ -0,0 +1,2 @@
+hello
+world
diff --git a/img.png b/img.png
Binary files a/img.png and b/img.png differ
diff --git a/was.py b/now.py
rename from was.py
rename to now.py
@@ -3 +3 @@ heading only
-not if
+not in
--
2.39.0
"""
# The parse of DIFF, line by line: hunk, kind, old line, new line.
DIFF_LINES = [
    (1, "context", 10, 10), (1, "context", 11, 11), (1, "context", 12, 12), (1, "remove", 13, None), (1, "add", None, 13), (1, "add", None, 14),
    (1, "context", 14, 15), (1, "context", 15, 16), (2, "context", 48, 49), (2, "context", 49, 50), (2, "add", None, 51), (3, "remove", 1, None),
    (4, "add", None, 1), (4, "add", None, 2), (5, "remove", 3, None), (5, "add", None, 3), (5, "remove", 4, None),
]


def values(rows) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def parsed(spark):
    return review.parse_diff(spark.createDataFrame([(1, DIFF)], "diff_id int, text string"))


@register("diff_parse", f"SELECT hunk::INT AS hunk_no, kind, coalesce(old, -1)::INT AS old_line, coalesce(new, -1)::INT AS new_line FROM ({values(DIFF_LINES)}) t(hunk, kind, old, new)")
def diff_parse(spark, d):
    side = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return parsed(spark).select("hunk_no", "kind", side("old_line"), side("new_line"))


HUNKS = [(1, "src/ledger.py", 10, 16, 13, 2, 1), (2, "src/ledger.py", 49, 51, 51, 1, 0), (4, "new.md", 1, 2, 1, 2, 0), (5, "now.py", 3, 3, 3, 1, 2)]


@register("hunk_ranges", f"SELECT hunk::INT AS hunk_no, path, low, high, anchor, added::BIGINT AS added, removed::BIGINT AS removed FROM ({values(HUNKS)}) t(hunk, path, low, high, anchor, added, removed)")
def hunk_ranges(spark, d):
    return review.hunk_ranges(review.reviewable(parsed(spark))).drop("diff_id")


SEARCHES = [(1, "total,entry,value", "total entry value"), (2, "appended", "appended"), (4, "hello,world", "hello world"), (5, "", "heading only")]


@register("hunk_identifiers", f"SELECT hunk::INT AS hunk_no, names, search FROM ({values(SEARCHES)}) t(hunk, names, search)")
def hunk_identifiers(spark, d):
    found = review.hunk_identifiers(review.reviewable(parsed(spark)))
    return found.select("hunk_no", F.array_join("names", ",").alias("names"), "search")


@register(
    "document_diff",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)
SELECT doc_id, n::INT AS new_line, md5(line) AS line_md5 FROM l WHERE n <= (SELECT max(n) FROM l m WHERE m.doc_id = l.doc_id)""",
)
def document_diff(spark, d):
    """Each document as a diff that adds all its lines; the parse gives them back."""
    docs = table(spark, d, "documents")
    n = F.size(F.split("text", "\n", -1))
    head = F.format_string("diff --git a/d b/d%d.txt\n--- /dev/null\n+++ b/d%d.txt\n@@ -0,0 +1,%d @@\n+", F.col("doc_id"), F.col("doc_id"), n)
    diffs = docs.select("doc_id", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n+"))).alias("text"))
    found = review.parse_diff(diffs, "doc_id")
    return found.select("doc_id", "new_line", F.md5("text").alias("line_md5"))


REPLIES = [
    (1, '[{"line": 12, "severity": "Blocker", "message": "wrong sign"}, {"line": 900, "severity": "warning", "message": "far away"}]'),
    (2, 'Sure:\n```json\n[{"line": "14", "severity": "nitpick", "message": "name"}, {"severity": "note", "message": "no line"}, {"line": 15, "severity": "note", "message": " "}]\n```\nbye'),
    (3, "I see no problem."),
    (4, "[]"),
    (5, 'text [{"line": 12, "severity": "blocker", "message": "WRONG sign"}] more'),
]
COMMENTS = [
    (1, 0, 12, "blocker", "wrong sign", ""), (1, 1, 13, "warning", "far away", "line outside the hunk"), (2, 0, 14, "note", "name", "unknown severity"),
    (2, 1, 13, "note", "no line", ""), (5, 0, 12, "blocker", "WRONG sign", ""),
]


def comments(spark):
    rows = spark.createDataFrame(REPLIES, "reply_id int, text string")
    rows = rows.withColumns({"path": F.lit("src/ledger.py"), "low": F.lit(10), "high": F.lit(20), "anchor": F.lit(13)})
    return review.parse_comments(rows, ["reply_id"])


@register("comment_parse", f"SELECT * FROM ({values(COMMENTS)}) t(reply_id, ord, line, severity, message, problem)")
def comment_parse(spark, d):
    return comments(spark).drop("path")


@register("comment_dedupe", f"SELECT reply_id, line, severity, message FROM ({values(COMMENTS)}) t(reply_id, ord, line, severity, message, problem) WHERE reply_id < 5")
def comment_dedupe(spark, d):
    return review.dedupe_comments(comments(spark), ["reply_id", "ord"]).select("reply_id", "line", "severity", "message")


@register("severity_counts", "SELECT 1::BIGINT AS blocker, 1::BIGINT AS warning, 0::BIGINT AS suggestion, 2::BIGINT AS note")
def severity_counts(spark, d):
    return review.severity_counts(review.dedupe_comments(comments(spark), ["reply_id", "ord"]))


@register("unreadable_replies", "SELECT 3 AS reply_id")
def unreadable_replies(spark, d):
    return review.unreadable_replies(spark.createDataFrame(REPLIES, "reply_id int, text string"), ["reply_id"])
