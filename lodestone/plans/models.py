"""Queries around models, with scripted providers: plain answers, verdicts, streamed replies, reviews, prior outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import providers, review, review_run
from lodestone.operators.bm25 import ranked
from lodestone.plans.registry import register, table
from lodestone.plans.reviews import DIFF

VERDICTS = [(1, "VERDICT: correct"), (2, "Reason: x\nverdict: Incorrect, because"), (3, "no verdict"), (4, "VERDICT:"), (5, "VERDICT: incorrect\nVERDICT: correct")]


@register("judge_verdicts", "SELECT * FROM (VALUES (1, 'correct', 1.0::DOUBLE), (2, 'partial', 0.5::DOUBLE), (3, 'partial', 0.5::DOUBLE), (4, 'partial', 0.5::DOUBLE), (5, 'incorrect', 0.0::DOUBLE)) t(id, verdict, score)")
def judge_verdicts(spark, d):
    rows = spark.createDataFrame(VERDICTS, "id int, reply string").withColumn("verdict", providers.parse_verdict(F.col("reply")))
    return rows.select("id", "verdict", providers.verdict_score(F.col("verdict")).alias("score"))


STREAMS = [
    (1, ': keep-alive\n\ndata: {"choices":[{"delta":{"content":"Hel"}}]}\n\ndata: not json\ndata: {"choices":[{"delta":{"content":"lo"}}],"usage":{"completion_tokens":7}}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}'),
    (2, 'data: {"choices":[]}\r\ndata: {"choices":[{"delta":{}}]}\r\ndata:{"choices":[{"delta":{"content":"x"}}]}'),
]


@register("stream_replies", "SELECT * FROM (VALUES (1, 'Hello', 7), (2, 'x', 0)) t(id, text, output_tokens)")
def stream_replies(spark, d):
    return providers.stream_text(spark.createDataFrame(STREAMS, "id int, body string"), "id", "body").fillna(0, ["output_tokens"])


@register(
    "plain_answers",
    """WITH r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT lang, 'Question: what is ' || lang || '?' AS answer, least(count(*), 8) AS excerpts FROM r GROUP BY lang
UNION ALL SELECT 'xx', 'Nothing in the index answers that question.', 0""",
)
def plain_answers(spark, d):
    docs = table(spark, d, "documents").withColumn("query_id", F.col("lang"))
    name = F.col("doc_id").cast("string")
    rows = ranked(docs, 8, F.desc("n_chars"), F.asc("doc_id")).select(
        "lang", "rank", F.concat(F.lit("src/doc"), name, F.lit(".md:1-9")).alias("place"), F.lit("doc").alias("kind"), name.alias("symbol"), F.col("lang").alias("language"), F.col("text").alias("code")
    )
    asked = docs.select("lang").distinct().union(spark.createDataFrame([("xx",)], "lang string"))
    asked = asked.withColumn("question", F.concat(F.lit("what is "), F.col("lang"), F.lit("?")))
    return providers.answer_questions(asked, rows, providers.get_provider("echo"), key="lang")


@register(
    "prior_outcomes",
    "SELECT l.doc_id AS question_id, c AS config FROM labels l, (VALUES ('vector'), ('hybrid')) t(c) WHERE NOT (c = 'vector' AND l.toxic = 1)",
)
def prior_outcomes(spark, d):
    """Work left of two configurations where one has outcomes for some questions."""
    labels = table(spark, d, "labels")
    configs = spark.createDataFrame([("vector",), ("hybrid",)], "config string")
    work = labels.select(F.col("doc_id").alias("question_id")).join(F.broadcast(configs))
    prior = labels.filter("toxic = 1").select(F.col("doc_id").alias("question_id"), F.lit("vector").alias("config"))
    return providers.pending(work, prior, ["question_id", "config"])


REPLY = '[{"line": 13, "severity": "warning", "message": "check the sign"}, {"line": 13, "severity": "note", "message": "Check the SIGN"}, {"severity": "note", "message": "hm"}]'


@register(
    "review_comments",
    "SELECT * FROM (VALUES (1, 'src/ledger.py', 13, 'warning', 'check the sign'), (1, 'src/ledger.py', 13, 'note', 'hm')) t(hunk_no, path, line, severity, message)",
)
def review_comments(spark, d):
    """A diff reviewed by a scripted model that comments on one hunk; the duplicate goes."""
    lines = review.parse_diff(spark.createDataFrame([(1, DIFF)], "diff_id int, text string"))
    model = providers.get_provider("scripted", {"total = entry.value": REPLY}, "[]")
    comments, _ = review_run.review_diffs(lines, model)
    return comments.select("hunk_no", "path", "line", "severity", "message")


@register("hunk_context", "SELECT * FROM (VALUES (1, 7, true, ''), (2, 0, false, 'no file context; no related code')) t(hunk_no, chars, related, notes)")
def hunk_context(spark, d):
    hunks = spark.createDataFrame([(1, 1, "a.py", 60, 61), (1, 2, "gone.py", 1, 2)], "diff_id int, hunk_no int, path string, low int, high int")
    files = spark.createDataFrame([("a.py", 19, "out"), ("a.py", 20, "in"), ("a.py", 101, "last"), ("a.py", 102, "out")], "path string, line_no int, line string")
    related = spark.createDataFrame([(1, 1, "a.py", 1, "own"), (1, 1, "b.py", 2, "other"), (1, 2, "gone.py", 1, "own"), (1, 1, "c.py", 5, "late")], "diff_id int, hunk_no int, path string, rank int, block string")
    found = review_run.gather(hunks, files, related)
    return found.select("hunk_no", F.coalesce(F.length("surrounding"), F.lit(0)).alias("chars"), (F.col("related") == "other").eqNullSafe(True).alias("related"), "notes")
