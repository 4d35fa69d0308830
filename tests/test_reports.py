import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import prompts, reports, review, review_run

OUTCOME = "model string, fingerprint string, config string, question_id string, kind string, style string, recall double, rr double, accuracy double, verdict string, grounded boolean, seconds double"


def outcomes(spark):
    rows = [("m:1/x", "f", "vector", "q1", "factual", "lexical", 0.5, 1.0, None, "", None, 2.0), ("m:1/x", "f", "agent", "q1", "factual", "lexical", 1.0, 1.0, 0.5, "partial", False, 3.0)]
    return spark.createDataFrame(rows, OUTCOME)


def test_outcomes_are_kept_in_folders(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert reports.load_outcomes(spark, path, OUTCOME).count() == 0
    reports.save_outcomes(outcomes(spark), path)
    reports.save_outcomes(outcomes(spark).filter("config = 'agent'"), path)
    assert (tmp_path / "runs" / "model=m-1-x" / "fingerprint=f" / "config=agent").is_dir()
    found = reports.load_outcomes(spark, path, OUTCOME)
    assert found.count() == 3 and {r["config"] for r in found.collect()} == {"vector", "agent"}
    next((tmp_path / "runs").rglob("*.json")).write_text("no json")
    assert reports.load_outcomes(spark, path, OUTCOME).filter("question_id IS NOT NULL").count() < 3


def test_ablation_report(spark):
    text = reports.ablation_report(outcomes(spark))
    assert "| vector only | 0.500 | 1.000 | n/a | 2s |" in text and "| agent + reflection | 1.000 | 1.000 | 0.500 | 3s |" in text
    assert "| q1 | factual | lexical | 1.00 | partial | no |" in text
    assert "no answering configurations" in reports.ablation_report(outcomes(spark).filter("config = 'vector'"))


def test_review_document(spark):
    rows = [(1, "b.py", 2, "note", "n"), (1, "a.py", 9, "blocker", "x"), (1, "a.py", 3, "blocker", "y")]
    comments = spark.createDataFrame(rows, "diff_id int, path string, line int, severity string, message string")
    totals = spark.createDataFrame([(1, 2, 5, "m", ["z: binary"]), (2, 0, 0, "m", [])], "diff_id int, files int, hunks int, model string, skipped array<string>")
    found = {r["diff_id"]: json.loads(r["review"]) for r in reports.review_summary(comments, totals).collect()}
    assert [c["message"] for c in found[1]["comments"]] == ["y", "x", "n"]
    assert found[1]["summary"] == {"files": 2, "hunks": 5, "comments": 3, "by_severity": {"blocker": 2, "warning": 0, "suggestion": 0, "note": 1}, "model": "m"}
    assert found[2]["comments"] == [] and found[2]["summary"]["by_severity"]["note"] == 0
    with pytest.raises(ValueError):
        reports.at_least(comments, "awful")
    assert reports.blocking(comments).count() == 2


def test_diff_files(spark, tmp_path):
    (tmp_path / "a.diff").write_text("diff --git a/was.py b/now.py\nrename from was.py\nrename to now.py\n@@ -3 +3 @@\n-a\n+b\ndiff --git a/i.png b/i.png\nBinary files differ\n@@ -1 +1 @@\n+x\n")
    lines = review.parse_diff(review.read_diffs(spark, str(tmp_path / "a.diff")))
    first = lines.filter("hunk_no = 1").select(review.is_rename(*[F.col(c) for c in ("path", "old_path", "is_new", "is_deleted")]).alias("r")).first()
    assert first["r"] and [r["text"] for r in review.skipped_files(lines).collect()] == ["i.png: binary"]
    (tmp_path / "b.diff").write_text("\n")
    with pytest.raises(ValueError, match="no diff"):
        review.read_diffs(spark, str(tmp_path / "b.diff"))


def test_evidence_of_a_hunk(spark):
    row = spark.range(1).select(review_run.evidence_text(F.lit("a.py"), F.lit("+x"), F.lit(None).cast("string"), F.lit("b.py:1-2")).alias("t")).first()["t"]
    assert row.startswith("### Change to a.py\n\n+x") and "around" not in row and row.endswith("b.py:1-2")


def test_turns(spark):
    note = prompts.retry_note(F.lit("fabricated"), F.lit("not there"))
    row = spark.range(1).select(
        prompts.question_turn(F.lit("why?"), F.lit("[1] x"), F.lit(1), note).alias("q"), prompts.retry_note(F.lit(""), F.lit(None)).alias("none"),
        prompts.retry_note(F.lit("no_citations"), F.lit("r")).alias("cite"), prompts.critic_turn(F.lit("q"), F.lit("a"), F.lit("c")).alias("c"),
        reports.test_summary(F.lit("pytest"), F.lit("Python"), F.lit(1), F.lit(False), F.repeat(F.lit("y"), 3000)).alias("t"),
        reports.comment_line(F.lit("note"), F.lit("a.py"), F.lit(3), F.lit("m")).alias("l"),
    ).first()
    assert row["q"].startswith("1 excerpts") and "not there" in row["q"] and row["q"].endswith("Question: why?")
    assert row["none"] == "" and row["cite"] == prompts.CITE_NOTE and row["c"].endswith("Answer to check:\n\na")
    assert row["t"] == "$ pytest\n[Python] failed\n" + "y" * 2000 and row["l"] == "NOTE       a.py:3  m"


def test_answer_rows(spark):
    answers = spark.createDataFrame([(1, "q", "a", True, 2), (2, "q", "b", False, 1)], "query_id int, question string, answer string, grounded boolean, attempts int")
    found = spark.createDataFrame([(1, "a.py", 1, 9, "f", "function", "Python", 0.123456, 2), (1, "b.py", 1, 2, "g", "function", "Python", 0.9, 1)], "query_id int, file_path string, start_line int, end_line int, symbol string, kind string, language string, score double, rank int")
    rows = {r["query_id"]: r for r in reports.answer_rows(answers, reports.source_rows(found, "query_id"), "query_id", "agent").collect()}
    assert [s["location"] for s in rows[1]["sources"]] == ["b.py:1-2", "a.py:1-9"] and rows[1]["sources"][1]["score"] == 0.1235 and rows[2]["sources"] is None
    plain = reports.answer_rows(answers, reports.source_rows(found, "query_id"), "query_id", "plain").first()
    assert plain["grounded"] is None and plain["attempts"] == 1


def test_related_code_of_hunks(spark):
    from lodestone.operators import bm25, retrieval

    chunks = spark.createDataFrame([("c1", "b.py", 1, 2, "function", "total_value", "def total_value(): pass"), ("c2", "c.py", 1, 2, "function", "other", "def other(): pass")], "chunk_id string, file_path string, start_line int, end_line int, kind string, symbol string, code string")
    docs = chunks.select(F.col("chunk_id").alias("id"), F.col("code").alias("text"))
    index = retrieval.Index(bm25.build_index(docs, "id", "text"), docs.select("id", F.array(F.lit(1.0)).alias("vector")), docs)
    hunks = spark.createDataFrame([(1, 1, "total_value")], "diff_id int, hunk_no int, search string")
    found = review_run.related_code(index, hunks, chunks, lambda rows: rows.withColumn("vector", F.array(F.lit(1.0)))).orderBy("rank").collect()
    assert found[0]["path"] == "b.py" and found[0]["block"].startswith("b.py:1-2  function total_value\n```\ndef total_value")
