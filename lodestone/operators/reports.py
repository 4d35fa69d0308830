"""Sinks and listings: outcomes, ablation reports, reviews, answers, sources, test logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import SEVERITIES
from lodestone.functions.text import location
from lodestone.operators.metrics import cell, failures, markdown
from lodestone.operators.review import severity_rank

# ------------------------------------------------------------------ outcomes

# What reports call the configurations.
LABELS = {"vector": "vector only", "hybrid": "hybrid (RRF)", "rag": "agent, no reflection", "agent": "agent + reflection"}
BREAKDOWN = [("factual", "kind"), ("explanatory", "kind"), ("semantic", "style"), ("lexical", "style")]


def folder_name(model: Column) -> Column:
    """A model's name as a folder."""
    return F.translate(model, ":/", "--")


def save_outcomes(outcomes: DataFrame, path: str) -> None:
    """JSON lines in a folder for each model, fingerprint and configuration; earlier ones stay."""
    rows = outcomes.withColumn("model", folder_name(F.col("model")))
    rows.write.mode("append").partitionBy("model", "fingerprint", "config").json(path)


def load_outcomes(spark, path: str, schema: str) -> DataFrame:
    """Saved outcomes; missing folders and lines that are no JSON count as none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def outcome_cells(outcomes: DataFrame) -> DataFrame:
    """One row a configuration: means and sums of the headline table, and the breakdown, as cells."""
    split = [cell(F.avg(F.when(F.col(c) == v, F.col(m)))).alias(f"{v}_{m}") for m in ("recall", "accuracy") for v, c in BREAKDOWN]
    return outcomes.groupBy("config").agg(
        cell(F.avg("recall")).alias("recall"), cell(F.avg("rr")).alias("mrr"), cell(F.avg("accuracy")).alias("accuracy"),
        F.format_string("%.0fs", F.sum("seconds")).alias("seconds"), *split,
    )


def ablation_report(outcomes: DataFrame) -> str:
    """The Markdown report of a run: headline, breakdown, failures of the best answering configuration."""
    rows = sorted(outcome_cells(outcomes).collect(), key=lambda r: list(LABELS).index(r["config"]) if r["config"] in LABELS else len(LABELS))
    named = [r.asDict() | {"config": LABELS.get(r["config"], r["config"])} for r in rows]
    parts = ["## Ablation", markdown(named, ["config", "recall", "mrr", "accuracy", "seconds"]), "### By question kind and style"]
    parts += [markdown(named, ["config", *[f"{v}_{m}" for v, _ in BREAKDOWN]]) for m in ("recall", "accuracy")]
    answering = outcomes.filter("accuracy IS NOT NULL").groupBy("config").agg(F.avg("accuracy").alias("accuracy")).orderBy(F.desc("accuracy"), "config").first()
    parts.append("### Where the failures cluster")
    if answering is None:
        return "\n\n".join([*parts, "_no answering configurations were run_"])
    grounded = F.when(F.col("grounded").isNull(), "n/a").when(F.col("grounded"), "yes").otherwise("no").alias("grounded")
    bad = failures(outcomes.filter(F.col("config") == answering["config"])).select("question_id", "kind", "style", F.format_string("%.2f", "recall").alias("recall"), "verdict", grounded)
    return "\n\n".join([*parts, markdown(bad.collect(), bad.columns)])


# ------------------------------------------------------------------ reviews


def at_least(comments: DataFrame, severity: str) -> DataFrame:
    """Comments of this severity or a worse one."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity {severity!r} is none of {', '.join(SEVERITIES)}")
    return comments.filter(severity_rank(F.col("severity")) <= SEVERITIES.index(severity) + 1)


def blocking(comments: DataFrame) -> DataFrame:
    return at_least(comments, "blocker")


def comment_line(severity: Column, path: Column, line: Column, message: Column) -> Column:
    """A comment as one line of text."""
    return F.concat(F.rpad(F.upper(severity), 10, " "), F.lit(" "), path, F.lit(":"), line.cast("string"), F.lit("  "), message)


def review_line(comments: DataFrame, totals: DataFrame, key: str = "diff_id") -> DataFrame:
    """key, text: a review in one line; ``totals``: key, files, hunks."""
    counts = [F.sum((F.col("severity") == s).cast("int")).alias(s) for s in SEVERITIES]
    rows = totals.join(comments.groupBy(key).agg(F.count("*").alias("n"), *counts), key, "left")
    named = F.concat_ws(", ", *[F.when(F.col(s) > 0, F.format_string(f"%d {s}", s)) for s in SEVERITIES])
    named = F.coalesce(F.nullif(named, F.lit("")), F.lit("none"))
    return rows.select(key, F.format_string("%d comments (%s) over %d hunks in %d files", F.coalesce("n", F.lit(0)), named, "hunks", "files").alias("text"))


def review_summary(comments: DataFrame, totals: DataFrame, key: str = "diff_id") -> DataFrame:
    """key, and the review as JSON: summary, what was skipped, comments from the worst on.

    ``totals``: key, files, hunks, model, skipped (array of texts).
    """
    counts = {s: F.sum((F.col("severity") == s).cast("int")) for s in SEVERITIES}
    one = F.struct(F.col("path").alias("file"), "line", "severity", "message")
    listed = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("r"), "path", "line", one.alias("c"))))
    rows = comments.groupBy(key).agg(
        F.transform(listed, lambda x: x["c"]).alias("comments"), F.struct(*[n.alias(s) for s, n in counts.items()]).alias("by_severity"), F.count("*").alias("n")
    )
    rows = totals.join(rows, key, "left")
    none = F.struct(*[F.lit(0).cast("long").alias(s) for s in SEVERITIES])
    summary = F.struct(F.col("files"), F.col("hunks"), F.coalesce("n", F.lit(0).cast("long")).alias("comments"), F.coalesce("by_severity", none).alias("by_severity"), F.col("model"))
    empty = F.array().cast("array<struct<file:string,line:int,severity:string,message:string>>")
    body = F.struct(summary.alias("summary"), F.col("skipped"), F.coalesce("comments", empty).alias("comments"))
    return rows.select(key, F.to_json(body).alias("review"))


# ------------------------------------------------------------------ answers


def source_rows(results: DataFrame, key: str) -> DataFrame:
    """Retrieved chunks as the sources of an answer: place, symbol, kind, score to four digits, rank."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return results.select(key, place.alias("location"), F.col("file_path").alias("file"), "symbol", "kind", "language", "start_line", "end_line", F.round("score", 4).alias("score"), "rank")


def answer_rows(answers: DataFrame, sources: DataFrame, key: str, mode: str) -> DataFrame:
    """One result a request: question, answer, mode, grounded (null for plain answers), attempts, sources by rank, tokens."""
    packed = F.array_sort(F.collect_list(F.struct("rank", *[c for c in sources.columns if c not in (key, "rank")])))
    rows = answers.join(sources.groupBy(key).agg(packed.alias("sources")), key, "left")
    grounded = F.lit(None).cast("boolean") if mode == "plain" else F.col("grounded")
    return rows.select(key, "question", "answer", F.lit(mode).alias("mode"), grounded.alias("grounded"), F.lit(1).alias("attempts") if mode == "plain" else F.col("attempts"), "sources")


def source_listing(sources: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """key, rank, text: the retrieved places, a star at those that the answer cites (key, location)."""
    marks = cited.select(key, "location").distinct().withColumn("cited", F.lit(True))
    rows = sources.join(marks, [key, "location"], "left")
    mark = F.when(F.col("cited"), "*").otherwise(" ")
    return rows.select(key, "rank", F.format_string(" %s %2d. %s  %s %s", mark, F.col("rank"), F.col("location"), F.col("kind"), F.col("symbol")).alias("text"))


def answer_events(answers: DataFrame, drafts: DataFrame, key: str) -> DataFrame:
    """key, seq, kind, payload: the stream of an answer, as a client sees it.

    First ``meta``, then for each draft (key, attempt, tokens) a ``reset`` from the second on, a ``stage``
    and its tokens, then ``sources`` and ``done``.
    """
    token = F.posexplode("tokens").alias("i", "text")
    text = drafts.select(key, "attempt", token).select(key, "attempt", (F.col("i") + 2).alias("i"), F.lit("token").alias("kind"), F.to_json(F.struct("text")).alias("payload"))
    stage = drafts.select(key, "attempt", F.lit(1).alias("i"), F.lit("stage").alias("kind"), F.to_json(F.struct(F.lit("draft").alias("stage"), F.col("attempt").cast("string").alias("detail"))).alias("payload"))
    reset = drafts.filter("attempt > 1").select(key, "attempt", F.lit(0).alias("i"), F.lit("reset").alias("kind"), F.to_json(F.struct("attempt")).alias("payload"))
    meta = answers.select(key, F.lit(0).alias("attempt"), F.lit(0).alias("i"), F.lit("meta").alias("kind"), F.to_json(F.struct("question")).alias("payload"))
    last = F.lit((1 << 31) - 1)
    sources = answers.select(key, last.alias("attempt"), F.lit(0).alias("i"), F.lit("sources").alias("kind"), F.to_json(F.struct("sources")).alias("payload"))
    done = answers.select(key, last.alias("attempt"), F.lit(1).alias("i"), F.lit("done").alias("kind"), F.to_json(F.struct("answer", "grounded", "attempts")).alias("payload"))
    rows = meta.union(reset).union(stage).union(text).union(sources).union(done)
    from pyspark.sql import Window

    return rows.select(key, F.row_number().over(Window.partitionBy(key).orderBy("attempt", "i")).alias("seq"), "kind", "payload")


def test_summary(command: Column, language: Column, exit_code: Column, timed_out: Column, log: Column, limit: int = 2000) -> Column:
    """A test run in short: the command, how it ended, the end of its log."""
    end = F.when(timed_out, "timed out").when(exit_code == 0, "passed").otherwise("failed")
    return F.concat(F.lit("$ "), command, F.lit("\n["), language, F.lit("] "), end, F.lit("\n"), F.substring(log, -limit, limit))
