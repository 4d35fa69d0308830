"""Grading answers: by their citations where one place answers, by a model where an explanation is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import citations, location
from lodestone.operators.prompts import judge_turn
from lodestone.operators.providers import complete, parse_verdict, verdict_score


def citation_score(answer: Column, file: Column, symbol: Column) -> Column:
    """1 if the answer cites the file, 0.5 if it names the symbol's last part, else 0."""
    hit = F.exists(citations(answer), lambda c: F.startswith(c, F.concat(file, F.lit(":"))))
    return F.when(hit, 1.0).when(F.contains(answer, F.substring_index(symbol, ".", -1)), 0.5).otherwise(0.0)


def score_verdict(score: Column) -> Column:
    return F.when(score == 1, "correct").when(score == 0.5, "partial").otherwise("incorrect")


def judge_by_citation(answered: DataFrame, gold: DataFrame, key: str = "question_id") -> DataFrame:
    """key, accuracy, verdict of answers (key, answer): the best over the question's answers (key, file, symbol)."""
    scored = answered.join(gold, key).groupBy(key).agg(F.max(citation_score(F.col("answer"), F.col("file"), F.col("symbol"))).alias("accuracy"))
    return scored.withColumn("verdict", score_verdict(F.col("accuracy")))


def gold_code(gold: DataFrame, chunks: DataFrame, key: str = "question_id") -> DataFrame:
    """key, code: the chunks that a question's answers (key, file, symbol) name, in the order of the files."""
    named = gold.select(key, "file", "symbol").distinct()
    rows = chunks.select(F.col("file_path").alias("file"), "symbol", "start_line", "end_line", "part", "code")
    block = F.concat(location(F.col("file"), F.col("start_line"), F.col("end_line")), F.lit("  "), F.col("symbol"), F.lit("\n```\n"), F.col("code"), F.lit("\n```"))
    parts = F.array_sort(F.collect_list(F.struct("file", "start_line", "part", block.alias("block"))))
    return rows.join(named, ["file", "symbol"]).groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n").alias("code"))


def judge_by_model(answered: DataFrame, code: DataFrame, model, key: str = "question_id") -> DataFrame:
    """key, accuracy, verdict of answers (key, question, answer): without reference code 0, and no call."""
    rows = answered.join(code, key, "left")
    asked = rows.filter("code IS NOT NULL").withColumn("prompt", judge_turn(F.col("question"), F.col("answer"), F.col("code")))
    graded = complete(asked, "prompt", model, into="reply").withColumn("verdict", parse_verdict(F.col("reply")))
    graded = graded.select(key, verdict_score(F.col("verdict")).alias("accuracy"), "verdict")
    missing = rows.filter("code IS NULL").select(key, F.lit(0.0).alias("accuracy"), F.lit("incorrect").alias("verdict"))
    return graded.unionByName(missing)


def judged(answered: DataFrame, gold: DataFrame, chunks: DataFrame, model, key: str = "question_id") -> DataFrame:
    """key, accuracy, verdict, judged_by: factual questions by citation, the others by the model."""
    factual = answered.filter("kind = 'factual'")
    rest = answered.filter("kind <> 'factual' OR kind IS NULL")
    by_citation = judge_by_citation(factual, gold, key).withColumn("judged_by", F.lit("citation"))
    by_model = judge_by_model(rest, gold_code(gold, chunks, key), model, key).withColumn("judged_by", F.lit("llm"))
    return by_citation.unionByName(by_model)
