"""Gold questions: loading, validation, slices, label checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "struct<file:string,symbol:string>"
QUESTION = f"id string, repo string, split string, kind string, style string, question string, note string, answers array<{ANSWER}>"
ALLOWED = {"split": ("dev", "test"), "kind": ("factual", "explanatory"), "style": ("semantic", "lexical")}


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a gold file; raises ValueError that names what is wrong with it."""
    repo = "array<struct<name:string,path:string,commit:string>>"
    raw = spark.read.schema(f"repos {repo}, questions array<struct<{_as_fields(QUESTION)}>>").json(path, multiLine=True)
    questions = raw.select(F.explode("questions").alias("q")).select("q.*")
    repos = raw.select(F.explode("repos.name").alias("repo"))
    found = problems(questions, repos).limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    return questions


def _as_fields(ddl: str) -> str:
    depth, out = 0, []
    for c in ddl:
        depth += (c == "<") - (c == ">")
        out.append(":" if c == " " and not depth and out[-1] != "," else "" if c == " " else c)
    return "".join(out)


def problems(questions: DataFrame, repos: DataFrame) -> DataFrame:
    """id, problem of every question that breaks a rule."""
    twice = questions.groupBy("id").count().filter("count > 1").select("id", F.lit("id is not unique").alias("problem"))
    known = questions.join(repos.distinct(), "repo", "left_anti").select("id", F.lit("unknown repo").alias("problem"))
    none = questions.filter(F.coalesce(F.size("answers"), F.lit(0)) < 1).select("id", F.lit("no answers").alias("problem"))
    out = twice.union(known).union(none)
    for column, values in ALLOWED.items():
        bad = questions.filter(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
        out = out.union(bad.select("id", F.lit(f"bad {column}").alias("problem")))
    return out


def gold_slice(questions: DataFrame, **equal: str | None) -> DataFrame:
    """Questions whose columns equal the given values; None leaves a column open."""
    condition: Column = F.lit(True)
    for column, value in equal.items():
        if value is not None:
            condition = condition & (F.col(column) == value)
    return questions.filter(condition)


def by_ids(questions: DataFrame, ids: list[str]) -> DataFrame:
    """The questions with these ids; unknown ids are an error."""
    wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], "id string")
    missing = [r["id"] for r in wanted.join(questions, "id", "left_anti").collect()]
    if missing:
        raise ValueError(f"no question {', '.join(sorted(missing))}")
    return questions.join(wanted, "id", "left_semi")


def answers_of(questions: DataFrame) -> DataFrame:
    """id, file, symbol, one row an answer."""
    return questions.select("id", F.explode("answers").alias("a")).select("id", "a.file", "a.symbol")


def unmatched_labels(answers: DataFrame, chunks: DataFrame, hints: int = 6) -> DataFrame:
    """Answers that no chunk (file, symbol) has, with up to ``hints`` symbols of their file."""
    real = chunks.select("file", "symbol").distinct()
    names = real.groupBy("file").agg(F.slice(F.sort_array(F.collect_set("symbol")), 1, hints).alias("hints"))
    return answers.join(real, ["file", "symbol"], "left_anti").join(names, "file", "left")
