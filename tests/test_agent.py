import pytest
from pyspark.sql import functions as F

from lodestone.operators import agent, prompts


def attempts(spark, rows):
    return spark.createDataFrame(rows, "q int, attempt int, answer string, kind string")


@pytest.mark.parametrize(
    ("kinds", "answers", "best"),
    [
        (["critic", "no_citations", "fabricated"], ["a", "a", "a"], 0),
        (["no_citations", "critic"], ["a", "a"], 1),
        (["critic", "critic"], ["a", "b"], 1),
        (["no_citations", "no_citations"], ["longer one", "short"], 0),
        (["critic", ""], ["long long", "s"], 1),
    ],
)
def test_least_bad(spark, kinds, answers, best):
    rows = [(1, i, a, k) for i, (a, k) in enumerate(zip(answers, kinds, strict=True))]
    assert agent.least_bad(attempts(spark, rows), "q").first()["attempt"] == best


@pytest.mark.parametrize(
    ("state", "want"),
    [
        (dict(grounded=True), "end"), (dict(followup="x"), "search"), (dict(), "rewrite"), (dict(attempts=3, followup="x"), "end"), (dict(kind="no_citations", uncited=2), "end"),
        (dict(kind="no_citations", uncited=1), "rewrite"), (dict(evidence=0, queries=0), "end"), (dict(evidence=0, queries=1), "search"),
    ],
)
def test_decision(spark, state, want):
    full = dict(grounded=False, attempts=1, kind="critic", followup="", evidence=2, queries=1, uncited=0) | state
    row = spark.createDataFrame([tuple(full.values())], "grounded boolean, attempts int, kind string, followup string, evidence int, queries int, uncited int")
    assert row.select(agent.decision()).first()[0] == want


def test_merge_evidence(spark):
    rows = [(1, "alpha", 1, 1), (1, "beta", 1, 2), (1, "beta", 2, 1), (1, "gamma", 2, 2)]
    found = agent.merge_evidence(spark.createDataFrame(rows, "q int, id string, attempt int, rank int"), "q").orderBy("ord").collect()
    assert [r["id"] for r in found] == ["alpha", "beta", "gamma"]


def test_overlap_rule(spark):
    cited = agent.cited_ranges(spark.createDataFrame([(1, "x.js:4-8 and y.js:4-8 and z/x.js:40-48")], "q int, answer string"), "q", "answer")
    evidence = spark.createDataFrame([(1, "api/x.js", 3, 9)], "q int, file string, start int, end int")
    left = {r["citation"] for r in agent.unsupported_citations(cited, evidence, "q").collect()}
    assert left == {"y.js:4-8", "z/x.js:40-48"}


def test_prompt_cuts_long_excerpts_and_ends_with_the_question(spark):
    rows = [(1, 2, "b.py:1-2", "function", "g", "python", "short"), (1, 1, "a.py:1-9", "function", "f", "python", "x" * 3001)]
    pack = agent.evidence_pack(spark.createDataFrame(rows, "q int, rank int, place string, kind string, symbol string, language string, code string"), "q")
    row = pack.select("context", prompts.question_turn(F.lit("why?"), F.col("context"), F.col("excerpts")).alias("p")).first()
    assert row["context"].index("[1] a.py:1-9") < row["context"].index("[2] b.py:1-2") and "truncated" in row["context"] and "x" * 3001 not in row["context"]
    assert row["p"].endswith("Question: why?")


def test_critic_in_the_loop(spark):
    asked = spark.createDataFrame([(1, "q1")], "query_id int, question string")

    def retrieve(rows):
        return rows.select("query_id", F.concat(F.lit("c"), F.col("query")).alias("id"), F.lit(1).alias("rank"), F.lit("a.py").alias("file"), F.lit(1).alias("start"), F.lit(5).alias("end"), F.lit("b").alias("block"))

    def generate(rows):
        return rows.withColumn("answer", F.lit("see a.py:1-2"))

    def critic(rows):
        done = F.col("note") == "critic"
        return rows.withColumn("reply", F.when(done, "GROUNDED: yes").otherwise("GROUNDED: no\nREASON: r\nQUERY: more"))

    row = agent.run_agent(asked, retrieve, generate, critic).first()
    assert row["grounded"] and row["attempts"] == 2 and row["kind"] == ""
