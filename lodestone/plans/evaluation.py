"""Queries: retrieval metrics, slices, ablation reports, samples, label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import CUTOFFS
from lodestone.lineage import cut, spread
from lodestone.operators import metrics
from lodestone.sources.gold import unmatched_labels
from lodestone.plans.registry import register, table
from lodestone.plans.retrieval import BM25_SQL, benchmark_ranking

# Gold: the documents that hold a benchmark passage verbatim; items without one are not scored.
GOLD_SQL = """gold AS (SELECT item_id AS query_id, doc_id AS answer_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> '')"""


#: What parts words here: white space of ASCII.
SPACE = r"\s+"


def passages_in(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, answer_id) where the item's text stands in the document.

    The inner words of a passage stand as whole words wherever the passage does.  An equi join on the
    one that the fewest documents have finds candidates, whose texts are then compared; no text
    moves before.  Passages of fewer than three words have no such word and are tested one by one.
    """
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    asked = asked.filter("passage <> ''").withColumn("words", F.split(F.trim("passage"), SPACE))
    inner = asked.filter(F.size("words") >= 3).select("query_id", F.explode(F.array_distinct(F.slice("words", F.lit(2), F.size("words") - 2))).alias("word"))
    places = docs.select("doc_id", F.explode(F.split("text", SPACE)).alias("word")).join(inner.select("word").distinct(), "word", "left_semi").distinct()
    places = cut(places)
    rarity = inner.join(places.groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    keys = rarity.groupBy("query_id").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    candidates = places.join(keys, "word").select("query_id", "doc_id")
    texts = asked.select("query_id", "passage")
    found = docs.select("doc_id", "text").join(candidates, "doc_id").join(texts, "query_id").filter(F.contains("text", "passage"))
    short = asked.filter(F.size("words") < 3).select("query_id", "passage")
    rest = docs.select("doc_id", "text").join(short, F.contains("text", "passage"))
    ids = [F.col("query_id"), F.col("doc_id").alias("answer_id")]
    return found.select(*ids).union(rest.select(*ids)).distinct()


def gold(spark, d):
    return passages_in(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "benchmark"))


METRICS_SQL = f"""WITH {BM25_SQL}, {GOLD_SQL},
res AS (SELECT query_id, id AS answer_id, rank AS position FROM bm25 WHERE rank <= 20 AND score > 0),
m AS (SELECT g.query_id, g.answer_id, position FROM gold g LEFT JOIN res USING (query_id, answer_id)),
per AS (SELECT query_id, {", ".join(f"count(DISTINCT CASE WHEN position <= {k} THEN answer_id END)::DOUBLE / count(DISTINCT answer_id) AS recall_{k}, coalesce(bool_or(position <= {k}), false) AS hit_{k}" for k in CUTOFFS)},
  coalesce(1.0::DOUBLE / min(position), 0) AS rr FROM m GROUP BY query_id)"""


def per_question(spark, d) -> DataFrame:
    results = benchmark_ranking(spark, d, max(CUTOFFS)).select("query_id", F.col("id").alias("answer_id"), F.col("rank").alias("position"))
    wanted = gold(spark, d)
    return metrics.question_metrics(wanted.join(results, ["query_id", "answer_id"], "left"), CUTOFFS)


ROUNDED = [f"recall_{k}" for k in CUTOFFS] + ["rr"]


@register(
    "question_metrics",
    METRICS_SQL + f" SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in ROUNDED)}, {', '.join(f'hit_{k}' for k in CUTOFFS)} FROM per",
)
def question_metrics(spark, d):
    return per_question(spark, d).withColumns({c: F.round(c, 6) for c in ROUNDED})


MEANS = {f"recall_{k}": f"recall_{k}" for k in CUTOFFS} | {f"hit_rate_{k}": f"hit_{k}" for k in CUTOFFS} | {"mrr": "rr"}


@register(
    "recall_hit_mrr",
    METRICS_SQL + " SELECT count(*) AS questions, " + ", ".join(f"round(coalesce(avg({c}::DOUBLE), 0), 6) AS {n}" for n, c in MEANS.items()) + " FROM per",
)
def recall_hit_mrr(spark, d):
    means = [F.round(metrics.mean_or_zero(F.col(c).cast("double")), 6).alias(n) for n, c in MEANS.items()]
    return per_question(spark, d).agg(F.count("*").alias("questions"), *means)


SLICE_COLUMNS = ("split", "style", "repo")


@register(
    "metric_slices",
    METRICS_SQL
    + """, s AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN query_id % 3 = 0 THEN 'lexical' ELSE 'semantic' END AS style,
  'repo' || (query_id % 4) AS repo FROM per)
SELECT split, style, repo, count(*) AS questions, round(avg(recall_8), 6) AS recall_8, round(avg(rr), 6) AS mrr
FROM s GROUP BY GROUPING SETS ((split), (split, style), (split, repo))""",
)
def metric_slices(spark, d):
    """Split, split x style and split x repo means in one pass over the outcomes."""
    rows = per_question(spark, d).withColumns(
        {
            "split": F.when(F.col("query_id") % 2 == 0, "dev").otherwise("test"),
            "style": F.when(F.col("query_id") % 3 == 0, "lexical").otherwise("semantic"),
            "repo": F.concat(F.lit("repo"), (F.col("query_id") % 4).cast("string")),
        }
    )
    sets = [["split"], ["split", "style"], ["split", "repo"]]
    return metrics.slice_report(
        rows, sets, {"questions": F.count("*"), "recall_8": F.round(F.avg("recall_8"), 6), "mrr": F.round(F.avg("rr"), 6)}
    )


# Outcomes of four configurations, made from the labelled documents.
OUTCOMES_SQL = """
cfg AS (SELECT * FROM (VALUES ('vector', 0), ('hybrid', 1), ('rag', 2), ('agent', 3)) c(config, ord)),
outcomes AS (SELECT config, ord, doc_id AS question_id, CASE WHEN quality = 1 THEN 'factual' ELSE 'explanatory' END AS kind,
  CASE WHEN doc_id % 2 = 0 THEN 'semantic' ELSE 'lexical' END AS style,
  ((doc_id * (ord + 3)) % 5)::DOUBLE / 4 AS recall,
  CASE WHEN ord < 2 THEN NULL ELSE ((doc_id * 7 + ord) % 3)::DOUBLE / 2 END AS accuracy,
  (doc_id % 11)::DOUBLE AS seconds, doc_id % 101 AS tokens FROM labels, cfg)"""


def outcomes(spark, d) -> DataFrame:
    configs = spark.createDataFrame([("vector", 0), ("hybrid", 1), ("rag", 2), ("agent", 3)], "config string, ord int")
    q = F.col("doc_id")
    return table(spark, d, "labels").join(F.broadcast(configs)).select(
        "config",
        "ord",
        q.alias("question_id"),
        F.when(F.col("quality") == 1, "factual").otherwise("explanatory").alias("kind"),
        F.when(q % 2 == 0, "semantic").otherwise("lexical").alias("style"),
        ((q * (F.col("ord") + 3)) % 5 / 4).alias("recall"),
        F.when(F.col("ord") >= 2, (q * 7 + F.col("ord")) % 3 / 2).alias("accuracy"),
        (q % 11).cast("double").alias("seconds"),
        (q % 101).alias("tokens"),
    )


BREAKDOWN = [("factual", "kind"), ("explanatory", "kind"), ("semantic", "style"), ("lexical", "style")]


@register(
    "ablation_table",
    f"""WITH {OUTCOMES_SQL} SELECT config, count(*) AS questions, round(avg(recall), 6) AS recall, round(avg(accuracy), 6) AS accuracy,
coalesce(printf('%.3f', round(avg(accuracy), 6)), 'n/a') AS accuracy_cell, sum(seconds) AS seconds, sum(tokens)::BIGINT AS tokens,
{", ".join(f"round(avg(CASE WHEN {c} = '{v}' THEN recall END), 6) AS recall_{v}, round(avg(CASE WHEN {c} = '{v}' THEN accuracy END), 6) AS accuracy_{v}" for v, c in BREAKDOWN)}
FROM outcomes GROUP BY config""",
)
def ablation_table(spark, d):
    cols = []
    for value, column in BREAKDOWN:
        for m in ("recall", "accuracy"):
            cols.append(F.round(F.avg(F.when(F.col(column) == value, F.col(m))), 6).alias(f"{m}_{value}"))
    accuracy = F.round(F.avg("accuracy"), 6)
    return (
        outcomes(spark, d)
        .groupBy("config")
        .agg(
            F.count("*").alias("questions"),
            F.round(F.avg("recall"), 6).alias("recall"),
            accuracy.alias("accuracy"),
            metrics.cell(accuracy).alias("accuracy_cell"),
            F.sum("seconds").alias("seconds"),
            F.sum("tokens").alias("tokens"),
            *cols,
        )
    )


@register(
    "failure_report",
    f"""WITH {OUTCOMES_SQL} SELECT question_id, kind, recall, accuracy FROM outcomes WHERE config = 'agent' AND coalesce(accuracy, 0) < 1
ORDER BY coalesce(accuracy, 0), recall DESC, question_id LIMIT 12""",
)
def failure_report(spark, d):
    return metrics.failures(outcomes(spark, d).filter("config = 'agent'")).select("question_id", "kind", "recall", "accuracy")


@register(
    "best_config",
    f"""WITH {OUTCOMES_SQL}, m AS (SELECT config, ord, coalesce(avg(accuracy), 0) AS accuracy FROM outcomes GROUP BY ALL)
SELECT config, round(accuracy, 6) AS accuracy FROM m ORDER BY m.accuracy DESC, ord LIMIT 1""",
)
def best_config(spark, d):
    return metrics.best_config(outcomes(spark, d)).select("config", F.round("accuracy", 6).alias("accuracy"))


@register(
    "outcome_summary",
    f"""WITH {OUTCOMES_SQL} SELECT config, kind, style, count(*) AS questions FROM outcomes GROUP BY GROUPING SETS ((config, kind), (config, style), (config))""",
)
def outcome_summary(spark, d):
    return metrics.slice_report(outcomes(spark, d), [["config", "kind"], ["config", "style"], ["config"]], {"questions": F.count("*")})


@register(
    "stratified_head",
    """SELECT doc_id, lang, source, nth FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS nth FROM documents)
WHERE nth <= 5""",
)
def stratified_head(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return metrics.stratified_head(docs, ["lang", "source"], "doc_id", limit=20, groups=4)


@register(
    "label_validation",
    """WITH have AS (SELECT doc_id, lang FROM documents WHERE n_chars >= 500),
names AS (SELECT lang, list_sort(list(doc_id::VARCHAR))[1:6] AS hints FROM have GROUP BY lang)
SELECT doc_id, 'label' || quality AS name, array_to_string(hints, ',') AS hints FROM labels ANTI JOIN have USING (doc_id) JOIN documents USING (doc_id) LEFT JOIN names USING (lang)
WHERE toxic = 0""",
)
def label_validation(spark, d):
    """Labels whose document is not among the indexed ones, with up to six of its language's documents as a hint."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("file"), F.col("doc_id").cast("string").alias("symbol"), "n_chars")
    wanted = table(spark, d, "labels").filter("toxic = 0").join(docs, "doc_id")
    answers = wanted.select("doc_id", F.concat(F.lit("label"), F.col("quality").cast("string")).alias("name"), "file", "symbol")
    bad = unmatched_labels(answers, docs.filter("n_chars >= 500").select("file", "symbol"))
    return bad.select("doc_id", "name", F.array_join("hints", ",").alias("hints"))
