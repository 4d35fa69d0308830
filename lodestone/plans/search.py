"""Queries: retrievers over documents that have vectors, and their score table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import CUTOFFS, RETRIEVAL_DEPTH
from lodestone.lineage import cut, spread
from lodestone.operators import bm25, metrics, retrieval
from lodestone.operators.fusion import explain
from lodestone.plans.registry import register, table
from lodestone.plans.retrieval import ROUTER_SQL, stats_sql, tokens_sql

# Every fiftieth document asks for two of its words, every second of these by an identifier.
SEARCH_SQL = f"""
hd AS (SELECT d.doc_id, d.text, d.lang, e.embedding FROM documents d JOIN embeddings e ON doc_id = vec_id),
hw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+') AS w FROM hd WHERE doc_id % 50 = 0),
hq AS (SELECT doc_id AS qid, CASE WHEN doc_id % 100 = 0 THEN '`' || coalesce(w[3], '') || '` ' || coalesce(w[5], '') ELSE coalesce(w[3], '') || ' ' || coalesce(w[5], '') END AS q FROM hw),
{tokens_sql("hd", "doc_id", "text", "toks")},
{tokens_sql("hq", "qid", "q", "qtoks")},{stats_sql("hd")},
len AS (SELECT id, count(*) AS n FROM toks GROUP BY id),
qt AS (SELECT id AS query_id, term, count(*) AS times FROM qtoks GROUP BY ALL),
hits AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
scored AS (SELECT query_id, h.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.9 + 0.1 * n / mean_length))), 9) AS score
  FROM hits h JOIN qt USING (term) JOIN stats USING (term) JOIN len USING (id), size GROUP BY ALL),
kw AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20 AND score > 0),
cosine AS (SELECT q.doc_id AS query_id, v.doc_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM hd q, hd v WHERE q.doc_id % 50 = 0),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cosine) WHERE rank <= 20),
both_ AS (SELECT query_id, id, 'bm25' AS retriever, rank FROM kw JOIN hq ON qid = query_id WHERE regexp_matches(q, '{ROUTER_SQL}') UNION ALL SELECT query_id, id, 'vector', rank FROM vec),
fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (10 + rank)), 12) AS score, string_agg(retriever || ' #' || rank, ' + ' ORDER BY retriever) AS explained FROM both_ GROUP BY ALL),
hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM fused),
qset AS (SELECT qid AS query_id, list(DISTINCT term) FILTER (term IS NOT NULL) AS qs FROM hq LEFT JOIN qtoks ON id = qid GROUP BY qid),
dset AS (SELECT id, list(DISTINCT term) AS ds FROM toks GROUP BY id),
pool AS (SELECT h.query_id, h.id, h.rank AS before, coalesce(round(len(list_intersect(qs, ds))::DOUBLE / greatest(len(qs), 1), 9), 0) AS score
  FROM hybrid h JOIN qset USING (query_id) LEFT JOIN dset USING (id) WHERE rank <= 30),
reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM pool)"""


def corpus(spark, d) -> tuple[retrieval.Index, DataFrame, DataFrame]:
    """(index, questions, documents) of the documents that have a vector."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    held = cut(docs.join(vectors, "id"))
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    a, b = (F.coalesce(F.get(w, F.lit(i)), F.lit("")) for i in (2, 4))
    text = F.when(F.col("id") % 100 == 0, F.concat(F.lit("`"), a, F.lit("` "), b)).otherwise(F.concat(a, F.lit(" "), b))
    questions = held.filter("id % 50 = 0").select(F.col("id").alias("query_id"), text.alias("question"), "vector")
    keyword = bm25.build_index(spread(held.select("id", "text")), "id", "text")
    return retrieval.Index(keyword, held.select("id", "vector"), held.select("id", "text")), questions, held


@register(
    "hybrid_routed",
    f"WITH {SEARCH_SQL} SELECT query_id, id AS doc_id, round(score, 9) AS score, rank, explained FROM hybrid WHERE rank <= 8",
)
def hybrid_routed(spark, d):
    """Cosine rankings of all questions, fused with keyword rankings of those that name an identifier."""
    index, questions, _ = corpus(spark, d)
    found = retrieval.search_code(index, questions)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "rank", explain(F.col("contributions")).alias("explained"))


@register("hybrid_rerank", f"WITH {SEARCH_SQL} SELECT query_id, id AS doc_id, round(score, 6) AS score, before, rank FROM reranked WHERE rank <= 8")
def hybrid_rerank(spark, d):
    index, questions, _ = corpus(spark, d)
    found = retrieval.hybrid_rerank_search(index, questions)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "before", "rank")


# Answers are (file, symbol): here the language and the id modulo 25, so that several documents match one.
OUTCOMES_SQL = f"""WITH {SEARCH_SQL},
res AS (SELECT 'bm25' AS retriever, query_id, id, rank FROM kw UNION ALL SELECT 'vector', query_id, id, rank FROM vec
  UNION ALL SELECT 'hybrid', query_id, id, rank FROM hybrid WHERE rank <= 20 UNION ALL SELECT 'hybrid_rerank', query_id, id, rank FROM reranked WHERE rank <= 20),
names AS (SELECT unnest(['bm25', 'vector', 'hybrid', 'hybrid_rerank']) AS retriever),
gold AS (SELECT retriever, doc_id AS query_id, a AS answer_id, lang AS file, ((doc_id + a) % 25)::VARCHAR AS symbol FROM hd, names, (VALUES (0), (1)) t(a) WHERE doc_id % 50 = 0),
m AS (SELECT g.retriever, g.query_id, g.answer_id, min(r.rank) AS position FROM gold g LEFT JOIN (SELECT r.retriever, r.query_id, r.rank, h.lang, h.doc_id FROM res r JOIN hd h ON r.id = h.doc_id) r
  ON g.retriever = r.retriever AND g.query_id = r.query_id AND g.file = r.lang AND g.symbol = (r.doc_id % 25)::VARCHAR GROUP BY ALL),
per AS (SELECT retriever, query_id, {", ".join(f"count(CASE WHEN position <= {k} THEN 1 END)::DOUBLE / count(*) AS recall_{k}" for k in CUTOFFS)}, coalesce(1.0::DOUBLE / min(position), 0) AS rr,
  CASE WHEN (query_id // 50) % 3 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN query_id % 100 = 0 THEN 'lexical' ELSE 'semantic' END AS style, 'repo' || ((query_id // 50) % 4) AS repo
  FROM m GROUP BY retriever, query_id)"""


def outcomes(spark, d) -> DataFrame:
    """One row a retriever and question: recalls, reciprocal rank, split, style, repository."""
    index, questions, held = corpus(spark, d)
    questions = cut(questions)
    found = None
    for name, search in retrieval.RETRIEVERS.items():
        one = search(index, questions, RETRIEVAL_DEPTH).select(F.lit(name).alias("retriever"), "query_id", "id", F.col("rank").alias("position"))
        found = one if found is None else found.unionByName(one)
    places = held.select("id", F.col("lang").alias("file"), (F.col("id") % 25).cast("string").alias("symbol"))
    names = F.explode(F.array(*[F.lit(n) for n in retrieval.RETRIEVERS])).alias("retriever")
    gold = held.filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("lang").alias("file"), F.explode(F.array(F.lit(0), F.lit(1))).alias("answer_id"), "id")
    gold = gold.select(names, "query_id", "answer_id", "file", ((F.col("id") + F.col("answer_id")) % 25).cast("string").alias("symbol"))
    by = ("retriever", "query_id")
    rows = metrics.question_metrics(metrics.matched(found.join(places, "id"), gold, ["file", "symbol"], by), CUTOFFS, by)
    n = F.expr("query_id div 50")
    return rows.withColumns(
        {
            "split": F.when(n % 3 == 0, "dev").otherwise("test"),
            "style": F.when(F.col("query_id") % 100 == 0, "lexical").otherwise("semantic"),
            "repo": F.concat(F.lit("repo"), (n % 4).cast("string")),
        }
    )


MEANS_SQL = ", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}" for k in CUTOFFS)


@register(
    "score_table",
    f"{OUTCOMES_SQL} SELECT retriever, split, style, repo, count(*) AS questions, {MEANS_SQL}, round(avg(rr), 6) AS mrr FROM per "
    "GROUP BY GROUPING SETS ((retriever, split), (retriever, split, style), (retriever, split, repo))",
)
def score_table(spark, d):
    found = metrics.score_table(outcomes(spark, d), CUTOFFS)
    return found.withColumns({c: F.round(c, 6) for c in [*[f"recall_{k}" for k in CUTOFFS], "mrr"]})


@register("question_list", f"{OUTCOMES_SQL} SELECT retriever, query_id, style, round(recall_8, 6) AS recall_8, round(rr, 6) AS rr, recall_8 = 0 AS check_label FROM per")
def question_list(spark, d):
    """Every question of every retriever, the worst first; a recall of 0 hints at a wrong label."""
    rows = outcomes(spark, d).withColumn("check_label", F.col("recall_8") == 0)
    rows = rows.select("retriever", "query_id", "style", F.round("recall_8", 6).alias("recall_8"), F.round("rr", 6).alias("rr"), "check_label")
    return rows.orderBy("retriever", "recall_8", "query_id")
