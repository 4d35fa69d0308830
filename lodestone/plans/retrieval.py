"""Queries: tokens, keyword and vector rankings, fusion, routing, reranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import STOPWORDS, VECTOR_POOL
from lodestone.functions.text import mentions_identifier
from lodestone.lineage import spread
from lodestone.operators import bm25, retrieval
from lodestone.operators.fusion import explain, fuse
from lodestone.operators.vectors import vector_topk
from lodestone.plans.registry import register, table

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(source: str, key: str, text: str, name: str) -> str:
    """CTEs ``name`` (id, term), one row a token."""
    return f"""
{name}_w AS (SELECT {key} AS id, unnest(regexp_extract_all({text}, '[A-Za-z0-9_]+')) AS w FROM {source}),
{name}_p AS (SELECT id, list_transform(regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'),
                    '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), lambda x: lower(x)) AS p FROM {name}_w),
{name}_t AS (SELECT id, unnest(CASE WHEN len(p) > 1 THEN list_prepend(array_to_string(p, ''), p) ELSE p END) AS term FROM {name}_p),
{name} AS (SELECT id, term FROM {name}_t WHERE term NOT IN ({STOP_SQL}))"""


def stats_sql(source: str) -> str:
    """CTEs size and stats (term, df, idf) of the tokens ``toks`` of a table with doc_id."""
    return f"""
size AS (SELECT count(*) AS docs, avg(coalesce(n, 0)) AS mean_length FROM {source} LEFT JOIN (SELECT id, count(*) AS n FROM toks GROUP BY id) ON id = doc_id),
df AS (SELECT term, count(DISTINCT id) AS df FROM toks GROUP BY term),
raw AS (SELECT term, df, ln(docs - df + 0.5) - ln(df + 0.5) AS r FROM df, size),
mean AS (SELECT avg(r) AS m FROM raw),
stats AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM raw, mean)"""


STATS_SQL = stats_sql("documents")

BM25_SQL = f"""{tokens_sql("documents", "doc_id", "text", "toks")},
{tokens_sql("benchmark", "item_id", "text", "qtoks")},{STATS_SQL},
len AS (SELECT id, count(*) AS n FROM toks GROUP BY id),
q AS (SELECT id AS query_id, term, count(*) AS times FROM qtoks GROUP BY ALL),
hits AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM q) GROUP BY ALL),
scored AS (SELECT query_id, h.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.9 + 0.1 * n / mean_length))), 9) AS score
  FROM hits h JOIN q USING (term) JOIN stats USING (term) JOIN len USING (id), size GROUP BY ALL),
bm25 AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def document_terms(spark, d):
    return bm25.term_table(spread(table(spark, d, "documents")), "doc_id", "text")


def document_index(spark, d):
    return bm25.build_index(spread(table(spark, d, "documents")), "doc_id", "text")


@register(
    "tokenize_documents",
    f"""WITH {tokens_sql("documents", "doc_id", "text", "toks")}
SELECT id AS doc_id, term, count(*) AS tf FROM toks GROUP BY ALL""",
)
def tokenize_documents(spark, d):
    return bm25.postings(document_terms(spark, d)).select(F.col("id").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


@register(
    "term_stats",
    f"""WITH {tokens_sql("documents", "doc_id", "text", "toks")},{STATS_SQL}
SELECT term, df, round(idf, 6) AS idf FROM stats""",
)
def term_stats(spark, d):
    return document_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def benchmark_ranking(spark, d, k):
    return bm25.bm25_topk(document_index(spark, d), table(spark, d, "benchmark"), "item_id", "text", k)


@register("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, id AS doc_id, round(score, 6) AS score, rank FROM bm25 WHERE rank <= 20 AND score > 0")
def bm25_topk(spark, d):
    found = benchmark_ranking(spark, d, 20)
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


COSINE_SQL = """
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, v.label,
  round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


@register(
    "vector_topk",
    f"""WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM pairs)
SELECT query_id, id, score, rank FROM r WHERE rank <= 20""",
)
def vector_topk_query(spark, d):
    vectors = table(spark, d, "embeddings")
    found = vector_topk(vectors, vectors.filter("vec_id % 50 = 0"), 20)
    return found.select("query_id", "id", "score", "rank")


@register(
    "vector_topk_per_label",
    f"""WITH {COSINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS rank FROM pairs)
SELECT query_id, label::BIGINT AS label, id, score, rank FROM r WHERE rank <= 3""",
)
def vector_topk_per_label(spark, d):
    vectors = table(spark, d, "embeddings")
    found = vector_topk(vectors, vectors.filter("vec_id % 50 = 0"), 3, group_col="label")
    return found.select("query_id", F.col("grp").alias("label"), "id", "score", "rank")


# Two rankings of the same documents for each language, by length and by length modulo 97.
RANKINGS_SQL = """
a AS (SELECT lang AS query_id, 'vector' AS retriever, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT lang AS query_id, 'bm25' AS retriever, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 97 DESC, doc_id) AS rank FROM documents),
rankings AS (SELECT * FROM a WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20)"""


def rrf_sql(weight_vector: float, weight_bm25: float) -> str:
    return f"""WITH {RANKINGS_SQL},
w AS (SELECT *, CASE retriever WHEN 'vector' THEN {weight_vector} ELSE {weight_bm25} END AS weight FROM rankings),
f AS (SELECT query_id, id, round(sum(weight / (10 + rank)), 12) AS score, string_agg(retriever || ' #' || rank, ' + ' ORDER BY retriever) AS explained
  FROM w WHERE weight <> 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id::VARCHAR) AS rank FROM f)
SELECT query_id, id, round(score, 9) AS score, rank, explained FROM r WHERE rank <= 8"""


def two_rankings(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    a = bm25.ranked(docs, VECTOR_POOL, F.desc("n_chars"), F.asc("id")).withColumn("retriever", F.lit("vector"))
    b = bm25.ranked(docs, VECTOR_POOL, F.desc(F.col("n_chars") % 97), F.asc("id")).withColumn("retriever", F.lit("bm25"))
    return a.unionByName(b).select("query_id", "retriever", "id", "rank")


def weighted(spark, d, vector, keyword):
    rows = two_rankings(spark, d).withColumn("weight", F.when(F.col("retriever") == "vector", F.lit(vector)).otherwise(F.lit(keyword)))
    found = fuse(rows)
    return found.select("query_id", "id", F.round("score", 9).alias("score"), "rank", explain(F.col("contributions")).alias("explained"))


@register("rrf_fusion", rrf_sql(1.0, 1.0))
def rrf_fusion(spark, d):
    return weighted(spark, d, 1.0, 1.0)


@register("rrf_weighted", rrf_sql(1.0, 3.0))
def rrf_weighted(spark, d):
    return weighted(spark, d, 1.0, 3.0)


@register("rrf_zero_weight", rrf_sql(1.0, 0.0))
def rrf_zero_weight(spark, d):
    return weighted(spark, d, 1.0, 0.0)


# No table holds identifiers: a few questions of both styles, as literals.
QUESTIONS = [
    (1, "where is parse_jwt called?"),
    (2, "what does HTTPServer do with headers?"),
    (3, "how are retries handled?"),
    (4, "does getUserName trim its input?"),
    (5, "what happens in session.close() on error?"),
    (6, "is there a limit on the size of a file?"),
    (7, "what does `the and attion` mean?"),
    (8, "why does __init__ take two arguments?"),
    (9, "the thing and the other thing of it?"),
]
QUESTIONS_SQL = "VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
ROUTER_SQL = r"`[^`]+`|\b[A-Za-z][a-z0-9]*_[A-Za-z0-9_]+\b|\b\w*[a-z][A-Z]\w*\b|\b[A-Z]{2,}[a-z]\w+\b|\b\w+\.\w+\(|__\w+__"


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id long, question string")


@register("router", f"SELECT qid AS question_id, regexp_matches(q, '{ROUTER_SQL}') AS named FROM ({QUESTIONS_SQL}) t(qid, q)")
def router(spark, d):
    return questions(spark).select("question_id", mentions_identifier(F.col("question")).alias("named"))


@register(
    "rerank_topk",
    f"""WITH {BM25_SQL},
qset AS (SELECT id AS query_id, list(DISTINCT term) AS qs FROM qtoks GROUP BY id),
dset AS (SELECT id, list(DISTINCT term) AS ds FROM toks WHERE id IN (SELECT id FROM bm25 WHERE rank <= 30) GROUP BY id),
c AS (SELECT query_id, id, rank AS before, round(len(list_intersect(qs, ds))::DOUBLE / len(qs), 9) AS score FROM bm25 JOIN qset USING (query_id) JOIN dset USING (id)
  WHERE rank <= 30 AND bm25.score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM c)
SELECT query_id, id AS doc_id, round(score, 6) AS score, before, rank FROM r WHERE rank <= 8""",
)
def rerank_topk(spark, d):
    """Reranks keyword candidates by the share of the question's terms that the document has."""
    docs, asked = table(spark, d, "documents"), table(spark, d, "benchmark")
    candidates = benchmark_ranking(spark, d, 30)
    pairs = candidates.drop("score").join(asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    pairs = pairs.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    found = retrieval.rerank(retrieval.term_overlap(pairs), F.col("score"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "before", "rank")
