"""Retrievers over a batch of questions: keyword, vector, routed hybrid, reranked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import FINAL_TOP_K, KEYWORD_POOL, KEYWORD_WEIGHT_NAMED, RERANK_POOL, VECTOR_POOL, VECTOR_WEIGHT
from lodestone.functions.text import TermCounter, mentions_identifier
from lodestone.operators.bm25 import KeywordIndex, bm25_topk, ranked
from lodestone.operators.fusion import fuse
from lodestone.operators.vectors import vector_topk


@dataclass(frozen=True)
class Index:
    """What a repository's retrievers read: the keyword index, vectors (id, vector), documents (id, text)."""

    keyword: KeywordIndex
    vectors: DataFrame
    documents: DataFrame


def route(questions: DataFrame, text_col: str) -> DataFrame:
    """Adds ``keyword_weight``: only questions that name an identifier use the keyword index."""
    named = mentions_identifier(F.col(text_col))
    return questions.withColumn("keyword_weight", F.when(named, F.lit(KEYWORD_WEIGHT_NAMED)).otherwise(F.lit(0.0)))


def hybrid(vector_ranking: DataFrame, index: KeywordIndex, questions: DataFrame, question_id: str, question_text: str, k: int = FINAL_TOP_K) -> DataFrame:
    """Fuses the vector ranking with keyword ranks of the routed questions only; the others never reach the index."""
    routed = route(questions, question_text)
    named = routed.filter("keyword_weight > 0")
    keyword = bm25_topk(index, named, question_id, question_text, KEYWORD_POOL)
    weights = named.select(F.col(question_id).alias("query_id"), F.col("keyword_weight").alias("weight"))
    keyword = keyword.join(weights, "query_id").select("query_id", F.lit("bm25").alias("retriever"), "id", "rank", "weight")
    vector = vector_ranking.filter(F.col("rank") <= VECTOR_POOL)
    vector = vector.select("query_id", F.lit("vector").alias("retriever"), "id", "rank", F.lit(VECTOR_WEIGHT).alias("weight"))
    return fuse(vector.unionByName(keyword), top_k=k)


def rerank(candidates: DataFrame, score: Column, k: int = FINAL_TOP_K) -> DataFrame:
    """Re-orders at most RERANK_POOL candidates a query by ``score``; ties keep the incoming order."""
    pool = candidates.filter(F.col("rank") <= RERANK_POOL).withColumnRenamed("rank", "before")
    again = ranked(pool.withColumn("score", score), k, F.desc("score"), F.asc("before"))
    return again.select("query_id", "id", "score", "before", "rank", *[c for c in candidates.columns if c == "contributions"])


# ------------------------------------------------------------------ over an index

#: ``scorer(pairs)`` adds ``score`` to rows with question and document text.
Scorer = Callable[[DataFrame], DataFrame]


def vector_search(index: Index, questions: DataFrame, k: int = VECTOR_POOL) -> DataFrame:
    """query_id, id, score, rank, contributions of questions (query_id, question, vector)."""
    found = vector_topk(index.vectors, questions, max(0, k), "id", "vector", query_col="query_id")
    return found.withColumn("contributions", F.create_map(F.lit("vector"), "rank"))


def bm25_search(index: Index, questions: DataFrame, k: int = KEYWORD_POOL) -> DataFrame:
    """As ``vector_search``; questions without an index term find nothing."""
    found = bm25_topk(index.keyword, questions, "query_id", "question", k)
    return found.withColumn("contributions", F.create_map(F.lit("bm25"), "rank"))


def hybrid_search(index: Index, questions: DataFrame, k: int = FINAL_TOP_K) -> DataFrame:
    return hybrid(vector_search(index, questions, VECTOR_POOL), index.keyword, questions, "query_id", "question", k)


def term_overlap(pairs: DataFrame) -> DataFrame:
    """A scorer without a model: the share of the question's distinct terms that the document has."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        terms = TermCounter()
        for asked, held in batches:
            both = [(terms(q), terms(t)) for q, t in zip(asked, held, strict=True)]
            yield pd.Series([round(len(q.keys() & t.keys()) / max(1, len(q)), 9) for q, t in both], dtype="float64")

    return pairs.withColumn("score", F.pandas_udf(run, "double")("question", "text"))


def hybrid_rerank_search(index: Index, questions: DataFrame, k: int = FINAL_TOP_K, scorer: Scorer = term_overlap) -> DataFrame:
    """The hybrid's RERANK_POOL best, scored pair by pair with the whole document."""
    pool = hybrid_search(index, questions, RERANK_POOL).drop("score")
    pairs = pool.join(questions.select("query_id", "question"), "query_id").join(index.documents, "id")
    return rerank(scorer(pairs), F.col("score"), k)


#: Rankings by name; each takes an index, questions (query_id, question, vector) and k.
RETRIEVERS: dict[str, Callable] = {"vector": vector_search, "bm25": bm25_search, "hybrid": hybrid_search, "hybrid_rerank": hybrid_rerank_search}


def search_code(index: Index, question: DataFrame, k: int = FINAL_TOP_K, retriever: str = "hybrid") -> DataFrame:
    """The agent's search tool: one of the retrievers by name."""
    if retriever not in RETRIEVERS:
        raise ValueError(f"unknown retriever {retriever!r}; known: {', '.join(sorted(RETRIEVERS))}")
    return RETRIEVERS[retriever](index, question, k)
