"""Keyword index and ranking: postings, term statistics and BM25 top-k for a batch of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import BM25_B, BM25_IDF_FLOOR, BM25_K1
from lodestone.functions.text import TermCounter
from lodestone.lineage import FEW_ROWS, cut


#: Bytes of text whose terms a task holds at once, if one text isn't longer; and rows.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1000


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, in slices of ``SLICE_BYTES`` of text and ``SLICE_ROWS`` rows at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if row > first and (held + size > SLICE_BYTES or row - first >= SLICE_ROWS):
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)


def term_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, length (number of terms), terms (term, tf), one row a document.

    One scan without a shuffle: a document's terms are counted where it is read, the parts of an
    identifier once for each distinct word of a task.  Terms are held for a slice of a batch, so that
    a worker's memory doesn't grow with the table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TermCounter()
        for part in slices(batches):
            lengths, ends, terms, times = [], [0], [], []
            for text in part.column("text").to_pylist():
                found = count(text)
                lengths.append(sum(found.values()))
                terms.extend(found)
                times.extend(found.values())
                ends.append(len(terms))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(times, pa.int32())], ["term", "tf"])
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["id", "length", "terms"]
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, length int, terms array<struct<term:string,tf:int>>")


@dataclass(frozen=True)
class KeywordIndex:
    """postings (id, length, term, tf), terms (term, df, idf), stats (docs, mean_length; one row)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def postings(table: DataFrame) -> DataFrame:
    """id, length, term, tf of a term table."""
    return table.select("id", "length", F.explode("terms").alias("t")).select("id", "length", "t.term", "t.tf")


def corpus_stats(table: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return table.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))


def term_stats(found: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf: terms in more than half of the documents get a share of the mean idf instead."""
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.join(F.broadcast(stats)).withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    floor = BM25_IDF_FLOOR * F.col("mean_idf")
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def build_index(docs: DataFrame, id_col: str, text_col: str) -> KeywordIndex:
    """The index of a table of documents; texts are tokenised once, and what is read more than once is kept."""
    table = cut(term_table(docs, id_col, text_col))
    found = postings(table)
    stats = corpus_stats(table)
    return KeywordIndex(found, cut(term_stats(found, stats)), stats)


def bm25_scores(index: KeywordIndex, questions: DataFrame, question_id: str, question_text: str) -> DataFrame:
    """query_id, id, score for every document that shares a term with the question.

    Only postings of the questions' terms go on; these are a batch of questions, small against the
    corpus, so that postings are met where they lie.  What moves is each posting once, however many
    questions have its term: a document's postings come together before they meet the questions.
    """
    asked = postings(term_table(questions, question_id, question_text)).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("times"))
    weights = cut(asked.join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")))
    hits = index.postings
    if weights.count() <= FEW_ROWS:
        weights = F.broadcast(weights)
        parts = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hits = hits.join(weights.select("term"), "term", "left_semi").repartition(parts, "id")
    scored = hits.join(weights, "term").join(F.broadcast(index.stats))
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean_length"))
    part = F.col("weight") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    return scored.groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


def ranked(scores: DataFrame, k: int, *order) -> DataFrame:
    """Rank 1..k within each query."""
    w = Window.partitionBy("query_id").orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_topk(index: KeywordIndex, questions: DataFrame, question_id: str, question_text: str, k: int) -> DataFrame:
    """query_id, id, score, rank: best first, ties in corpus order; cut to k, then positive scores only."""
    scores = bm25_scores(index, questions, question_id, question_text)
    return ranked(scores, k, F.desc("score"), F.asc("id")).filter("score > 0")
