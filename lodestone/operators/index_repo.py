"""Whole index builds over Parquet tables: chunks, vectors, embedding cache and keyword postings of one repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.lineage import cut, only
from lodestone.operators import bm25
from lodestone.operators import index_build as ib
from lodestone.operators.chunking import CHUNK_SCHEMA
from lodestone.operators.ingest import ingest
from lodestone.operators.retrieval import Index
from lodestone.sources.files import current_version, read_or_empty, scan_tree, write_version

CACHE = "key string, model string, vector array<float>"
VECTORS = "chunk_id string, model string, vector array<float>"


class MissingIndexError(LookupError):
    """The repository has no index."""


@dataclass(frozen=True)
class IndexStats:
    chunks: int
    computed: int
    cached: int
    pruned: int
    hit_rate: float


def document() -> Column:
    """What both indexes see of a chunk; it is made of the chunk's columns where it is read."""
    return ib.document_text(F.col("file_path"), F.col("language"), F.col("kind"), F.col("symbol"), F.col("code"))


def with_keys(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks, one a chunk id (the first wins), with chunk_id, cache key, row (its number) and document text.

    Texts stay where they are: rows that another one has the chunk id of are found by their columns
    besides the text.
    """
    name = ib.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("part"))
    rows = cut(chunks.withColumns({"chunk_id": name, "key": ib.cache_key(model, document()), "row": F.monotonically_increasing_id()}))
    w = Window.partitionBy("chunk_id").orderBy("file_path", "start_line", "symbol", "row")
    flags = rows.select("chunk_id", "file_path", "start_line", "symbol", "row").select("row", (F.row_number().over(w) == 1).alias("kept"))
    return only(rows, flags, "row").withColumn("document", document())


def build_index(spark: SparkSession, chunks: DataFrame, folder: str, model: str, embed, dimension: int | None = None) -> IndexStats:
    """(Re)builds the tables under ``folder``.  ``embed(rows)`` adds ``vector`` to rows with ``document``.

    Texts that the cache has under this model (and of this dimension) are not embedded again; vectors of
    chunks that are gone are pruned; those of another model are dropped.  A build that finds no chunk while
    the index has some keeps the index.  The tables are published together, see ``write_version``.
    """
    new = with_keys(chunks, model)
    there = current_version(spark, folder) or f"{folder}/none"
    old = read_or_empty(spark, f"{there}/vectors", VECTORS).filter(F.col("model") == model)
    cache = read_or_empty(spark, f"{there}/cache", CACHE).filter(F.col("model") == model)
    if dimension is not None:
        cache = cache.filter(F.size("vector") == dimension)
    total = new.count()
    if total == 0 and not old.isEmpty():
        return IndexStats(0, 0, 0, 0, 0.0)
    stats = ib.cache_stats(new, cache).first()
    rows, full = ib.embed_with_cache(new, cache, embed, row="row")
    full = cut(full.withColumn("model", F.lit(model)).select("key", "model", "vector"))
    vectors = new.join(full, "key").select("chunk_id", "model", "vector")
    pruned = ib.stale(old, new, "chunk_id").count()
    keyword = bm25.build_index(new, "chunk_id", "document")
    by_term = keyword.postings.repartitionByRange("term").sortWithinPartitions("term")  # a term's postings lie together
    tables = {"cache": full, "vectors": vectors, "chunks": new.drop("key", "row", "document"), "postings": by_term, "terms": keyword.terms, "stats": keyword.stats}
    write_version(spark, folder, tables)
    return IndexStats(total, stats["computed"], stats["cached"], pruned, stats["hit_rate"])


def index_tree(spark: SparkSession, root: str, folder: str, model: str, embed) -> IndexStats:
    """A repository's tree into both indexes: scan, chunks of code and documents, vectors, postings."""
    return build_index(spark, ingest(scan_tree(spark, root)), folder, model, embed)


TABLES = {
    "chunks": f"{CHUNK_SCHEMA}, chunk_id string",
    "vectors": VECTORS,
    "postings": "id string, length int, term string, tf int",
    "terms": "term string, df long, idf double",
    "stats": "docs long, mean_length double",
}


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of an index; MissingIndexError where there is none.  Tables that cannot be read are empty."""
    there = current_version(spark, folder)
    if there is None:
        raise MissingIndexError(folder)
    tables = {name: read_or_empty(spark, f"{there}/{name}", schema) for name, schema in TABLES.items()}
    return tables | {"chunks": tables["chunks"].withColumn("document", document())}


def open_index(spark: SparkSession, folder: str) -> Index:
    """A stored index as the retrievers read it: stored postings and terms rank, nothing is tokenised again."""
    tables = load_index(spark, folder)
    keyword = bm25.KeywordIndex(tables["postings"], tables["terms"], tables["stats"])
    chunks = tables["chunks"]
    # rerankers see a chunk without its language
    text = F.concat(F.col("file_path"), F.lit("\n"), F.concat_ws(" ", "kind", "symbol"), F.lit("\n"), F.col("code"))
    return Index(keyword, tables["vectors"].select(F.col("chunk_id").alias("id"), "vector"), chunks.select(F.col("chunk_id").alias("id"), text.alias("text")))
