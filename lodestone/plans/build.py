"""Queries: cache keys, hits and misses, merge, prune, guards, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import index_build as ib
from lodestone.plans.registry import register, table
from lodestone.sources.files import collection_name


def documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@register("cache_key", "SELECT doc_id, sha256('model-a' || chr(0) || text) AS key FROM documents")
def cache_key(spark, d):
    return documents(spark, d).select("doc_id", ib.cache_key("model-a", F.col("text")).alias("key"))


@register(
    "embed_cache_hit_miss",
    """WITH k AS (SELECT doc_id, lang, sha256('m' || chr(0) || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE lang = 'en')
SELECT count(*) AS total, count(DISTINCT CASE WHEN c.key IS NULL THEN k.key END) AS computed, count(c.key) AS cached, round(count(c.key)::DOUBLE / count(*), 6) AS hit_rate
FROM k LEFT JOIN c USING (key)""",
)
def embed_cache_hit_miss(spark, d):
    keys = documents(spark, d).select("doc_id", "lang", ib.cache_key("m", F.col("text")).alias("key"))
    cache = keys.filter("lang = 'en'").select("key").distinct()
    return ib.cache_stats(keys, cache).withColumn("hit_rate", F.round("hit_rate", 6))


@register(
    "upsert_merge",
    """WITH o AS (SELECT doc_id, n_chars, 'old' AS origin FROM documents WHERE lang IN ('en', 'fr')), n AS (SELECT doc_id, n_chars + 1 AS n_chars, 'new' AS origin FROM documents WHERE lang IN ('fr', 'de'))
SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING (doc_id)""",
)
def upsert_merge(spark, d):
    docs = documents(spark, d)
    old = docs.filter("lang IN ('en', 'fr')").select("doc_id", "n_chars", F.lit("old").alias("origin"))
    new = docs.filter("lang IN ('fr', 'de')").select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit("new").alias("origin"))
    return ib.upsert(old, new, "doc_id")


@register(
    "prune_stale",
    """SELECT d.doc_id, d.source, l.doc_id IS NULL AS stale FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def prune_stale(spark, d):
    docs, keep = documents(spark, d).select("doc_id", "source"), table(spark, d, "labels")
    kept = ib.prune(docs, keep, "doc_id").withColumn("stale", F.lit(False))
    return kept.unionByName(ib.stale(docs, keep, "doc_id").withColumn("stale", F.lit(True)))


@register("guard_empty", "SELECT doc_id, lang FROM documents WHERE lang <> 'en'")
def guard_empty(spark, d):
    """A build that found nothing keeps the old table."""
    old = documents(spark, d).filter("lang <> 'en'").select("doc_id", "lang")
    return ib.rebuild(old, old.filter("lang = 'none'"), "doc_id")


@register(
    "dedupe_first_wins",
    "SELECT doc_id, md5(text) AS text_md5 FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1",
)
def dedupe_first_wins(spark, d):
    found = ib.first_wins(documents(spark, d).withColumn("text_md5", F.md5("text")).select("doc_id", "text_md5"), ["text_md5"], ["doc_id"])
    return found


@register("dominant_language", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1")
def dominant_language(spark, d):
    return ib.dominant(documents(spark, d), "lang", "doc_id")


@register(
    "chunk_identity",
    """SELECT doc_id, 'src/doc' || doc_id || '.md:1-' || n_chars || '#1' AS chunk_id,
md5('src/doc' || doc_id || '.md' || chr(10) || lang || ' doc ' || source || chr(10) || chr(10) || text) AS text_md5 FROM documents""",
)
def chunk_identity(spark, d):
    path = F.concat(F.lit("src/doc"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = ib.document_text(path, F.col("lang"), F.lit("doc"), F.col("source"), F.col("text"))
    return documents(spark, d).select("doc_id", ib.chunk_id(path, F.lit(1), F.col("n_chars"), F.lit(1)).alias("chunk_id"), F.md5(text).alias("text_md5"))


@register(
    "collection_names",
    """SELECT DISTINCT source, 'repo_' || left(regexp_replace(regexp_replace(lower('Org/' || source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 40) || '_' || left(sha256('Org/' || source), 8) AS name FROM documents""",
)
def collection_names(spark, d):
    name = F.concat(F.lit("Org/"), F.col("source"))
    return documents(spark, d).select("source").distinct().select("source", collection_name(name).alias("name"))
