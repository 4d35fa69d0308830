"""Incremental index builds: content keys, cache hits, merge, prune, guards, deduplication."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.lineage import only


def cache_key(model: Column | str, text: Column) -> Column:
    """Content address of a text under a model."""
    name = F.lit(model) if isinstance(model, str) else model
    return F.sha2(F.concat(name, F.char(F.lit(0)), text), 256)


def document_text(path: Column, language: Column, kind: Column, symbol: Column, code: Column) -> Column:
    """What both indexes see of a chunk."""
    return F.concat(path, F.lit("\n"), F.concat_ws(" ", language, kind, symbol), F.lit("\n\n"), code)


# Fixed value: what the public embedding models used here want before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
EMBED_BATCH = 64


@lru_cache(2)
def _model(load: Callable):
    """A loaded model, once a worker; the last two stay."""
    return load()


def embedder(load: Callable[[], Callable], text_col: str = "document", batch: int = EMBED_BATCH, prefix: str = "") -> Callable[[DataFrame], DataFrame]:
    """A function that adds ``vector``, of length 1, to rows with a text.

    ``load()`` gives a function from texts to a matrix; it runs on the workers, which load it at its first use.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for lo in range(0, len(texts), batch):
                rows = np.asarray(_model(load)([prefix + (t or "") for t in texts.iloc[lo : lo + batch]]), np.float32)
                norm = np.linalg.norm(rows, axis=1, keepdims=True)
                out += list(np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0))
            yield pd.Series(out, dtype=object)

    vectors = F.pandas_udf(run, "array<float>")
    return lambda rows: rows.withColumn("vector", vectors(F.col(text_col)))


def query_embedder(load: Callable[[], Callable], text_col: str = "question") -> Callable[[DataFrame], DataFrame]:
    return embedder(load, text_col, prefix=QUERY_PREFIX)


def chunk_id(path: Column, start: Column, end: Column, part: Column) -> Column:
    return F.format_string("%s:%d-%d#%d", path, start, end, part)


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str = "key", row: str | None = None) -> DataFrame:
    """Each key once that the cache lacks.  Where ``row`` names a column that tells the rows apart, only that and the key move."""
    if row is None:
        return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(row)) == 1
    known = cache.select(key, F.lit(True).alias("known")).distinct()
    flags = wanted.select(row, key).withColumn("first", first).join(known, key, "left")
    return only(wanted, flags.select(row, (F.col("first") & F.col("known").isNull()).alias("kept")), row)


def embed_with_cache(chunks: DataFrame, cache: DataFrame, embed, key: str = "key", row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, the cache with the new ones): each missing text is embedded once.

    ``embed(rows)`` adds a column ``vector``; ``row`` as in ``missing_keys``.
    """
    new = embed(missing_keys(chunks, cache, key, row)).select(key, "vector")
    full = cache.select(key, "vector").unionByName(new)
    return chunks.join(full, key), full


def cache_stats(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One row: total, computed (distinct missing), cached (rows that hit), hit_rate."""
    known = cache.select(key, F.lit(True).alias("hit")).distinct()
    rows = wanted.join(known, key, "left")
    hits = F.count("hit")
    return rows.agg(
        F.count("*").alias("total"),
        F.countDistinct(F.when(F.col("hit").isNull(), F.col(key))).alias("computed"),
        hits.alias("cached"),
        F.when(F.count("*") > 0, hits / F.count("*")).otherwise(F.lit(0.0)).alias("hit_rate"),
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win; old ones stay where no new one has their key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def prune(old: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return old.join(keep.select(key).distinct(), key, "left_semi")


def stale(old: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    return old.join(keep.select(key).distinct(), key, "left_anti")


def rebuild(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table after a build: ``new``, or ``old`` where the build found nothing (a guard against a wrong path)."""
    found = new.agg((F.count("*") > 0).alias("any"))
    kept = old.join(F.broadcast(found.filter("NOT any")))
    return new.unionByName(kept.drop("any"))


def dominant(rows: DataFrame, column: str, order: str) -> DataFrame:
    """The most frequent value; of equals the one seen first."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.orderBy(F.desc("n"), F.asc("first")).limit(1).select(column, "n")
