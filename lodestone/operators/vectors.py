"""Exact cosine search of a batch of query vectors against all rows, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are multiplied with a batch of rows at once.
BLOCK = 1024
#: Scores that are held at once, of a part of those queries if need be.
TILE = 1 << 20
#: Bytes of rows that are multiplied at once, if one row isn't longer.
ROW_BYTES = 16 << 20
#: Bytes of query vectors that one scan of the rows answers; more queries take more scans.
SCAN_BYTES = 64 << 20


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, queries) of the k best rows of each query, of equal scores those with the least ids."""
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k, axis=0)[len(ids) - k]
        query, row = np.nonzero((scores >= least).T)
    else:
        query, row = np.divmod(np.arange(scores.size), len(ids))
    order = np.lexsort((ids[row], -scores[row, query], query))
    row, query = row[order], query[order]
    first = np.searchsorted(query, query)
    kept = np.arange(len(query)) - first < k
    return row[kept], query[kept]


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a batch, ``ROW_BYTES`` of vectors at a time."""
    if len(batch):
        step = max(1, ROW_BYTES // (8 * max(1, len(batch["v"].iloc[0]))))
        for lo in range(0, len(batch), step):
            yield batch.iloc[lo : lo + step]


def _tiles(v: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> list[pd.DataFrame]:
    """query_id, id, score of the k best rows of each query, ``TILE`` scores at a time."""
    step, out = max(1, TILE // len(v)), []
    for lo in range(0, len(q), step):
        scores = np.round(v @ q[lo : lo + step].T, 9)
        row, query = _best(ids, scores, k)
        out.append(pd.DataFrame({"query_id": query_ids[lo + query], "id": ids[row], "score": scores[row, query]}))
    return out


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str | None = None, query_col: str | None = None
) -> DataFrame:
    """query_id, id, score, rank of the k most similar rows (of each group, if ``group_col`` is given).

    Query vectors go out up to ``SCAN_BYTES`` at a time; each Arrow batch of rows is multiplied with
    ``BLOCK`` of them at a time, in tiles of ``TILE`` scores, and keeps k rows a query (and group), so that
    what shuffles is k rows a query and batch at most and what a worker holds depends neither on the rows nor on the
    number of queries beyond those bounds.  ``query_col`` names the queries' ids where it is not ``id_col``.
    """
    key = query_col or id_col
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector_col).alias("v")).filter("v IS NOT NULL").orderBy("query_id")
    kinds = queries.schema[key].dataType.simpleString(), vectors.schema[id_col].dataType.simpleString()
    ids, rows, found, size = [], [], None, 0

    def scan() -> None:
        nonlocal found, size
        part = _scan(vectors, ids, rows, k, id_col, vector_col, group_col, kinds)
        found = part if found is None else found.union(part)
        ids.clear()
        rows.clear()
        size = 0

    for r in asked.toLocalIterator():
        ids.append(r["query_id"])
        rows.append(np.asarray(r["v"], dtype=np.float64))
        size += 8 * len(r["v"])
        if size >= SCAN_BYTES:
            scan()
    if ids or found is None:
        scan()
    keys = ["query_id"] + (["grp"] if group_col else [])
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _scan(vectors, ids, rows, k, id_col, vector_col, group_col, kinds):
    matrix = _unit(np.array(rows, dtype=np.float64)) if rows else np.zeros((0, 1))
    held = vectors.sparkSession.sparkContext.broadcast((np.array(ids), matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, q = held.value
        for batch in batches:
            for grp, whole in batch.groupby("grp", dropna=False) if group_col else ((0, batch),):
                for part in _slices(whole):
                    v, own = _unit(np.stack(part["v"].to_list()).astype(np.float64)), part["id"].to_numpy()
                    for lo in range(0, len(query_ids), BLOCK):
                        one = pd.concat(_tiles(v, own, query_ids[lo : lo + BLOCK], q[lo : lo + BLOCK], k), ignore_index=True)
                        yield one.assign(grp=grp) if group_col else one

    cols = [F.col(id_col).alias("id"), F.col(vector_col).alias("v")]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    if group_col:
        cols.append(F.col(group_col).cast("long").alias("grp"))
        schema += ", grp long"
    return vectors.select(*cols).filter(F.col("v").isNotNull()).mapInPandas(run, schema)
