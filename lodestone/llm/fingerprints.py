"""Document fingerprints by winnowing.

Every run of ``K`` code points gets a rolling polynomial hash, mixed; in every window of
``WINDOW`` neighbouring hashes the least is chosen, of equal ones the rightmost, and kept
with its position.  Two texts that share a run of ``K + WINDOW - 1`` code points share at
least one fingerprint.

Defined results
---------------
* Null text counts as empty; an empty text has no fingerprints.
* A text shorter than ``K`` has one fingerprint, of all of it, at position 0; one with fewer
  than ``WINDOW`` hashes has one window.
* Likeness is the Jaccard similarity of the sets of chosen hashes; of two texts without any
  it is 1, of one with and one without 0.
* Order is ascending by id, a null id first, equal ids by text; the last document is
  followed by the first, a single one by itself.  Equal rows each get a row.
* An empty table gives an empty result.

Scale: one shuffle of the texts, by id into slices of about ``ROWS_PER_SLICE`` rows.  The
first document of each slice also goes to the slice before it, so that every task has each
document's follower; rows stream through a task, two documents in memory at a time.  Per
slice, one id goes to the driver, for ``MAX_SLICES`` slices at most.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import table

K = 24
WINDOW = 41
ROWS_PER_SLICE = 2_000
MAX_SLICES = 131_072
BASE = 0x9E3779B97F4A7C15
BITS = 20
BLOCK = (1 << BITS) - 1
LOWEST = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def gram_hashes(text: str, k: int = K) -> np.ndarray:
    """Hashes of all runs of k code points; of the whole text, if it is shorter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(points):
        return points
    k = min(k, len(points))
    # hashes of runs of 1, 2, 4 ... code points, put together by the binary digits of k
    power, base, done, out, at = points, BASE, 0, None, 1
    n = len(points) - k + 1
    while True:
        if k & at:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(base) + part
            done += at
        if at * 2 > k:
            break
        power = power[:-at] * np.uint64(base) + power[at:]
        base, at = base * base % (1 << 64), at * 2
    return _mixed(out)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes chosen: the least of each window, the rightmost of equal ones."""
    hashes = gram_hashes(text, k)
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    window = min(window, n)
    places, low = [], np.uint64(BLOCK)
    for lo in range(0, n - window + 1, BLOCK - window):
        part = hashes[lo : min(n, lo + BLOCK - 1)]
        # the low bits hold the place, falling, so that the rightmost is the least of equals
        v = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        span = 1
        while span * 2 <= window:
            v, span = np.minimum(v[:-span], v[span:]), span * 2
        if span < window:
            v = np.minimum(v[: len(v) - (window - span)], v[window - span :])
        v = v[np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))]
        places.append((low - (v & low)).astype(np.int64) + lo)
        if lo + BLOCK - 1 >= n:
            break
    at = np.unique(np.concatenate(places))
    return at, hashes[at] & ~low


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(at: np.ndarray, hashes: np.ndarray) -> str:
    """Position and upper half of the hash of each fingerprint, as 16 hexadecimal digits."""
    return np.column_stack((at.astype(">u4"), (hashes >> np.uint64(32)).astype(">u4"))).astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _slices(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (okey, doc_id, text) dealt by okey: (slice, tail, ...) rows, tail marking the follower's copies."""
    n = docs.count()
    many = max(1, min(MAX_SLICES, n // ROWS_PER_SLICE))
    bounds = sorted(set(docs.stat.approxQuantile("okey", [i / many for i in range(1, many)], 0.2 / many))) if many > 1 else []
    bounds = [int(b) for b in bounds]

    @F.pandas_udf("int")
    def slice_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, dtype=np.int64), key.to_numpy(np.int64), side="right").astype("int32"))

    heads = [r[0] for r in docs.groupBy(slice_of("okey").alias("slice")).agg(F.min("okey").alias("first")).select("first").toLocalIterator()]
    used = sorted(heads)
    before = {h: bisect_right(bounds, used[i - 1]) for i, h in enumerate(used)}  # the first's goes to the last

    @F.pandas_udf("array<int>")
    def slices_of(key: pd.Series) -> pd.Series:
        at = np.searchsorted(np.array(bounds, dtype=np.int64), key.to_numpy(np.int64), side="right")
        return pd.Series([[int(a), before[k]] if k in before else [int(a)] for a, k in zip(at, key, strict=True)])

    dealt = docs.select("*", F.posexplode(slices_of("okey")).alias("tail", "slice"))
    return dealt.repartition("slice").sortWithinPartitions("slice", "tail", "okey", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and their likeness and its follower's."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("okey"),
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, current, out = None, None, []
        for batch in batches:
            for piece, tail, doc, text in zip(batch["slice"], batch["tail"], batch["doc_id"], batch["text"], strict=True):
                if piece != current:
                    held, current = None, piece
                if tail and held is None:
                    continue
                at, hashes = winnow(text, k, window)
                now = (doc, text, digest(at, hashes), np.unique(hashes))
                if held is not None:
                    out.append(_row(held, now, k, window))
                held = None if tail else now
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))]
    return _slices(rows).select("slice", "tail", "doc_id", "text").mapInPandas(run, f"doc_id {kind}, {SCHEMA}")


def _row(held, now, k, window):
    doc, text, print_, own = held
    new = edited(text, now[1])
    at, hashes = winnow(new, k, window)
    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return doc, len(text), sha, print_, digest(at, hashes), likeness(own, np.unique(hashes)), likeness(own, now[3])


def query(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))
