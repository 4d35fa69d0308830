"""Language identification with language-bitmask n-gram Bloom filters.

The filter is bit-sliced: each slot holds a mask with one bit a language, so that one
lookup of an n-gram's slots, and-ed, gives all the languages whose filter contains it.  A
text's n-grams (3 to 5 characters within word bounds) vote: each language's popcount is
corrected for the share of false positives that its fill lets expect, and the language
with the largest corrected share is chosen.

A language's filter holds the n-grams that occur in at least ``MIN_SHARE`` of its training
texts (two at least where it has that many), which leaves out names and foreign passages.

Defined results
---------------
* Null text, or text without any letter: ``und``, score 0.
* Training rows without language or text teach nothing; without any training row every
  prediction is ``und``.
* Ties go to the language that comes first by code point.
* Letters but no known n-gram: the language with most training texts, score 0.
* Repeated rows each get a row; an empty table gives an empty result.

Bounds: the filter is fitted on at most about ``TRAIN_DOCS`` texts of each language, picked
by a hash of the id; it has ``SLOTS`` slots of as many bits as languages (8 to 64, or a page of 64
for every 64 of them), 8 MB a page, and is the only thing broadcast.  Prediction is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, fresh, spread, table

ORDERS = (3, 4, 5)
SLOTS = 1 << 20
HASHES = 3
TRAIN_DOCS = 4_000
MIN_SHARE = 0.01
#: Languages that the bits of one mask hold.
PAGE = 64
UNDETERMINED = "und"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of all n-grams of the lower-cased text within words, each as often as it occurs; any letter?"""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    mask = letters()[points]
    if not mask.any():
        return np.empty(0, np.uint64), False
    points = np.where(mask, points, 0).astype(np.uint64)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)  # runs of other characters become one bound
    points = np.concatenate(([0], points[keep], [0])).astype(np.uint64)
    bound = np.concatenate(([0], np.cumsum(points == 0)))
    out, base = [], np.uint64(0x100000001B3)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + m]) * base
            h ^= h >> np.uint64(29)
        inside = bound[n - 1 : n - 1 + m] == bound[1 : 1 + m]  # no bound between the first and the last
        out.append(h[inside])
    return np.concatenate(out) if out else np.empty(0, np.uint64), True


def slots(hashes: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [((hashes ^ (hashes >> np.uint64(31))) * np.uint64(m)) >> shift for m in MULTIPLIERS[:HASHES]]


class Filters:
    """The bit-sliced filter of all languages: one mask a slot, or a row of 64-bit masks beyond 64 languages."""

    def __init__(self, languages: list[str], masks: np.ndarray, most: int):
        self.languages, self.masks, self.most = languages, masks, most
        fill = [float(self.bit(masks, i).mean()) for i in range(len(languages))]
        self.false_positives = np.array(fill) ** HASHES

    @staticmethod
    def bit(masks: np.ndarray, i: int) -> np.ndarray:
        page = masks if masks.ndim == 1 else masks[:, i // PAGE]
        return (page >> page.dtype.type(i % PAGE)) & page.dtype.type(1)

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """Of the n-grams, the corrected share in each language's filter."""
        a, b, c = slots(hashes)
        found = self.masks[a] & self.masks[b] & self.masks[c]
        hits = np.array([np.count_nonzero(self.bit(found, i)) for i in range(len(self.languages))])
        fp = self.false_positives
        return np.clip((hits / len(hashes) - fp) / np.maximum(1e-9, 1 - fp), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        hashes, any_letter = ngrams(text)
        if not any_letter:
            return UNDETERMINED, 0.0
        if not len(hashes):
            return self.languages[self.most], 0.0
        share = self.shares(hashes)
        best = int(share.argmax())
        if share[best] == 0:
            return self.languages[self.most], 0.0
        others = np.delete(share, best)
        second = float(others.max()) if len(others) else 0.0
        return self.languages[best], float(share[best] / (share[best] + second))


def fit(train: DataFrame, id_col: str, text_col: str, lang_col: str) -> Filters:
    """Filters learned from the rows of ``train`` that have a text and a language."""
    rows = train.select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros(SLOTS, np.uint8), 0)
    share: Column = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, TRAIN_DOCS / n)).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    index = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                for lang, texts in part.groupby("lang")["text"]:
                    found = [np.unique(ngrams(x)[0]) for x in texts]
                    grams, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"lang": np.full(len(grams), index[lang], "int32"), "gram": grams.view(np.int64), "n": n.astype("int64")})
                    yield pd.DataFrame({"lang": np.array([index[lang]], "int32"), "gram": np.array([0]), "n": np.array([len(texts)])})

    sums = cut(picked.select("text", "lang").mapInPandas(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    used = {r["lang"]: r["n"] for r in sums.filter("gram = 0").toLocalIterator()}
    least: Column = F.lit(1)
    for lang, n in used.items():
        least = F.when(F.col("lang") == lang, max(min(2, n), round(MIN_SHARE * n))).otherwise(least)

    @F.pandas_udf("array<int>")
    def slots_of(gram: pd.Series) -> pd.Series:
        return pd.Series(list(np.column_stack(slots(gram.to_numpy(np.int64).view(np.uint64))).astype("int32")))

    taken = sums.filter((F.col("gram") != 0) & (F.col("n") >= least)).select("lang", F.explode(slots_of("gram")).alias("slot"))
    by_slot = taken.groupBy("slot", F.expr(f"lang div {PAGE}").alias("page")).agg(F.bit_or(F.expr(f"shiftleft(1L, lang % {PAGE})")).alias("mask"))
    pages = by_slot.groupBy("page", F.expr(f"slot div {SLOTS // 64}")).agg(F.collect_list("slot").alias("slots"), F.collect_list("mask").alias("masks"))
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= min(PAGE, len(languages)))
    masks = np.zeros((SLOTS, -(-len(languages) // PAGE)), width)
    for page in pages.toLocalIterator():  # for every 64 languages, 64 pages of SLOTS / 64 slots at most
        masks[np.array(page["slots"]), page["page"]] = np.array(page["masks"], np.int64).view(np.uint64).astype(width)
    masks = masks[:, 0] if len(languages) <= PAGE else masks
    return Filters(languages, masks, index[max(sorted(counts), key=counts.get)])


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred and score added (names after ``prefix``); columns of ``docs`` with these names go."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(x) for x in texts], columns=["lang_pred", "score"])

    (at,) = fresh(docs, "language")
    new = [f"{prefix}lang_pred", f"{prefix}score"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in (n.lower() for n in new)]
    found = docs.withColumn(at, predict(F.col(f"`{text_col}`")))
    return found.select(*kept, F.col(f"{at}.lang_pred").alias(new[0]), F.col(f"{at}.score").alias(new[1]))


def remainder(id_col: str, n: int) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % n


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    filters = fit(docs.filter(~held_out), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", held_out.alias("held_out")), filters)
    return found.select("doc_id", "held_out", "lang_pred", "score")
