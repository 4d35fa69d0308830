"""Toxicity by maximum-scoring segments over token log-odds.

Training: for each feature of a word (the word itself, and its beginnings of 4 to 8
letters, so that inflected and compound forms count) the log-odds between toxic and clean
training texts are taken under an informative Dirichlet prior, the pooled corpus; features
whose log-odds stand ``Z`` standard deviations above 0 are evidence.

Scoring: a word scores the largest log-odds among its evidence; a word without evidence
scores the log-likelihood ratio of having none, which is negative.  One linear scan finds
all maximal scoring segments.  A segment of score S in n words has the extreme-value
E-value K n exp(-lambda S), with lambda and K from the clean training texts; segments with an
E-value up to ``E_VALUE`` are the significant toxic passages.  A logistic function of the
best segment's and the summed calibrated scores, fitted on the training texts, gives the
document's score.

Defined results
---------------
* Null or empty texts, or texts without a word, get the score of no evidence at all.
* Without a toxic and a clean training text, every score is 0.
* Words are runs of letters, lower-cased; whole texts are scanned, however long.
* Repeated rows each get a row; repeated labels of an id count once, the largest label.
* An empty table gives an empty result.

Bounds: the model is fitted on at most about ``TRAIN_DOCS`` labelled texts, picked by a hash
of the id (labels are joined to texts by broadcasting that bounded sample).  Scoring is one
scan without a shuffle; what is broadcast is the evidence, which that bound limits too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.language import remainder
from lodestone.llm.shared import cut, fresh, release, spread, table

TRAIN_DOCS = 20_000
BEGINNINGS = (4, 5, 6, 7, 8)
MIN_TOXIC_DOCS = 4
Z = 4.0
E_VALUE = 0.05
CACHE_WORDS = 100_000
WORDS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) > k)]


def document_features(text: str) -> set[str]:
    return {f for w in set(WORDS.findall(text.lower())) for f in features(w)}


def maximal_segments(scores: list[float], starts: list[int], ends: list[int]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in linear time, of runs given left to right.

    Run i covers places starts[i] to ends[i] and scores scores[i] in all.  Returns (score,
    first place, last place) of each segment.
    """
    # each candidate: total before it, total at its end, first place, last place
    found: list[tuple[float, float, int, int]] = []
    # for each candidate, the nearest one to its left with a smaller total before it, as an index
    links: list[int] = []
    total = 0.0
    for score, start, end in zip(scores, starts, ends, strict=True):
        before, total = total, total + score
        if score <= 0:
            continue
        left, first = before, start
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j = links[j]
            if j < 0 or found[j][1] >= total:
                found.append((left, total, first, end))
                links.append(j)
                break
            left, first = found[j][0], found[j][2]
            del found[j:], links[j:]
    return [(r - a, first, last) for a, r, first, last in found]


class Model:
    def __init__(self, evidence: dict[str, float], background: float = -0.01):
        self.evidence, self.background = evidence, background
        self.rate, self.log_k, self.weights = 1.0, 0.0, None
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def word(self, word: str) -> float:
        """The word's largest log-odds, 0 without evidence."""
        if (s := self.cache.get(word)) is None:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            get = self.evidence.get
            s = self.cache[word] = max((get(f, 0.0) for f in features(word)), default=0.0)
        return s

    def hits(self, text: str) -> tuple[list[tuple[int, float]], int]:
        """(place, score) of the words with evidence; the number of words."""
        words, get, score = WORDS.findall(text.lower()), self.cache.get, self.word
        out = []
        for i, w in enumerate(words):
            s = get(w)
            if s is None:
                s = score(w)
            if s:
                out.append((i, s))
        return out, len(words)

    def segments(self, text: str) -> tuple[list[tuple[float, int, int]], int]:
        hits, n = self.hits(text)
        scores, places, last = [], [], -1
        for i, s in hits:
            if i > last + 1:
                scores.append((i - last - 1) * self.background)
                places.append((last + 1, i - 1))
            scores.append(s)
            places.append((i, i))
            last = i
        return maximal_segments(scores, [a for a, _ in places], [b for _, b in places]), n

    def summary(self, text: str | None) -> tuple[float, float, list[tuple[float, int, int, float]]]:
        """Calibrated best score, log of the summed significant ones, and the significant passages."""
        segments, n = self.segments(text or "")
        room = self.log_k + math.log(max(1, n))
        best = max((s for s, _, _ in segments), default=0.0)
        found = [(s, a, b, math.exp(min(700.0, room - self.rate * s))) for s, a, b in segments]
        found = [x for x in found if x[3] <= E_VALUE]
        return self.rate * best - room, math.log1p(sum(self.rate * x[0] for x in found)), found

    def score(self, best: float, total: float) -> float:
        if self.weights is None:
            return 0.0
        w = self.weights
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, w[0] + w[1] * best + w[2] * total))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    x, w = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * v[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of a bounded sample of the labelled rows."""
    known = labels.filter(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{label_col}`").cast("int").alias("toxic"))
    share = min(1.0, TRAIN_DOCS / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model of the texts of ``docs`` that ``labels`` marks."""
    rows = cut(training_rows(docs, labels, id_col, text_col, label_col))
    sc = docs.sparkSession.sparkContext

    def counts(only: set | None, toxic: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted = only.value if only is not None else None
            for batch in batches:
                c: Counter = Counter()
                for text in batch["text"]:
                    found = document_features(text)
                    c[""] += len(found)
                    c.update(found if wanted is None else found & wanted)
                if c:
                    yield pd.DataFrame({"feature": list(c), "n": list(c.values())})

        return rows.filter(F.col("toxic") == toxic).mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))

    often = {r["feature"]: r["n"] for r in counts(None, 1).filter((F.col("n") >= MIN_TOXIC_DOCS) | (F.col("feature") == "")).toLocalIterator()}
    in_toxic = often.pop("", 0)
    clean = {r["feature"]: r["n"] for r in counts(sc.broadcast(set(often)), 0).toLocalIterator()}
    in_clean = clean.pop("", 0)
    if not in_toxic or not in_clean:
        return Model({})
    evidence = {}
    for f, y in often.items():
        x = clean.get(f, 0)
        prior = in_toxic * (x + y) / (in_toxic + in_clean)
        odds = math.log((y + prior) / (2 * in_toxic - y - prior)) - math.log((x + prior) / (in_clean + in_toxic - x - prior))
        if odds / math.sqrt(1 / (y + prior) + 1 / (x + prior)) > Z:
            evidence[f] = odds
    model = Model(evidence)
    _calibrate(model, rows)
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(model)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            c: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                hits, n = held.value.hits(text)
                c[toxic, 0.0] += n - len(hits)
                c.update((toxic, round(s, 6)) for _, s in hits)
            yield pd.DataFrame([(t, s, n) for (t, s), n in c.items()], columns=["toxic", "value", "n"])

    sums = rows.mapInPandas(tally, "toxic int, value double, n long").groupBy("toxic", "value").agg(F.sum("n").alias("n"))
    dist: dict[int, dict[float, int]] = {0: {}, 1: {}}
    for r in sums.toLocalIterator():
        dist[int(r["toxic"] > 0)][r["value"]] = r["n"]
    none = [(dist[t].get(0.0, 0) + 1) / (sum(dist[t].values()) + 2) for t in (0, 1)]
    model.background = min(-1e-4, math.log(none[1] / none[0]))
    total = sum(dist[0].values()) or 1
    law = [(s or model.background, n / total) for s, n in dist[0].items()]

    def moment(rate: float) -> float:
        return sum(p * math.exp(min(700.0, rate * s)) for s, p in law) - 1

    lo, hi = 1e-6, 1e-6
    while hi < 64 and moment(hi) < 0:
        lo, hi = hi, hi * 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if moment(mid) < 0 else (lo, mid)
    model.rate = min(8.0, max(0.05, lo))
    held = sc.broadcast(model)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [held.value.summary(x)[:2] for x in batch["text"]]
            yield pd.DataFrame(found, columns=["best", "total"]).assign(toxic=batch["toxic"].to_numpy())

    # Gumbel location by its mean over clean texts
    first = rows.mapInPandas(look, "best double, total double, toxic int")
    mean = first.filter("toxic = 0").agg(F.avg("best")).first()[0]
    model.log_k = (mean or 0.0) - 0.5772156649
    held = sc.broadcast(model)
    seen = rows.mapInPandas(look, "best double, total double, toxic int").toPandas()  # TRAIN_DOCS rows at most
    model.weights = _logistic(seen[["best", "total"]].to_numpy(), (seen["toxic"] > 0).to_numpy(float))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned): score and passages.

    A passage has the characters from ``start`` up to ``end``, its log-odds score and E-value.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = held.value
        for texts in batches:
            scores, passages = [], []
            for text in texts:
                best, total, found = own.summary(text)
                scores.append(own.score(best, total))
                passages.append(_spans(text, found))
            yield pd.DataFrame({"score": scores, "passages": passages})
        own.cache.clear()  # the worker process lives on
        release()

    (name,) = fresh(docs, "toxicity")
    kind = "score double, passages array<struct<start:int,end:int,score:double,e_value:double>>"
    return docs.withColumn(name, F.pandas_udf(run, kind)(F.col(f"`{text_col}`"))), name


def _spans(text: str | None, found: list) -> list[dict]:
    if not found:
        return []
    places = [m.span() for m in WORDS.finditer(text)]
    out = []
    for score, first, last, e_value in found:
        first, last = min(first, len(places) - 1), min(last, len(places) - 1)
        out.append({"start": places[first][0], "end": places[last][1], "score": score, "e_value": e_value})
    return out


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    scored, name = score_documents(docs, model, text_col)
    return scored.filter(F.col(f"{name}.score") < threshold).drop(name)


def learn(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the labels, rows held out for tests left aside."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fit(docs, labels.filter(remainder("doc_id", 5) != 0))


def query(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scored, name = score_documents(docs, learn(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        F.col(f"{name}.score").alias("score"),
        F.when(F.col(f"{name}.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size(f"{name}.passages").alias("passages"),
    )
