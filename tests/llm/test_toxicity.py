import math
import random
import zlib
from collections import Counter

from lodestone.llm import toxicity
from tests.llm.fixtures import frame, messy_rows, words

BAD = ["grubwort", "snarkle", "vexhund"]


def labelled(n=700, seed=4):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        text, toxic = words(rng, rng.randrange(5, 150)), int(rng.random() < 0.25)
        if toxic:
            w = text.split()
            at = rng.randrange(len(w))
            for _ in range(rng.randrange(2, 5)):
                w.insert(min(len(w), at + rng.randrange(3)), rng.choice(BAD) + rng.choice(["", "s", "ing"]))
            text = " ".join(w)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def brute_segments(scores):
    """All maximal segments by their definition: best segment, then left and right of it."""
    best = max(((sum(scores[i : j + 1]), -i, j) for i in range(len(scores)) for j in range(i, len(scores))), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    top = best[0]
    ties = [(i, j) for i in range(len(scores)) for j in range(i, len(scores)) if abs(sum(scores[i : j + 1]) - top) < 1e-9]
    i, j = min(ties, key=lambda x: (x[1] - x[0], x[0]))
    shift = lambda part, by: [(s, a + by, b + by) for s, a, b in part]
    return brute_segments(scores[:i]) + [(top, i, j)] + shift(brute_segments(scores[j + 1 :]), j + 1)


def test_segments_equal_their_definition():
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice([-3.1, -2.3, -1.7, 1.13, 2.29, 3.57]) + rng.random() / 7 for _ in range(rng.randrange(0, 14))]
        places = list(range(len(scores)))
        got = toxicity.maximal_segments(scores, places, places)
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert all(abs(x[0] - y[0]) < 1e-9 for x, y in zip(got, want, strict=True))


def test_model_equals_its_formulas(spark):
    """Log-odds, background, rate, location and weights against their definitions, counted in plain Python."""
    rows, labels = labelled(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    toxic = {i: t for i, _, t in labels}
    count = {0: Counter(), 1: Counter()}
    for i, text, *_ in rows:
        count[toxic[i]].update(toxicity.document_features(text))
    total = {t: sum(c.values()) for t, c in count.items()}
    want = {}
    for f, y in count[1].items():
        if y < toxicity.MIN_TOXIC_DOCS:
            continue
        x = count[0][f]
        prior = total[1] * (x + y) / (total[0] + total[1])
        a, b = (y + prior) / (2 * total[1] - y - prior), (x + prior) / (total[0] + total[1] - x - prior)
        odds, sd = math.log(a) - math.log(b), math.sqrt(1 / (y + prior) + 1 / (x + prior))
        if odds / sd > toxicity.Z:
            want[f] = odds
    assert model.evidence.keys() == want.keys() and all(abs(model.evidence[f] - want[f]) < 1e-9 for f in want)
    words = {0: [], 1: []}
    for i, text, *_ in rows:
        words[toxic[i]] += [model.word(w) for w in toxicity.WORDS.findall(text.lower())]
    none = [(sum(s == 0 for s in words[t]) + 1) / (len(words[t]) + 2) for t in (0, 1)]
    assert abs(model.background - min(-1e-4, math.log(none[1] / none[0]))) < 1e-9
    moment = lambda rate: sum(math.exp(rate * (round(s, 6) or model.background)) for s in words[0]) / len(words[0])
    assert model.rate in (0.05, 8.0) or abs(moment(model.rate) - 1) < 1e-6
    flat = toxicity.Model(model.evidence, model.background)
    flat.rate, flat.log_k = model.rate, 0.0
    best = [flat.summary(text)[0] for i, text, *_ in rows if not toxic[i]]
    assert abs(model.log_k - (sum(best) / len(best) - 0.5772156649)) < 1e-6
    seen = [(*model.summary(text)[:2], toxic[i]) for i, text, *_ in rows]
    slope = [0.0, 0.0, 0.0]
    for b, t, y in seen:
        p = 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * b + model.weights[2] * t)))
        for k, v in enumerate((1.0, b, t)):
            slope[k] += (y - p) * v
    assert all(abs(g - 1e-2 * w) < 1e-3 for g, w in zip(slope, model.weights, strict=True))


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = labelled()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: r for r in toxicity.query(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    held = [(found[i], t) for i, _, t in labels if found[i]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert len(held) > 80 and sum(r["predicted"] == t for r, t in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found.values())


def test_passages_mark_the_words(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text = "calm words here " * 30 + "you grubwort vexhund snarkle now " + "and calm again " * 30
    scored, name = toxicity.score_documents(frame(spark, [(1, text, *[None] * 8)]), model)
    (passage,) = scored.select(f"{name}.passages").first()[0]
    assert text[passage["start"] : passage["end"]] == "grubwort vexhund snarkle" and passage["e_value"] < 0.05


def test_messy_and_empty(spark):
    rows, labels = labelled(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([*labels, (3, None, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    messy = frame(spark, messy_rows())
    kept = toxicity.drop_toxic(messy, model)
    assert kept.columns == messy.columns and kept.count() == messy.count()
    assert toxicity.drop_toxic(frame(spark, []), model).count() == 0
    none = toxicity.fit(docs, marks.limit(0))
    scored, name = toxicity.score_documents(messy, none)
    assert {r[0] for r in scored.select(f"{name}.score").collect()} == {0.0}
