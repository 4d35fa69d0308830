import random
import zlib

import numpy as np

from lodestone.llm import language
from tests.llm.fixtures import frame, messy_rows

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "eit", "ung", "ver"], "cc": ["ção", "nho", "lhe", "qua"], "dd": ["ый", "ова", "про", "ст"]}


def corpus(n=600, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60)))
        rows.append((i, text.capitalize(), lang, "s", len(text), *[None] * 5))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in language.query(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    right = total = 0
    for r in rows:
        got = found[r[0]]
        assert got["held_out"] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) and 0 <= got["score"] <= 1
        if got["held_out"]:
            total += 1
            right += got["lang_pred"] == r[2]
    assert total > 100 and right / total > 0.97


def test_prediction_uses_text_only(spark):
    rows = corpus(200)
    filters = language.fit(frame(spark, rows), "doc_id", "text", "lang")
    changed = [(9000 + r[0], r[1], None, None, None, *[None] * 5) for r in rows]
    a = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(frame(spark, rows), filters).collect())
    b = sorted((r["doc_id"] - 9000, r["lang_pred"], r["score"]) for r in language.identify(frame(spark, changed), filters).collect())
    assert a == b


def test_filters_hold_what_they_learned(spark):
    filters = language.fit(frame(spark, corpus(200)), "doc_id", "text", "lang")
    hashes, _ = language.ngrams("kalomitu kalo")
    a, b, c = language.slots(np.unique(hashes))
    found = filters.masks[a] & filters.masks[b] & filters.masks[c]
    assert (found & 1).mean() > 0.8 and all(fp < 0.01 for fp in filters.false_positives)


def test_messy_empty_and_untrained(spark):
    filters = language.fit(frame(spark, corpus(100)), "doc_id", "text", "lang")
    rows = messy_rows()
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, rows), filters).collect()}
    assert len(found) == len(rows)
    for r in rows:
        assert (found[r[0]] == "und") == (not any(ch.isalpha() for ch in r[1] or ""))
    assert language.identify(frame(spark, []), filters).count() == 0
    none = language.fit(frame(spark, []), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language.identify(frame(spark, rows), none).collect()} == {"und"}


def test_ngrams_stay_inside_words():
    brute = set()
    text = " ab cde "
    for n in language.ORDERS:
        for i in range(len(text) - n + 1):
            g = text[i : i + n]
            if " " not in g[1:-1]:
                brute.add(g)
    hashes, _ = language.ngrams("Ab, cde!")
    assert len(np.unique(hashes)) == len(brute)


def test_more_than_64_languages(spark):
    own = [chr(0x4E00 + 8 * i) + chr(0x4E01 + 8 * i) + chr(0x4E02 + 8 * i) for i in range(70)]
    rows = [(100 * i + j, f"{w}{w} {w}", f"l{i:02}", "s", 10, *[None] * 5) for i, w in enumerate(own) for j in range(2)]
    filters = language.fit(frame(spark, rows), "doc_id", "text", "lang")
    found = language.identify(frame(spark, rows), filters).collect()
    assert len(found) == 140 and all(r["lang_pred"] == f"l{r['doc_id'] // 100:02}" for r in found)


def test_columns_with_the_names_of_its_own(spark):
    filters = language.fit(frame(spark, corpus(100)), "doc_id", "text", "lang")
    docs = frame(spark, messy_rows(n=20)).selectExpr("*", "'x' AS language", "1 AS score", "'y' AS lang_pred", "2 AS __language")
    found = language.identify(docs, filters)
    assert found.columns == [c for c in docs.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    assert {r["language"] for r in found.collect()} == {"x"} and all(0 <= r["score"] <= 1 for r in found.collect())


def test_shares_equal_exact_sets(spark):
    """The corrected shares of the filters against sets of n-grams, which have no false positives."""
    rows = corpus(300)
    filters = language.fit(frame(spark, rows), "doc_id", "text", "lang")
    texts = {}
    for r in rows:
        if r[1] and r[2]:
            texts.setdefault(r[2], []).append(set(language.ngrams(r[1])[0].tolist()))
    sets = []
    for lang in filters.languages:
        count = {}
        for grams in texts[lang]:
            for g in grams:
                count[g] = count.get(g, 0) + 1
        n = len(texts[lang])
        sets.append({g for g, c in count.items() if c >= max(min(2, n), round(language.MIN_SHARE * n))})
    for r in rows[:60]:
        hashes, some = language.ngrams(r[1] or "")
        if some and len(hashes):
            want = [sum(h in s for h in hashes.tolist()) / len(hashes) for s in sets]
            assert np.allclose(filters.shares(hashes), want, atol=0.02)
