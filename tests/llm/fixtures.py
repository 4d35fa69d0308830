"""Small tables with the cases that every operator must stand."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, __sha string, node string, slot int, toxic int"
VOCABULARY = [a + b for a in ("ba", "ko", "tri", "zen", "mul", "ver") for b in ("do", "na", "si", "lum", "pex", "qua", "ro")]


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def messy_rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, equal texts, near copies, odd characters."""
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = [None, "", "   ", "\n\n", "x", "É", "é", "HELLO World", "hello world", "hello  world", "123 456", "<|endoftext|> a <|startoftext|>", "\x00\x01", "😀 😀"]
    texts += [base, base, base.upper()]
    for _ in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts.append(words(rng, 30_000))
    texts.append("a" * 200_000)
    while len(texts) < n:
        texts.append(words(rng, rng.randrange(1, 90)))
    rows = []
    for i, t in enumerate(texts):
        lang = [None, "en", "fr"][i % 3]
        source = [None, "s1", "s2", "s3", "s2"][i % 5]
        rows.append((i * 3, t, lang, source, None if t is None else len(t), i, "s", None, i, i % 2))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def write_tables(spark, folder, rows, labels=()):
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)
