import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import line_dedup as ld
from tests.llm.fixtures import frame, messy_rows, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(line):
    for c in "\t\x0b\x0c\r":
        line = line.replace(c, " ")
    return {w for w in line.translate(LOW).split(" ") if w}


def brute(rows, percent=80):
    """(doc, line) that go: those with an earlier match."""
    seen, gone = [], set()
    for r in sorted(rows):
        for i, line in enumerate((r[1] or "").split("\n")):
            s = tokens(line)
            if s and any(100 * len(s & t) >= percent * len(s | t) for t in seen):
                gone.add((r[0], i))
            if s:
                seen.append(s)
    return gone


def near_lines(seed=3, docs=60):
    """Lines that many documents share, whole or with words changed, and one very common line."""
    rng = random.Random(seed)
    common, base = "the one very common line of all", [words(rng, rng.randrange(4, 40)).split() for _ in range(6)]
    rows = []
    for i in range(docs):
        lines = [common] if rng.random() < 0.7 else []
        for b in base:
            w = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            lines.append(" ".join(w))
        lines += [words(rng, rng.randrange(0, 12)) for _ in range(2)]
        rng.shuffle(lines)
        rows.append((500 + i, "\n".join(lines), *[None] * 8))
    return rows


@pytest.mark.parametrize("short", [64, 3])
def test_removed_lines_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(ld, "LONG", int(8 * np.log2(1 + short)))
    rows = messy_rows(n=50) + near_lines()
    found = ld.dedup_lines(frame(spark, rows)).collect()
    texts = {r[0]: (r[1] or "").split("\n") for r in rows}
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["n_lines"] for r in found} == {d: len(t) for d, t in texts.items()}
    got = {(r["doc_id"], x["line"]) for r in found for x in r["removed"]}
    assert got == brute(rows) and all(r["n_removed"] == len(r["removed"]) for r in found)
    for r in found:
        for x in r["removed"]:
            assert (x["match_doc"], x["match_line"]) < (r["doc_id"], x["line"])
            a, b = tokens(texts[r["doc_id"]][x["line"]]), tokens(texts[x["match_doc"]][x["match_line"]])
            assert 100 * len(a & b) >= 80 * len(a | b)


def brute_links(rows, percent=80):
    """(class, number of links) of each line whose class has another line or a link."""
    first, own = {}, {}
    for r in sorted(rows):
        for i, line in enumerate((r[1] or "").split("\n")):
            if s := frozenset(tokens(line)):
                own[r[0], i] = first.setdefault(s, (r[0], i))
    sets = {place: s for s, place in first.items()}
    many = {p: sum(p != q and 100 * len(s & t) >= percent * len(s | t) for q, t in sets.items()) for p, s in sets.items()}
    size = Counter(own.values())
    return {p: (*c, many[c]) for p, c in own.items() if size[c] > 1 or many[c]}


def linked(found):
    return {(r["doc_id"], x["line"]): (x["class_doc"], x["class_line"], x["n_links"]) for r in found.collect() for x in r["linked"]}


def test_all_links_of_three_lines(spark):
    w = [f"w{i}" for i in range(20)]
    a, b, c = (" ".join([*w, *more]) for more in (["p"], ["q"], ["r"]))
    found = linked(ld.dedup_lines(frame(spark, [(i, t, *[None] * 8) for i, t in enumerate((a, b, c, a, "alone"))])))
    assert found == {(0, 0): (0, 0, 2), (1, 0): (1, 0, 2), (2, 0): (2, 0, 2), (3, 0): (0, 0, 2)}


def test_repeated_rows_count_as_one(spark):
    rows = [(1, "a b c d e f g h i one", *[None] * 8)] + [(2, "a b c d e f g h i two", *[None] * 8)] * 3
    assert linked(ld.dedup_lines(frame(spark, rows))) == {(1, 0): (1, 0, 1), (2, 0): (2, 0, 1)}


@pytest.mark.parametrize("short", [64, 3])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, short):
    monkeypatch.setattr(ld, "LONG", int(8 * np.log2(1 + short)))
    monkeypatch.setattr(ld, "SHORT", short)
    monkeypatch.setattr(ld, "CELL", 2 * short)
    monkeypatch.setattr(ld, "FEW", 8 if short > 8 else 2)
    rows = messy_rows(n=50) + near_lines()
    want = brute_links(rows)
    assert max(n for *_, n in want.values()) > 2
    assert linked(ld.dedup_lines(frame(spark, rows))) == want


def test_one_word_in_most_lines(spark, monkeypatch):
    monkeypatch.setattr(ld, "LONG", int(8 * np.log2(1 + 8)))
    monkeypatch.setattr(ld, "SHORT", 8)
    rng = random.Random(12)
    rows = []
    for i in range(150):
        few = rng.sample(["common", "frequent", "usual", "often", "daily", "plain"], rng.randrange(4, 7))
        rows.append((i, " ".join([*few, *(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 3)))]), *[None] * 8))
    assert linked(ld.dedup_lines(frame(spark, rows))) == brute_links(rows)


def test_texts_keep_first_lines(spark):
    rows = [(1, "alpha beta gamma\n\nunique one here", *[None] * 8), (2, "ALPHA beta gamma\nnew line\n", *[None] * 8), (3, None, *[None] * 8)]
    docs = frame(spark, rows)
    found = ld.drop_duplicate_lines(docs)
    assert found.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in found.collect()} == {1: "alpha beta gamma\n\nunique one here", 2: "new line\n", 3: None}


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "one two three four", *[None] * 8), (4, "one two three four", *[None] * 8), (4, "one two three four", *[None] * 8)]
    found = ld.dedup_lines(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in found) == [(False, 1), (False, 1), (True, 0)]
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_hashes_split_words_as_stated():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\t\rÉé\x0b") for _ in range(rng.randrange(0, 60)))
        ((_, lines, buffer),) = list(ld.buffers([text]))
        h, line = ld._hashed(buffer)
        want = [(i, w) for i, x in enumerate(text.split("\n")) for w in x.encode().lower().split()]
        assert line.tolist() == [i for i, _ in want] and lines.tolist() == [text.count("\n") + 1]
        same = {}
        for (_, w), x in zip(want, h.tolist(), strict=True):
            assert same.setdefault(w, x) == x
        assert len(set(same.values())) == len(same)
    assert np.array_equal(ld._hashed(b"x ab y\n")[0][1:2], ld._hashed(b"ab\n")[0])
