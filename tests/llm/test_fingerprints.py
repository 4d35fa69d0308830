import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import fingerprints as fp
from tests.llm.fixtures import frame, messy_rows


def brute(text, k, window):
    grams = [fp.gram_hashes(text[i : i + k], k)[0] for i in range(max(1, len(text) - k + 1))] if text else []
    low = np.uint64(fp.BLOCK)
    values = [g & ~low for g in grams]
    window = min(window, len(values))
    at = set()
    for i in range(len(values) - window + 1 if values else 0):
        part = values[i : i + window]
        at.add(i + max(j for j, v in enumerate(part) if v == min(part)))
    return sorted(at), [values[i] for i in sorted(at)]


@pytest.mark.parametrize("n", [0, 1, 3, 7, 8, 20, 200])
def test_winnow_equals_brute_force(n):
    rng = random.Random(n)
    for alphabet in ("ab", "abcdefgh é😀", "a"):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        for k, window in ((3, 4), (5, 7), (24, 41)):
            at, hashes = fp.winnow(text, k, window)
            want_at, want = brute(text, k, window)
            assert at.tolist() == want_at and hashes.tolist() == want


def test_long_text_crosses_blocks(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef") for _ in range(5000))
    whole = fp.winnow(text)
    monkeypatch.setattr(fp, "BITS", 9)
    monkeypatch.setattr(fp, "BLOCK", (1 << 9) - 1)
    at, _ = fp.winnow(text)
    assert len(at) > 150 and abs(len(at) - len(whole[0])) <= 2


def test_match_guarantee():
    rng = random.Random(5)
    common = "".join(rng.choice("abcdefghij ") for _ in range(fp.K + fp.WINDOW - 1))
    for _ in range(30):
        a, b = ("".join(rng.choice("klmnop") for _ in range(300)) for _ in range(2))
        _, x = fp.winnow(a[:150] + common + a[150:])
        _, y = fp.winnow(b[:70] + common + b[70:])
        assert set(x.tolist()) & set(y.tolist())


def test_rows_equal_brute_force(spark):
    rows = messy_rows()
    found = {r["doc_id"]: r for r in fp.fingerprint_documents(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    order = sorted(rows)
    for r, following in zip(order, order[1:] + order[:1], strict=True):
        text, nxt, got = r[1] or "", following[1] or "", found[r[0]]
        new = fp.edited(text, nxt)
        assert got["n_chars"] == len(text) and got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        sets = [set(fp.winnow(x)[1].tolist()) for x in (text, new, nxt)]
        like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
        assert got["near_edited"] == pytest.approx(like(sets[0], sets[1])) and got["near_next"] == pytest.approx(like(sets[0], sets[2]))
        assert got["fingerprint"] == fp.digest(*fp.winnow(text)) and got["edited_fingerprint"] == fp.digest(*fp.winnow(new))
    same = {}
    for r in rows:
        assert same.setdefault(r[1] or "", found[r[0]]["fingerprint"]) == found[r[0]]["fingerprint"]


def test_many_slices(spark, monkeypatch):
    monkeypatch.setattr(fp, "ROWS_PER_SLICE", 5)
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9), *[None] * 8) for i in range(101)]
    found = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprint_documents(frame(spark, rows)).collect()}
    order = sorted(rows)
    want = {a[0]: hashlib.sha256(fp.edited(a[1], b[1]).encode()).hexdigest() for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert found == want


def test_ties_single_and_empty(spark):
    assert fp.fingerprint_documents(frame(spark, [])).count() == 0
    (one,) = fp.fingerprint_documents(frame(spark, [(None, "alone in here", *[None] * 8)])).collect()
    assert one["near_next"] == 1.0 and one["doc_id"] is None
    rows = [(5, "b", *[None] * 8), (5, "a", *[None] * 8), (5, "b", *[None] * 8), (9, "c", *[None] * 8)]
    assert fp.fingerprint_documents(frame(spark, rows)).count() == 4
