import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import token_counts
from tests.llm.fixtures import frame, messy_rows


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.VOCABULARY))


def test_counts_equal_the_library(spark, library):
    rows = messy_rows()
    found = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for r in rows:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        got = found[r[0]]
        assert got["n_tokens"] == n and got["over_limit"] == (n > 2048) and got["n_bytes"] == len((r[1] or "").encode())


def test_random_unicode(library):
    rng = random.Random(8)
    count = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    pool = ["<|endoftext|>", "ΑΣ", "Σ", " \x1c", "İ", "é", "é", "'LL", "'s", "12", "ß", "👩‍👩", " ", "\x85", "<|", "a", "The ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 14)))
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_code_point_in_context(library):
    """After a joiner, a dotted capital I, a letter and a digit; planes without any character by samples."""
    count = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c % 97 == 0)]
    for lo in range(0, len(points), 20_000):
        texts = [f"\u200d{chr(c)} \u0130{chr(c)} a{chr(c)} 1{chr(c)}" for c in points[lo : lo + 20_000]]
        want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [count(t) for t in texts] == want


def test_characters_split_here(library):
    """Runs of the characters that the operator splits itself."""
    rng = random.Random(5)
    count = token_counts.counter(public_tokenizers.path(token_counts.VOCABULARY))
    pool = [chr(c) for c in [*range(0x130), *range(0x131, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC]]
    for _ in range(5000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(1, 30)))
        assert not count.other.search(text)
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 10)
    count = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    count(" ".join(f"w{chr(97 + i % 26)}{'x' * (i % 40)}" for i in range(500)))
    assert len(count.merger.counts) <= 10


def test_empty(spark):
    assert token_counts.count_tokens(frame(spark, [])).count() == 0
