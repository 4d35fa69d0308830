"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised and split into words as the vocabulary file says (canonical
composition, white space dropped, lower case; a run of letters, one digit, or a run of
other characters a word).  Which characters are letters, digits or white space, and their
lower case and composition, differ between versions of Unicode, so that only texts of ``PLAIN``
characters, where all versions agree, are split here; the others are normalised and split by
the vocabulary's own library.  A word's symbols start as its bytes, the last one marked as the
word's end.  Adjacent pairs lie in a heap by merge rank and position; the lowest is popped
again and again, merged in a doubly linked list, and its new neighbours are pushed.  The
count is the initial symbols less the merges; no identifier is made.

Defined results
---------------
* Null text counts as empty: no bytes, no tokens.
* The special strings of the vocabulary count one token each wherever they stand in a text.
* Texts are taken whole, however long; a single word of n bytes costs O(n log n).
* Repeated rows each get a row; an empty table gives an empty result.

Scale: one scan, no shuffle.  Counts of distinct words are kept per Python worker in a
dictionary that is emptied at ``CACHE_WORDS`` entries, so memory is bounded.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.shared import spread, table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE_WORDS = 1_000_000
END = "</w>"
#: Characters on whose class, lower case and composition all versions of Unicode agree: Latin
#: letters but the dotted capital I, common punctuation, the euro sign.
PLAIN = "\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203a\u20ac"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    symbols = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [symbols[b] for b in range(256)]


class Merger:
    """Counts the tokens of words under a merge list."""

    def __init__(self, merges: list):
        symbols: dict[str, int] = {}
        name = lambda s: symbols.setdefault(s, len(symbols))
        plain = byte_symbols()
        self.inner = [name(s) for s in plain]
        self.last = [name(s + END) for s in plain]
        # pair of symbols, as one number -> (rank, merged symbol), as one number
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(name(a) << 20 | name(b), rank << 20 | name(a + b))
        self.counts: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Initial symbols less merges."""
        raw = word.encode("utf-8", "surrogatepass")
        n, pairs = len(raw), self.pairs
        at = [self.inner[b] for b in raw]
        at[-1] = self.last[raw[-1]]
        if n == 1:
            return 1
        # rank and place, and the symbol that the merge makes
        heap = [(new >> 20 << 32 | i, new & 0xFFFFF) for i in range(n - 1) if (new := pairs.get(at[i] << 20 | at[i + 1])) is not None]
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            rank_at, made = heapq.heappop(heap)
            i = rank_at & 0xFFFFFFFF
            j = after[i]
            # an entry counts as long as its place still merges into the same symbol, whatever the two parts
            if j >= n or at[i] < 0 or (now := pairs.get(at[i] << 20 | at[j])) is None or now & 0xFFFFF != made:
                continue
            at[i], at[j] = made, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (new := pairs.get(made << 20 | at[k])) is not None:
                    heapq.heappush(heap, (new >> 20 << 32 | i, new & 0xFFFFF))
            if (h := before[i]) >= 0 and (new := pairs.get(at[h] << 20 | made)) is not None:
                heapq.heappush(heap, (new >> 20 << 32 | h, new & 0xFFFFF))
        return left

    def __missing__(self, word: str) -> int:
        if len(self.counts) >= CACHE_WORDS:
            self.counts.clear()
        found = self.counts[word] = self.count(word)
        return found


class Counter:
    """Token counts of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = Merger(spec["model"]["merges"])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        space = spec["normalizer"]["normalizers"][1]["pattern"]["Regex"]
        # white space by Unicode's property in both patterns, as the vocabulary's library has it
        white = r"\p{White_Space}"
        self.words = regex.compile(split.replace(r"\s", white), regex.V0)
        self.space = regex.compile(space.replace(r"\s", white), regex.V0)
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.other = regex.compile(f"[^{PLAIN}]")
        self.library = Tokenizer.from_file(path)
        self.byte_of = {ord(c): b for b, c in enumerate(byte_symbols())}

    def split(self, text: str) -> Iterator[str]:
        """The words of a text without special strings."""
        if text.isascii() or not self.other.search(text):
            return self.words.findall(self.space.sub(" ", text).lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        # each byte of a word is shown as one character
        return (word.translate(self.byte_of).encode("latin-1").decode() for word, _ in shown)

    def plain(self, text: str) -> int:
        counts, merger, total = self.merger.counts, self.merger, 0
        for word in self.split(text):
            n = counts.get(word)
            total += merger.__missing__(word) if n is None else n
        return total

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(public_tokenizers.path(vocabulary))
        for texts in batches:
            yield pd.Series([count(x) for x in texts], dtype="int64")

    tokens = F.pandas_udf(run, "long")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counted = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), tokens(text).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir):
    return count_tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
