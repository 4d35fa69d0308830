"""Text expressions: identifier-aware tokens, routing, citations.  All of them are built-in column functions."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import STOPWORDS

# The patterns below define the terms, routes and citations that results are made of.
WORD = "[A-Za-z0-9_]+"
#: Upper-case runs, capitalised parts, lower-case and digit runs of an identifier.
PART = "[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
#: What makes a question name an identifier: backticks, snake_case, camelCase, ACRONYMWord, a call, dunder.
IDENTIFIER = (
    r"`[^`]+`"
    r"|\b[A-Za-z][a-z0-9]*_[A-Za-z0-9_]+\b"
    r"|\b\w*[a-z][A-Z]\w*\b"
    r"|\b[A-Z]{2,}[a-z]\w+\b"
    r"|\b\w+\.\w+\("
    r"|__\w+__"
)
CITATION = r"[\w./\-]+\.\w+:\d+-\d+"
TICKED_CITATION = r"`([^`:\n]+\.\w{1,6}:\d+-\d+)`"


def identifier_parts(word: Column) -> Column:
    """Lower-cased parts of one identifier, in order."""
    return F.transform(F.regexp_extract_all(word, F.lit(PART), F.lit(0)), F.lower)


def tokenize(text: Column) -> Column:
    """Index terms of a text: for each word its parts, led by the joined form if it has several; no stopwords."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    parts = F.transform(words, identifier_parts)
    full = F.transform(parts, lambda p: F.when(F.size(p) > 1, F.concat(F.array(F.array_join(p, "")), p)).otherwise(p))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(F.flatten(full), lambda t: ~F.array_contains(stop, t))


class TermCounter:
    """Counts a text's index terms as ``tokenize`` lists them; each distinct word is taken apart once."""

    CACHE_WORDS = 200_000

    def __init__(self):
        self.words, self.parts, self.stop = re.compile(WORD), re.compile(PART), frozenset(STOPWORDS)
        self.known: dict[str, tuple[str, ...]] = {}

    def terms(self, word: str) -> tuple[str, ...]:
        parts = [p.lower() for p in self.parts.findall(word)]
        if len(parts) > 1:
            parts.insert(0, "".join(parts))
        if len(self.known) >= self.CACHE_WORDS:
            self.known.clear()
        found = self.known[word] = tuple(p for p in parts if p not in self.stop)
        return found

    def __call__(self, text: str | None) -> dict[str, int]:
        found: dict[str, int] = {}
        for word, times in Counter(self.words.findall(text or "")).items():
            terms = self.known.get(word)
            for term in self.terms(word) if terms is None else terms:
                found[term] = found.get(term, 0) + times
        return found


def mentions_identifier(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike("(?U)" + IDENTIFIER)


def citations(answer: Column) -> Column:
    """Distinct ``path:start-end`` citations: backticked ones first, then bare ones that end none of them."""
    ticked = F.array_distinct(F.regexp_extract_all(answer, F.lit("(?U)" + TICKED_CITATION), F.lit(1)))
    bare = F.array_distinct(F.regexp_extract_all(answer, F.lit("(?U)" + CITATION), F.lit(0)))
    new = F.filter(bare, lambda c: ~F.exists(ticked, lambda t: F.endswith(t, c)))
    return F.array_distinct(F.concat(ticked, new))


def citation_file(citation: Column) -> Column:
    return F.regexp_extract(citation, r"^(.*):\d+-\d+$", 1)


def citation_start(citation: Column) -> Column:
    return F.regexp_extract(citation, r":(\d+)-\d+$", 1).cast("int")


def citation_end(citation: Column) -> Column:
    return F.regexp_extract(citation, r":\d+-(\d+)$", 1).cast("int")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def location(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def header(path: Column, start: Column, end: Column, kind: Column, symbol: Column, language: Column, part: Column, parts: Column) -> Column:
    """A chunk in one line: place, kind, symbol, which part of how many, language."""
    piece = F.when(parts > 1, F.format_string(" (part %d/%d)", part, parts)).otherwise("")
    return F.concat(location(path, start, end), F.lit(" "), kind, F.lit(" "), symbol, piece, F.lit(" ["), language, F.lit("]"))


def cost_line(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    return F.format_string("%s  %d in / %d out", model, input_tokens, output_tokens)


def cited_locations(answer: Column) -> Column:
    """Every ``path:start-end`` of an answer once, in the order of first mention."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit("(?U)" + CITATION), F.lit(0)))


def uncited_sources(cited: Column, retrieved: Column) -> Column:
    """What was retrieved and never cited; the other way round it is what was cited and never retrieved."""
    return F.filter(retrieved, lambda x: ~F.array_contains(cited, x))
