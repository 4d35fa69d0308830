"""Tunables of the engine, one place.

The values below are fixed by the results the engine must give: they are the tunables and
word lists that its rankings, chunks and reports are defined with.
"""

from __future__ import annotations

# --- retrieval
VECTOR_POOL = 20
KEYWORD_POOL = 20
FINAL_TOP_K = 8
RERANK_POOL = 30
RRF_K = 10
KEYWORD_WEIGHT_NAMED = 1.0
KEYWORD_WEIGHT_PLAIN = 0.0
VECTOR_WEIGHT = 1.0
BM25_K1 = 1.5
BM25_B = 0.1
BM25_IDF_FLOOR = 0.25

# --- chunking
MAX_CHUNK_LINES = 200
MAX_CHUNK_CHARS = 8000
CHUNK_OVERLAP_LINES = 20
MAX_FILE_BYTES = 1_000_000

# --- prompts, agent, review
PROMPT_CHUNK_CHARS = 3000
MAX_ATTEMPTS = 3
MIN_ANSWER_CHARS = 200
QUERY_CHARS = 120
MAX_READ_LINES = 400
SURROUNDING_LINES = 40
HUNK_IDENTIFIERS = 6
HUNK_RELATED = 4
COMMENT_KEY_CHARS = 60
SEVERITIES = ("blocker", "warning", "suggestion", "note")

# --- evaluation
CUTOFFS = (1, 5, 8, 20)
ABLATION_RECALL_K = 5
RETRIEVAL_DEPTH = 20
FAILURE_ROWS = 12

# Stopwords dropped by the tokeniser.
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "did", "do",
    "does", "for", "from", "get", "had", "has", "have", "how", "i", "if", "in", "into", "is", "it",
    "its", "me", "my", "not", "of", "on", "or", "our", "out", "should", "so", "some", "than", "that",
    "the", "their", "them", "then", "there", "these", "they", "this", "to", "up", "us", "was", "we", "were",
    "what", "when", "where", "which", "who", "why", "will", "with", "would", "you", "your",
)

# Document files that count, by stem (case-insensitive) and by extension.
DOC_STEMS = ("readme", "changelog", "changes", "contributing", "install", "usage", "faq", "news", "history", "license", "authors")
DOC_EXTENSIONS = (".md", ".markdown", ".rst", ".txt")
