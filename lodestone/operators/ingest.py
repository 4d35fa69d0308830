"""Files into chunks: code by its syntax, documents by their headings, both in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import lines
from lodestone.operators.chunking import CHUNK_SCHEMA, chunk_files
from lodestone.sources.files import extension, is_code, is_document

# What the chunks of documents are called by extension.
DOCUMENT_LANGUAGES = {".md": "Markdown", ".markdown": "Markdown", ".rst": "reStructuredText", ".txt": "Text"}


def chunk_documents(files: DataFrame) -> DataFrame:
    """Chunks of prose (path, text): Markdown by its headings, other files whole, in windows of lines."""
    language = F.coalesce(*[F.when(extension(F.col("path")) == e, n) for e, n in DOCUMENT_LANGUAGES.items()], F.lit("Text"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    rows = lines.line_table(files, "path", lines.document_lines(F.col("text"))).withColumn("language", language)
    heading = (F.col("language") == "Markdown") & F.col("line").rlike(lines.HEADING)
    found = lines.sections(rows, "path", heading, F.trim(F.regexp_extract("line", lines.HEADING, 2)), stem)
    spans = found.select("path", F.col("section").alias("span"), "start_line", "end_line")
    windows = lines.fixed_windows(spans, rows, "path").join(found.select("path", F.col("section").alias("span"), "symbol"), ["path", "span"])
    return windows.withColumns({"language": language, "kind": F.lit("doc"), "file_path": F.col("path")}).select(*[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def ingest(files: DataFrame) -> DataFrame:
    """Chunks of all files (path, text) that are code or documents, once each; others have none.

    A file without text (it could not be read) has none either, and the others are not affected.
    """
    path = F.col("path")
    there = files.filter("text IS NOT NULL")
    return chunk_files(there.filter(is_code(path))).unionByName(chunk_documents(there.filter(is_document(path))))
