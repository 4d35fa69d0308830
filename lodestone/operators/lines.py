"""Texts as tables of lines, and operators over them: sections, windows, islands, enclosing ranges, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import MAX_CHUNK_CHARS, MAX_CHUNK_LINES

HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
#: Where lines end in documents and diffs: every line boundary of Unicode text.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def is_blank(line: Column) -> Column:
    return ~F.coalesce(line, F.lit("")).rlike(r"(?U)\S")


def code_lines(text: Column) -> Column:
    """Lines of code: CRLF counts as LF, an end of line at the end opens an empty last line."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n", -1)


def document_lines(text: Column) -> Column:
    """Lines of prose or a diff: no empty line after the last end of line, none at all in an empty text."""
    body = F.coalesce(text, F.lit(""))
    parts = F.split(body, LINE_END, -1)
    closed = F.rlike(body, F.lit("(?s)(?:" + LINE_END + r")\z")) | (body == "")
    return F.when(closed, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def line_table(files: DataFrame, key: str, lines: Column) -> DataFrame:
    """key, line_no (from 1), line."""
    return files.select(F.col(key), F.posexplode(lines).alias("at", "line")).select(key, (F.col("at") + 1).alias("line_no"), "line")


def sections(lines: DataFrame, key: str, is_head: Column, title: Column, preamble: Column) -> DataFrame:
    """A section from each head line to before the next; lines before the first head form one of their own.

    key, section (0 for the preamble), symbol, start_line, end_line; sections of blank lines only, other
    than headed ones, are left out.
    """
    running = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("head", is_head).withColumn("title", F.when(F.col("head"), title))
    marked = marked.withColumn("section", F.sum(F.col("head").cast("int")).over(running))
    found = marked.groupBy(key, "section").agg(
        F.max("title").alias("title"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.max(~is_blank(F.col("line"))).alias("content")
    )
    found = found.filter("content").withColumn("symbol", F.when(F.col("section") > 0, F.col("title")).otherwise(preamble))
    return found.select(key, F.col("section").cast("long").alias("section"), "symbol", "start_line", "end_line")


def fixed_windows(spans: DataFrame, lines: DataFrame, key: str, size: int = MAX_CHUNK_LINES, chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """Windows of ``size`` lines without overlap over each span (key, span, start_line, end_line).

    Blank windows are left out but count in part and part_count; a window's code is cut at ``chars``.
    """
    at = F.floor((F.col("line_no") - F.col("start_line")) / size).cast("int")
    inside = lines.join(spans, key).filter("line_no BETWEEN start_line AND end_line").withColumn("w", at)
    parts = F.floor((F.col("end_line") - F.col("start_line")) / size + 1).cast("int")
    found = inside.groupBy(key, "span", "w", parts.alias("part_count")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("code"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.max(~is_blank(F.col("line"))).alias("content"),
    )
    found = found.filter("content").withColumn("code", F.substring("code", 1, chars))
    return found.select(key, "span", (F.col("w") + 1).alias("part"), "part_count", "start_line", "end_line", "code")


def islands(lines: DataFrame, key: str, uncovered: Column) -> DataFrame:
    """Maximal runs of lines for which ``uncovered`` holds: key, start_line, end_line."""
    w = Window.partitionBy(key).orderBy("line_no")
    runs = lines.filter(uncovered).withColumn("run", F.col("line_no") - F.row_number().over(w))
    return runs.groupBy(key, "run").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).drop("run")


def trim_blank_edges(spans: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Spans (key, start_line, end_line) shrunk to their content; blank ones go."""
    inside = lines.join(spans, key).filter("line_no BETWEEN start_line AND end_line").filter(~is_blank(F.col("line")))
    return inside.groupBy(key, F.col("start_line").alias("s"), F.col("end_line").alias("e")).agg(
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")
    ).drop("s", "e")


def enclosing(gaps: DataFrame, extents: DataFrame, key: str) -> DataFrame:
    """Adds kind and symbol of the smallest extent (key, lo, hi, name) that holds the gap, else the module."""
    size = F.col("x.hi") - F.col("x.lo")
    on = (F.col(f"g.{key}") == F.col(f"x.{key}")) & (F.col("x.lo") <= F.col("g.start_line")) & (F.col("g.end_line") <= F.col("x.hi"))
    met = gaps.alias("g").join(extents.alias("x"), on, "left")
    best = met.groupBy(F.col(f"g.{key}").alias(key), "g.start_line", "g.end_line").agg(F.min(F.struct(size.alias("size"), F.col("x.name").alias("name"))).alias("best"))
    name = F.col("best.name")
    return best.select(
        key, "start_line", "end_line", F.when(name.isNull(), "module").otherwise("class").alias("kind"), F.coalesce(name, F.lit("<module>")).alias("symbol")
    )


# Lines of only these close the construct above them.
CLOSING_CHARS = "{}()[];,"
CLOSING_WORDS = ("end", "});", "})")


def is_closing(line: Column) -> Column:
    """Blank, or nothing but the end of a block."""
    text = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    return text.isin(*CLOSING_WORDS) | (F.translate(text, CLOSING_CHARS, "") == "")


def absorb_closing(spans: DataFrame, gaps: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Spans and gaps (key, start_line, end_line, kind, symbol), where gaps that only close a construct go to the span before.

    Gaps that follow each other without a line between count as one here, as far as each only closes.
    """
    inside = gaps.alias("g").join(lines.alias("l"), (F.col(f"g.{key}") == F.col(f"l.{key}")) & F.col("l.line_no").between(F.col("g.start_line"), F.col("g.end_line")))
    closing = inside.groupBy(*[F.col(f"g.{c}").alias(c) for c in (key, "start_line", "end_line", "kind", "symbol")]).agg(F.min(is_closing(F.col("l.line"))).alias("closing"))
    order = Window.partitionBy(key).orderBy("start_line")
    apart = (F.lag("end_line").over(order) + 1 != F.col("start_line")) | ~F.lag("closing").over(order) | ~F.col("closing")
    closing = closing.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    closing = closing.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = closing.filter("closing").groupBy(key, "run").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    on = [F.col(f"s.{key}") == F.col(f"r.{key}"), F.col("s.end_line") + 1 == F.col("r.first")]
    grown = spans.alias("s").join(runs.alias("r"), on, "left")
    grown = grown.select(*[F.col(f"s.{c}") for c in (key, "start_line")], F.coalesce("r.last", "s.end_line").alias("end_line"), "s.kind", "s.symbol", F.col("r.run").alias("run"))
    rest = closing.join(grown.filter("run IS NOT NULL").select(key, "run"), [key, "run"], "left_anti")
    columns = [key, "start_line", "end_line", "kind", "symbol"]
    return grown.select(*columns).union(rest.select(*columns))


def inside_path(path: Column) -> Column:
    """A relative path without its dots, null if it is absolute or leads out of the root."""
    steps = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(
        steps,
        F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
        lambda a, p: F.when(p != "..", F.struct(F.concat(a["at"], F.array(p)).alias("at"), a["ok"].alias("ok"))).otherwise(
            F.struct(F.slice(a["at"], F.lit(1), F.greatest(F.size(a["at"]) - 1, F.lit(0))).alias("at"), (a["ok"] & (F.size(a["at"]) > 0)).alias("ok"))
        ),
    )
    return F.when(~F.startswith(path, F.lit("/")) & up["ok"] & (F.size(up["at"]) > 0), F.array_join(up["at"], "/"))


def excerpt(files: DataFrame, key: str, lines: Column, start: Column, end: Column, cap: int) -> DataFrame:
    """Lines start..end (from 1, inclusive, clamped) of each file, ``cap`` at most: text, start_line, end_line, truncated."""
    rows = files.withColumn("all", lines).withColumn("n", F.size("all"))
    first = F.greatest(start, F.lit(1))
    last = F.least(F.coalesce(end, F.col("n")), F.col("n"))
    rows = rows.withColumn("a", first).withColumn("b", F.least(last, first + cap - 1)).withColumn("truncated", last > first + cap - 1)
    text = F.when(F.col("b") >= F.col("a"), F.array_join(F.slice("all", F.col("a"), F.col("b") - F.col("a") + 1), "\n")).otherwise("")
    return rows.select(key, F.col("a").alias("start_line"), F.col("b").alias("end_line"), text.alias("text"), "truncated")


def surrounding(spans: DataFrame, lines: DataFrame, key: str, before_after: int) -> DataFrame:
    """Lines around each span (key, span, lo, hi): one equi-join on the file with a range residue."""
    on = (F.col(f"s.{key}") == F.col(f"l.{key}")) & F.col("l.line_no").between(F.col("s.lo") - before_after, F.col("s.hi") + before_after)
    met = spans.alias("s").join(lines.alias("l"), on)
    return met.groupBy(F.col(f"s.{key}").alias(key), "s.span").agg(
        F.min("l.line_no").alias("first_line"), F.max("l.line_no").alias("last_line"), F.count("*").alias("lines")
    )
