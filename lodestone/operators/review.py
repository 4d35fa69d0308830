"""Diff review: unified diffs as line tables, hunk ranges, identifiers, model replies, comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import COMMENT_KEY_CHARS, HUNK_IDENTIFIERS, SEVERITIES
from lodestone.operators.lines import document_lines

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"
NAME = "[A-Za-z_][A-Za-z0-9_]{2,}"

# Words of programming languages that name nothing of a program.
STOP_NAMES = (
    "and", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "false", "finally",
    "for", "from", "global", "import", "lambda", "none", "nonlocal", "not", "pass", "raise", "return", "self", "true", "try",
    "while", "with", "yield", "int", "str", "bool", "float", "list", "dict", "set", "tuple", "bytes",
)


def side_path(text: Column) -> Column:
    """A path of a header line without its tab suffix and its a/ or b/."""
    return F.regexp_replace(F.trim(F.substring_index(text, "\t", 1)), "^[ab]/", "")


def parse_diff(diffs: DataFrame, key: str = "diff_id", text_col: str = "text") -> DataFrame:
    """One row a hunk line: key, file_no, hunk_no, seq, path, old_start, new_start, heading, kind, text, old_line, new_line,
    is_new, is_deleted, is_binary, old_path.

    A line's role depends on what stands before it only through running maxima and counts, so
    the parse is a few window functions over (key, line) instead of a loop.
    """
    raw = diffs.select(key, F.posexplode(document_lines(F.col(text_col))).alias("seq", "raw"))
    t, run = F.col("raw"), Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = lambda p: F.startswith(t, F.lit(p))
    rows = raw.withColumn("file_no", F.sum(starts("diff --git ").cast("int")).over(run)).filter("file_no > 0")
    meta = (
        F.when(starts("diff --git "), "file").when(starts("new file mode"), "new").when(starts("deleted file mode"), "deleted")
        .when(starts("Binary files ") | starts("GIT binary patch"), "binary").when(starts("rename from "), "from").when(starts("rename to "), "to")
        .when(starts("--- "), "old").when(starts("+++ "), "path").when(t.rlike(HUNK), "hunk")
        .when(starts("\\"), "note").when(starts("+"), "add").when(starts("-"), "remove").when(starts(" ") | (t == ""), "context").otherwise("junk")
    )
    rows = rows.withColumn("role", meta)
    in_file = Window.partitionBy(key, "file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    header = F.regexp_extract(t, r"^diff --git (.*)$", 1)
    path = (
        F.when(F.col("role") == "file", F.when(F.contains(header, F.lit(" b/")), F.trim(F.regexp_extract(header, r"^.*? b/(.*)$", 1))).otherwise(side_path(header)))
        .when(F.col("role") == "to", F.trim(F.substring(t, 11, 1 << 30)))
        .when((F.col("role") == "path") & (side_path(F.substring(t, 5, 1 << 30)) != "/dev/null"), side_path(F.substring(t, 5, 1 << 30)))
    )
    # a hunk's lines: between its header and the next header or line that is none of a hunk's
    opening = F.when(F.col("role") == "hunk", F.col("seq")).when(F.col("role").isin("junk", "file"), F.lit(-1))
    rows = rows.withColumns({"path_here": path, "opened": F.last(opening, ignorenulls=True).over(in_file)})
    rows = rows.withColumn("path", F.last("path_here", ignorenulls=True).over(in_file))
    whole = Window.partitionBy(key, "file_no")
    flag = lambda role: F.max(F.col("role") == role).over(whole)
    old = F.when(F.col("role") == "old", F.nullif(side_path(F.substring(t, 5, 1 << 30)), F.lit("/dev/null"))).when(F.col("role") == "from", F.trim(F.substring(t, 13, 1 << 30)))
    everything = Window.partitionBy(key, "file_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {"is_new": flag("new"), "is_deleted": flag("deleted"), "is_binary": flag("binary"), "old_path": F.last(old, ignorenulls=True).over(everything)}
    )
    rows = rows.filter("opened >= 0")
    group = lambda i: F.regexp_extract(t, HUNK, i)
    first = Window.partitionBy(key, "file_no", "opened").orderBy("seq")
    rows = rows.withColumns(
        {
            "old_start": F.first(group(1).try_cast("int")).over(first),
            "new_start": F.first(group(3).try_cast("int")).over(first),
            "heading": F.trim(F.first(group(5)).over(first)),
            "path": F.first("path").over(first),
        }
    )
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    count = lambda *roles: F.coalesce(F.sum(F.col("role").isin(*roles).cast("int")).over(before), F.lit(0))
    rows = rows.withColumns({"olds": count("context", "remove"), "news": count("context", "add")}).filter(F.col("role").isin("add", "remove", "context"))
    rows = rows.withColumn("hunk_no", F.dense_rank().over(Window.partitionBy(key).orderBy("opened")))
    return rows.select(
        key, "file_no", "hunk_no", "seq", "path", "old_start", "new_start", "heading", F.col("role").alias("kind"), F.substring(t, 2, 1 << 30).alias("text"),
        F.when(F.col("role") != "add", F.col("old_start") + F.col("olds")).cast("int").alias("old_line"),
        F.when(F.col("role") != "remove", F.col("new_start") + F.col("news")).cast("int").alias("new_line"),
        "is_new", "is_deleted", "is_binary", "old_path",
    )


def reviewable(lines: DataFrame) -> DataFrame:
    """Lines of the hunks worth a review: not of binary or deleted files."""
    return lines.filter(~F.col("is_binary") & ~F.col("is_deleted"))


def hunk_ranges(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """Per hunk: first and last line of the new file, anchor (first added line), numbers of added and removed lines."""
    lo = F.coalesce(F.min("new_line"), F.first("new_start"))
    added = F.min(F.when(F.col("kind") == "add", F.col("new_line")))
    return lines.groupBy(key, "hunk_no", "path").agg(
        lo.alias("low"),
        F.coalesce(F.max("new_line"), F.first("new_start")).alias("high"),
        F.coalesce(added, lo).alias("anchor"),
        F.sum((F.col("kind") == "add").cast("int")).alias("added"),
        F.sum((F.col("kind") == "remove").cast("int")).alias("removed"),
    )


def hunk_identifiers(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """Per hunk: distinct identifiers of its added, then removed lines, and the search made of the first ones."""
    found = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "context", F.struct((F.col("kind") == "remove").alias("late"), "seq", "text")))), lambda x: x["text"]
    )
    names = F.flatten(F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(NAME), F.lit(0))))
    stop = F.array(*[F.lit(w) for w in STOP_NAMES])
    names = F.array_distinct(F.filter(names, lambda n: ~F.array_contains(stop, F.lower(n))))
    rows = lines.groupBy(key, "hunk_no", "path").agg(names.alias("names"), F.first("heading").alias("heading"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    search = F.coalesce(F.nullif(F.array_join(F.slice("names", 1, HUNK_IDENTIFIERS), " "), F.lit("")), F.nullif(F.col("heading"), F.lit("")), stem)
    return rows.select(key, "hunk_no", "path", "names", search.alias("search"))


def render_line(kind: Column, text: Column, number: Column) -> Column:
    mark = F.when(kind == "add", "+").when(kind == "remove", "-").otherwise(" ")
    return F.format_string("%5s %s%s", F.coalesce(number.cast("string"), F.lit("")), mark, text)


def render_hunks(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """key, hunk_no, diff: each hunk as a diff shows it, with the new file's line numbers."""
    shown = render_line(F.col("kind"), F.col("text"), F.col("new_line"))
    rows = F.array_sort(F.collect_list(F.struct("seq", shown.alias("r"))))
    lo, hi = (F.coalesce(f("new_line"), F.first("new_start")) for f in (F.min, F.max))
    body = lines.groupBy(key, "hunk_no", "path").agg(F.transform(rows, lambda x: x["r"]).alias("rows"), lo.alias("lo"), hi.alias("hi"))
    head = F.format_string("@@ %s lines %d-%d @@", "path", "lo", "hi")
    return body.select(key, "hunk_no", F.concat_ws("\n", head, F.array_join("rows", "\n")).alias("diff"))


def is_rename(path: Column, old_path: Column, is_new: Column, is_deleted: Column) -> Column:
    """The file had another name before."""
    return old_path.isNotNull() & (old_path != path) & ~is_new & ~is_deleted


def skipped_files(lines: DataFrame, key: str = "diff_id") -> DataFrame:
    """key, text: files whose hunks are not reviewed, and why."""
    why = F.when(F.col("is_binary"), "binary").when(F.col("is_deleted"), "deleted")
    return lines.filter("is_binary OR is_deleted").select(key, F.concat("path", F.lit(": "), why).alias("text")).distinct()


def read_diffs(spark, path: str, key: str = "diff_id") -> DataFrame:
    """key (the file's path), text of diff files; an empty diff is an error."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias(key), F.col("value").alias("text"))
    empty = rows.filter(~F.col("text").rlike(r"\S")).first()
    if empty is not None or rows.isEmpty():
        raise ValueError(f"no diff in {empty[key] if empty is not None else path}")
    return rows


def parse_comments(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Comments of model replies (text, path, low, high, anchor): keys, ord, path, line, severity, message, problem.

    The array may stand in a fence or in prose.  Unknown severities become notes; lines that are
    none, or outside the hunk, go to the anchor; entries without a message are dropped.
    """
    text = F.trim("text")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    entries = F.from_json(array, "array<struct<line:string,severity:string,message:string>>")
    rows = replies.select(*keys, "path", "low", "high", "anchor", F.posexplode_outer(entries).alias("ord", "e"), entries.isNull().alias("unreadable"))
    message = F.trim(F.coalesce("e.message", F.lit("")))
    said = F.lower(F.trim(F.coalesce("e.severity", F.lit(""))))
    known = said.isin(*SEVERITIES)
    number = F.coalesce(F.expr("try_cast(trim(e.line) AS int)"), F.col("anchor"))
    inside = number.between(F.col("low"), F.col("high"))
    problem = F.concat_ws("; ", F.when(~known, "unknown severity"), F.when(~inside, "line outside the hunk"))
    return rows.filter(~F.col("unreadable") & (message != "")).select(
        *keys, "ord", "path", F.when(inside, number).otherwise(F.col("anchor")).alias("line"),
        F.when(known, said).otherwise("note").alias("severity"), message.alias("message"), problem.alias("problem"),
    )


def unreadable_replies(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the replies without a JSON array."""
    text = F.trim("text")
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.+?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    array = F.from_json(F.regexp_extract(body, r"(?s)(\[.*\])", 1), "array<string>")
    return replies.filter(array.isNull()).select(*keys)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def dedupe_comments(comments: DataFrame, order: list[str]) -> DataFrame:
    """Of comments with one file, line and start of message (any case), the first."""
    key = F.lower(F.substring("message", 1, COMMENT_KEY_CHARS))
    w = Window.partitionBy("path", "line", key).orderBy(*order)
    return comments.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def sort_comments(comments: DataFrame) -> DataFrame:
    """The worst first, then by file, line and message; what is missing comes last."""
    return comments.orderBy(*[F.asc_nulls_last(c) for c in (severity_rank(F.col("severity")), F.col("path"), F.col("line"), F.col("message"))])


def severity_counts(comments: DataFrame) -> DataFrame:
    """One row: the number of comments of each severity, zeros too."""
    return comments.agg(*[F.coalesce(F.sum((F.col("severity") == s).cast("int")), F.lit(0)).alias(s) for s in SEVERITIES])
