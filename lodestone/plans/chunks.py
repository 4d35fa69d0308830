"""Queries: scans, sections, windows, islands, enclosing ranges, excerpts, code chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking, lines
from lodestone.plans.registry import register, table
from lodestone.sources import files

MARKDOWN = [
    ("guide.md", "Intro text\n\n# First\nbody one\n## Second ##\nbody two\n\nmore\n### Third\n"),
    ("plain.md", "no heading here\njust lines"),
    ("readme.md", "# Only\n"),
    ("blank.md", "\n \n"),
]
MARKDOWN_SQL = "VALUES " + ", ".join("('{}', '{}')".format(p, t.replace("\n", "' || chr(10) || '")) for p, t in MARKDOWN)


@register(
    "doc_sections",
    f"""WITH f(path, text) AS ({MARKDOWN_SQL}),
l0 AS (SELECT path, string_split(rtrim(text, chr(10)), chr(10)) AS ls FROM f),
l AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM l0),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+.+') AS head FROM l),
s AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY line_no) AS section FROM h)
SELECT path, section::BIGINT AS section, min(line_no) AS start_line, max(line_no) AS end_line,
  CASE WHEN section > 0 THEN max(CASE WHEN head THEN regexp_replace(regexp_replace(line, '^#{{1,6}}\\s+', ''), '\\s*#*\\s*$', '') END) ELSE split_part(path, '.', 1) END AS symbol
FROM s GROUP BY path, section HAVING bool_or(regexp_matches(line, '\\S'))""",
)
def doc_sections(spark, d):
    rows = spark.createDataFrame(MARKDOWN, "path string, text string")
    body = F.regexp_replace("text", "\n+$", "")
    table_ = lines.line_table(rows.withColumn("text", body), "path", F.split("text", "\n", -1))
    head = F.col("line").rlike(lines.HEADING)
    found = lines.sections(table_, "path", head, F.regexp_extract("line", lines.HEADING, 2), F.substring_index("path", ".", 1))
    return found.select("path", "section", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "symbol")


@register(
    "conversation_sections",
    """WITH s AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, section::BIGINT AS section, min(turn) + 1 AS start_line, max(turn) + 1 AS end_line FROM s GROUP BY ALL""",
)
def conversation_sections(spark, d):
    """Turns as lines: each user turn opens a section."""
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("line_no"), F.lit("x").alias("line"), "role")
    return lines.sections(turns, "conv_id", F.col("role") == "user", F.lit("user"), F.lit("start")).drop("symbol")


def document_line_table(spark, d):
    return lines.line_table(table(spark, d, "documents"), "doc_id", lines.code_lines(F.col("text")))


LINES_SQL = """
ls AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS line_no, len(a) AS n FROM ls)"""


@register(
    "fixed_windows",
    f"""WITH {LINES_SQL}, w AS (SELECT *, (line_no - 1) // 10 AS w FROM l)
SELECT doc_id, (w + 1)::INT AS part, ((max(n) - 1) // 10 + 1)::INT AS part_count, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line,
  md5(left(string_agg(line, chr(10) ORDER BY line_no), 800)) AS code_md5
FROM w GROUP BY doc_id, w HAVING bool_or(regexp_matches(line, '\\S'))""",
)
def fixed_windows(spark, d):
    rows = document_line_table(spark, d)
    spans = rows.groupBy("doc_id").agg(F.lit(0).alias("span"), F.lit(1).alias("start_line"), F.max("line_no").alias("end_line"))
    found = lines.fixed_windows(spans, rows, "doc_id", size=10, chars=800)
    return found.select("doc_id", "part", "part_count", "start_line", "end_line", F.md5("code").alias("code_md5"))


@register(
    "greedy_windows",
    """WITH RECURSIVE ls AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents),
c AS (SELECT doc_id, len(a) AS n, list_transform(a, lambda x: length(x) + 1) AS wd FROM ls),
s AS (SELECT doc_id, n, i, coalesce(list_sum(wd[1:i]), 0)::BIGINT AS upto, wd[i] AS own FROM c, unnest(range(1, n + 1)) t(i)),
jump AS (SELECT a.doc_id, a.n, a.i AS row_, max(b.i) AS last_ FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7
  AND (b.i = a.i OR b.upto - a.upto + a.own <= 1500) GROUP BY ALL),
w AS (SELECT doc_id, n, row_, last_ FROM jump WHERE row_ = 1
  UNION ALL SELECT j.doc_id, j.n, j.row_, j.last_ FROM w JOIN jump j ON j.doc_id = w.doc_id AND j.row_ = greatest(w.last_ + 1 - 2, w.row_ + 1) WHERE w.last_ < w.n)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY row_)::INT AS part, count(*) OVER (PARTITION BY doc_id)::INT AS part_count,
  row_::INT AS start_line, last_::INT AS end_line FROM w""",
)
def greedy_windows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunking.windows_of(docs, "doc_id", "text", max_lines=8, max_chars=1500, overlap=2)


@register(
    "gaps_and_islands",
    f"""WITH {LINES_SQL}, u AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM l WHERE length(line) < 200)
SELECT doc_id, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line FROM u GROUP BY doc_id, g""",
)
def gaps_and_islands(spark, d):
    return lines.islands(document_line_table(spark, d), "doc_id", F.length("line") < 200)


CODE_LINES = ["def a", "  x", "}", "", "def b", "  y", ");", "z = 1", "", "end", "def c", "  w", "})", "", "]", "q"]
CODE_SPANS = [(1, 2, "function", "a"), (5, 6, "function", "b"), (11, 12, "function", "c")]
CODE_GAPS = [(3, 3, "module", "<module>"), (7, 10, "module", "<module>"), (13, 13, "class", "K"), (14, 15, "module", "<module>"), (16, 16, "module", "<module>")]


@register(
    "structural_absorb",
    "SELECT * FROM (VALUES (1, 3, 'function', 'a'), (5, 6, 'function', 'b'), (7, 10, 'module', '<module>'), (11, 15, 'function', 'c'), (16, 16, 'module', '<module>')) t(start_line, end_line, kind, symbol)",
)
def structural_absorb(spark, d):
    """Gaps of a few lines: those that only close a construct go to it."""
    kind = "file int, start_line int, end_line int, kind string, symbol string"
    rows = spark.createDataFrame([(1, "\n".join(CODE_LINES))], "file int, text string")
    spans, gaps = (spark.createDataFrame([(1, *x) for x in some], kind) for some in (CODE_SPANS, CODE_GAPS))
    found = lines.absorb_closing(spans, gaps, lines.line_table(rows, "file", lines.code_lines(F.col("text"))), "file")
    return found.select("start_line", "end_line", "kind", "symbol")


@register(
    "enclosing_range",
    f"""WITH {LINES_SQL}, n AS (SELECT doc_id, max(line_no) AS n FROM l GROUP BY doc_id),
x AS (SELECT doc_id, 'ten' || i AS name, i * 10 + 1 AS lo, i * 10 + 8 AS hi FROM n, unnest(range(0, n // 10 + 1)) t(i)
  UNION ALL SELECT doc_id, 'thirty' || i, i * 30 + 1, i * 30 + 29 FROM n, unnest(range(0, n // 30 + 1)) t(i)),
g AS (SELECT doc_id, line_no AS start_line, line_no + 2 AS end_line FROM l),
m AS (SELECT g.*, x.name, row_number() OVER (PARTITION BY g.doc_id, g.start_line ORDER BY hi - lo, name) AS nth FROM g LEFT JOIN x ON g.doc_id = x.doc_id AND lo <= start_line AND end_line <= hi)
SELECT doc_id, start_line::INT AS start_line, end_line::INT AS end_line, CASE WHEN name IS NULL THEN 'module' ELSE 'class' END AS kind, coalesce(name, '<module>') AS symbol FROM m WHERE nth = 1""",
)
def enclosing_range(spark, d):
    rows = document_line_table(spark, d)
    n = rows.groupBy("doc_id").agg(F.max("line_no").alias("n"))

    def extents(name, step, last):
        i = F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))).alias("i")
        return n.select("doc_id", i).select("doc_id", F.concat(F.lit(name), F.col("i").cast("string")).alias("name"), (F.col("i") * step + 1).alias("lo"), (F.col("i") * step + last).alias("hi"))

    gaps = rows.select("doc_id", F.col("line_no").alias("start_line"), (F.col("line_no") + 2).alias("end_line"))
    return lines.enclosing(gaps, extents("ten", 10, 8).union(extents("thirty", 30, 29)), "doc_id")


@register(
    "surrounding_lines",
    f"""WITH {LINES_SQL}, s AS (SELECT doc_id, 0 AS span, (doc_id % 7 + 3) AS lo, (doc_id % 7 + 5) AS hi FROM documents)
SELECT s.doc_id, span, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, count(*) AS lines FROM s JOIN l ON s.doc_id = l.doc_id AND line_no BETWEEN lo - 4 AND hi + 4 GROUP BY ALL""",
)
def surrounding_lines(spark, d):
    rows = document_line_table(spark, d)
    spans = table(spark, d, "documents").select("doc_id", F.lit(0).alias("span"), (F.col("doc_id") % 7 + 3).alias("lo"), (F.col("doc_id") % 7 + 5).alias("hi"))
    return lines.surrounding(spans, rows, "doc_id", 4)


@register(
    "file_excerpt",
    """WITH ls AS (SELECT doc_id, string_split(text, chr(10)) AS a, greatest((doc_id % 5 - 1)::INT, 1) AS s, (doc_id % 9)::INT AS e FROM documents),
b AS (SELECT *, least(e, len(a)) AS l FROM ls)
SELECT doc_id, s AS start_line, least(l, s + 3)::INT AS end_line, CASE WHEN least(l, s + 3) >= s THEN array_to_string(a[s:least(l, s + 3)], chr(10)) ELSE '' END AS text, l > s + 3 AS truncated FROM b""",
)
def file_excerpt(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    start, end = (F.col("doc_id") % 5 - 1).cast("int"), (F.col("doc_id") % 9).cast("int")
    return lines.excerpt(docs, "doc_id", lines.code_lines(F.col("text")), start, end, cap=4)


FILES = [
    ("src/a.py", 100), ("src/b.PY", 100), ("src/big.py", 1_000_001), ("src/edge.py", 1_000_000), ("node_modules/x.js", 5), ("src/vendor/y.go", 5),
    ("notes.txt", 9), ("docs/advanced.rst", 9), ("pkg/CHANGELOG.rst", 9), ("sub/readme.md", 9), ("img/logo.png", 9), ("Makefile", 9), ("src/z.rake", 9), ("build.md", 9),
]


@register("repo_scan_filters", "SELECT * FROM (VALUES ('notes.txt'), ('build.md'), ('pkg/CHANGELOG.rst'), ('src/a.py'), ('src/b.PY'), ('src/edge.py'), ('src/z.rake'), ('sub/readme.md')) t(path)")
def repo_scan_filters(spark, d):
    return files.select_sources(spark.createDataFrame(FILES, "path string, length long")).select("path")


@register(
    "page_suffixes",
    """SELECT page_id, lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/.][^/]*(\\.[^./]+)$', 1)) AS ext FROM pages""",
)
def page_suffixes(spark, d):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    return table(spark, d, "pages").select("page_id", files.extension(path).alias("ext"))


REFS = ["owner/repo", "https://github.com/owner/repo.git", "www.github.com/o-w/r.e_p", "github.com/owner/repo/", "owner", "-bad/repo", "owner/repo/extra", "owner/..", "", "owner /repo", "a/.github"]


@register(
    "repo_refs",
    "SELECT * FROM (VALUES ('owner/repo', 'owner/repo'), ('https://github.com/owner/repo.git', 'owner/repo'), ('www.github.com/o-w/r.e_p', 'o-w/r.e_p'), ('github.com/owner/repo/', 'owner/repo'), "
    "('owner', NULL), ('-bad/repo', NULL), ('owner/repo/extra', NULL), ('owner/..', NULL), ('', NULL), ('owner /repo', NULL), ('a/.github', 'a/.github')) t(ref, repo)",
)
def repo_refs(spark, d):
    return spark.createDataFrame([(r,) for r in REFS], "ref string").select("ref", files.parse_ref(F.col("ref")).alias("repo"))


PYTHON_FILE = '''"""Doc."""
import os

LIMIT = 3


def simple(a):
    def inner():
        return a
    return inner


@decorated
class Account:
    """An account."""
    rate = 1

    def interest(self):
        return self.rate

    async def close(self):
        pass

    trailing = 2


if __name__ == "__main__":
    simple(LIMIT)
'''


@register(
    "code_chunks",
    "SELECT * FROM (VALUES ('<module>', 'module', 1, 4), ('simple', 'function', 7, 10), ('Account', 'class', 13, 17), ('Account.interest', 'function', 18, 19), "
    "('Account.close', 'function', 21, 22), ('Account', 'class', 24, 24), ('<module>', 'module', 27, 28)) t(symbol, kind, start_line, end_line)",
)
def code_chunks(spark, d):
    rows = spark.createDataFrame([("pkg/mod.py", PYTHON_FILE), ("pkg/none.xyz", "text")], "path string, text string")
    return chunking.chunk_files(rows).select("symbol", "kind", "start_line", "end_line")
