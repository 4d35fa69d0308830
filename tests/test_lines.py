import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, lines


def test_document_lines_equal_splitlines(spark):
    cases = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "x\r\n", "\r\n\r\n"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    found = {r["i"]: r["l"] for r in rows.select("i", lines.document_lines(F.col("t")).alias("l")).collect()}
    assert [found[i] for i in range(len(cases))] == [c.splitlines() for c in cases]


def test_code_windows():
    assert chunking.greedy_windows([10] * 401, 0, 400) == [(0, 199), (180, 379), (360, 400)]
    assert chunking.greedy_windows([16_001], 0, 0) == [(0, 0)]
    rng = random.Random(4)
    for _ in range(200):
        widths = [rng.choice([0, 5, 50, 400, 9000]) for _ in range(rng.randrange(1, 80))]
        found = chunking.greedy_windows(widths, 0, len(widths) - 1, 7, 500, 2)
        covered = set()
        for a, b in found:
            assert b - a < 7 and (a == b or sum(widths[a : b + 1]) + b - a + 1 <= 500)
            covered |= set(range(a, b + 1))
        assert covered == set(range(len(widths)))
        assert all(x[0] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_chunks_lose_no_line():
    source = "import os\n\n@d\nclass A(B):\n    x = 1\n\n    def f(self):\n        def g():\n            pass\n        return g\n\n    y = 2\n\nz = 3\n\nasync def h():\n    await h()\n\nif True:\n    def k():\n        pass\n"
    found = chunking.chunk_source(source, "a.py", "Python")
    names = [(c[3], c[4]) for c in found]
    assert ("A", "class") in names and ("A.f", "function") in names and ("h", "function") in names and ("k", "function") in names
    assert not any(n == "A.f.g" for n, _ in names)
    covered = {i for c in found for i in range(c[5], c[6] + 1)}
    assert all(i in covered for i, line in enumerate(source.split("\n"), 1) if line.strip())
    broken = chunking.chunk_source("def broken(:\n  x\n", "b.py", "Python")
    assert [(c[3], c[5], c[6]) for c in broken] == [("<module>", 1, 2)]


def test_closing_lines_are_absorbed():
    text = ["f() {", "  a", "}", "", "x", "});"]
    spans = [(0, 1, "function", "f")]
    gaps = chunking.gaps_of(spans, text, [])
    assert gaps == [(2, 5, "module", "<module>")]
    spans = [(0, 1, "function", "f"), (4, 4, "function", "x")]
    assert chunking.absorb_closing(spans, chunking.gaps_of(spans, text, []), text) == [(0, 2, "function", "f"), (4, 5, "function", "x")]


def test_fixed_windows_parts(spark):
    text = "\n".join(f"line {i}" for i in range(501))
    rows = lines.line_table(spark.createDataFrame([("a", text), ("b", " \n\n")], "path string, text string"), "path", lines.document_lines(F.col("text")))
    spans = rows.groupBy("path").agg(F.lit(0).alias("span"), F.lit(1).alias("start_line"), F.max("line_no").alias("end_line"))
    found = lines.fixed_windows(spans, rows, "path").orderBy("part").collect()
    assert [(r["path"], r["part"], r["part_count"], r["start_line"], r["end_line"]) for r in found] == [("a", 1, 3, 1, 200), ("a", 2, 3, 201, 400), ("a", 3, 3, 401, 501)]


@pytest.mark.parametrize(("start", "end", "want"), [(1, None, (1, 3, "a\nb\nc", True)), (0, 2, (1, 2, "a\nb", False)), (4, 99, (4, 5, "d\ne", False)), (9, 10, (9, 5, "", False))])
def test_excerpt(spark, start, end, want):
    files = spark.createDataFrame([("f", "a\nb\nc\nd\ne")], "path string, text string")
    row = lines.excerpt(files, "path", lines.code_lines(F.col("text")), F.lit(start), F.lit(end).cast("int"), cap=3).first()
    assert tuple(row)[1:] == want
