import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("parse_jwt", ["parsejwt", "parse", "jwt"]),
        ("parseJwt", ["parsejwt", "parse", "jwt"]),
        ("parse the jwt", ["parse", "jwt"]),
        ("ParseJWT HTTPServer", ["parsejwt", "parse", "jwt", "httpserver", "http", "server"]),
        ("__init__", ["init"]),
        ("sha256 SHA256", ["sha256", "sha256", "sha", "256"]),
        ("MAX_CHUNK_LINES", ["maxchunklines", "max", "chunk", "lines"]),
        ("HTTPs", ["https", "htt", "ps"]),
        ("école", ["cole"]),
        ("", []),
        (None, []),
    ],
)
def test_tokenize(spark, text, terms):
    assert one(spark, t.tokenize, text) == terms


def test_tokenize_question(spark):
    found = one(spark, t.tokenize, "how do we handle the retry_count = 3;")
    assert {"retrycount", "retry", "count", "3", "handle"} <= set(found) and not {"how", "the"} & set(found)


@pytest.mark.parametrize(
    ("question", "named"),
    [
        ("where is parse_jwt used?", True), ("what calls getName?", True), ("why `x`?", True), ("does HTTPServer close?", True), ("is close.now() safe?", True), ("what about __call__?", True),
        ("how are tokens refreshed?", False), ("Where does the app start?", False), ("", False), (None, False),
    ],
)
def test_router(spark, question, named):
    assert one(spark, t.mentions_identifier, question) is named


def test_citations(spark):
    assert one(spark, t.citations, "see a/b.py:1-5, c.py:10-12 and a/b.py:1-5") == ["a/b.py:1-5", "c.py:10-12"]
    assert one(spark, t.citations, "in `my docs/Web Site.md:4-9` only") == ["my docs/Web Site.md:4-9"]
