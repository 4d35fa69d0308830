import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, retrieval
from lodestone.operators.fusion import explain, fuse
from lodestone.operators.vectors import vector_topk

CODE = [
    (0, "def parse_jwt(token): return decode(token)"),
    (1, "def parseHTTPResponse(raw): return raw"),
    (2, "class RetryingHttpClient: def fetch(self): return self.retry()"),
    (3, "a file about nothing at all, with words"),
]


def test_bm25(spark):
    index = bm25.build_index(spark.createDataFrame(CODE, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "parse jwt"), (2, "http retry client"), (3, "zebra"), (4, "the of"), (5, None)], "q long, text string")
    found = bm25.bm25_topk(index, asked, "q", "text", 2).orderBy("query_id", "rank").collect()
    first = {r["query_id"]: r["id"] for r in found if r["rank"] == 1}
    assert first == {1: 0, 2: 2}
    assert all(r["score"] > 0 for r in found)
    empty = bm25.build_index(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert bm25.bm25_topk(empty, asked, "q", "text", 5).count() == 0 and bm25.bm25_topk(index, asked, "q", "text", 0).count() == 0


def test_term_counts_equal_the_expression(spark):
    from lodestone.functions.text import TermCounter, tokenize

    texts = [t for _, t in CODE] + ["", None, "HTTPServer2go __init__ snake_case_X9 the AND of", "é ünïcode naïve_Case"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("terms")).collect()
    count = TermCounter()
    for r in rows:
        found = count(r["t"])
        assert sum(found.values()) == len(r["terms"]) and found == {t: r["terms"].count(t) for t in r["terms"]}


def test_retrievers_by_name(spark):
    rows = [(i, t, [float(i == j) for j in range(4)]) for i, t in CODE]
    docs = spark.createDataFrame(rows, "id long, text string, vector array<float>")
    index = retrieval.Index(bm25.build_index(docs, "id", "text"), docs.select("id", "vector"), docs.select("id", "text"))
    asked = spark.createDataFrame([(7, "where is parse_jwt?", [0.0, 0.0, 1.0, 0.0])], "query_id long, question string, vector array<float>")
    first = {n: f(index, asked, 2).orderBy("rank").first()["id"] for n, f in retrieval.RETRIEVERS.items()}
    assert first == {"vector": 2, "bm25": 0, "hybrid": 0, "hybrid_rerank": 0}
    with pytest.raises(ValueError, match="hybrid_rerank"):
        retrieval.search_code(index, asked, 2, "nothing")


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id int, retriever string, id string, rank int, weight double")


def test_fusion_arithmetic_and_ties(spark):
    rows = [(1, "v", "a", 1, None), (1, "v", "b", 2, None), (1, "b", "b", 1, None), (1, "b", "a", 2, None)]
    found = fuse(ranking(spark, rows), k=60).collect()
    assert [r["id"] for r in found] == ["a", "b"] and all(r["score"] == pytest.approx(1 / 61 + 1 / 62) for r in found)
    deep = [(1, "v", x, i + 1, None) for i, x in enumerate(["deep", "x", "agreed"])] + [(1, "b", x, i + 1, None) for i, x in enumerate(["y", "z", "agreed"])]
    best = fuse(ranking(spark, deep), k=60).orderBy("rank").first()
    assert best["id"] == "agreed" and best["score"] == pytest.approx(2 / 63)


def test_fusion_weights_and_provenance(spark):
    rows = [(1, "a", "alpha", 1, 1.0), (1, "a", "beta", 2, 1.0), (1, "b", "beta", 1, 3.0), (1, "b", "alpha", 2, 3.0)]
    assert fuse(ranking(spark, rows), k=1).orderBy("rank").first()["id"] == "beta"
    off = [(q, r, i, n, 0.0 if r == "b" else 1.0) for q, r, i, n, _ in rows if not (r == "a" and i == "beta")]
    found = fuse(ranking(spark, off), k=1).collect()
    assert [r["id"] for r in found] == ["alpha"] and found[0]["contributions"] == {"a": 1}
    both = [(1, "vector", "b", 2, None), (1, "bm25", "b", 1, None)]
    assert fuse(ranking(spark, both)).select(explain(F.col("contributions"))).first()[0] == "bm25 #1 + vector #2"


def test_hybrid_routes(spark):
    index = bm25.build_index(spark.createDataFrame(CODE, "id long, text string"), "id", "text")
    asked = spark.createDataFrame([(1, "how is the token read?"), (2, "where is parse_jwt?")], "q long, text string")
    vector = spark.createDataFrame([(q, i, i + 1) for q in (1, 2) for i in (3, 2, 1)], "query_id long, id long, rank int")
    found = retrieval.hybrid(vector, index, asked, "q", "text").orderBy("query_id", "rank").collect()
    plain = [r for r in found if r["query_id"] == 1]
    assert [r["id"] for r in plain] == [1, 2, 3] and all(set(r["contributions"]) == {"vector"} for r in plain)
    assert any("bm25" in r["contributions"] for r in found if r["query_id"] == 2)


def test_rerank(spark):
    rows = spark.createDataFrame([(1, "alpha", 1, 0.1), (1, "beta", 2, 0.5), (1, "gamma", 3, 0.9), (1, "delta", 31, 9.0)], "query_id int, id string, rank int, s double")
    found = retrieval.rerank(rows, F.col("s"), k=2).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in found] == [("gamma", 1), ("beta", 2)]


def test_vector_blocks(spark, monkeypatch):
    import numpy as np

    from lodestone.operators import vectors

    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist(), i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 8, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, vector_topk(df, df.filter("vec_id % 10 = 0 AND embedding IS NOT NULL"), 5).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 2)
    monkeypatch.setattr(vectors, "SCAN_BYTES", 200)
    parts = sorted(map(tuple, vector_topk(df, df.filter("vec_id % 10 = 0 AND embedding IS NOT NULL"), 5).collect()))
    assert whole == parts and all(r[1] == r[0] for r in whole if r[3] == 1)


def test_vector_search_holds_a_tile_of_scores(spark):
    import tracemalloc
    from unittest.mock import MagicMock

    import numpy as np
    import pandas as pd

    from lodestone.operators import vectors

    rng, rows = np.random.default_rng(2), MagicMock()
    queries = rng.normal(size=(1024, 8))
    data = rng.normal(size=(10_000, 8))
    data[::2] = data[0]  # half of the rows are one vector, so that scores tie
    rows.sparkSession.sparkContext.broadcast = lambda value: MagicMock(value=value)
    vectors._scan(rows, list(range(1024)), list(queries), 5, "id", "v", None, ("bigint", "bigint"))
    run = rows.select.return_value.filter.return_value.mapInPandas.call_args[0][0]
    batch = pd.DataFrame({"id": np.arange(10_000), "v": list(data)})
    tracemalloc.start()
    found = pd.concat(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6  # all scores at once are 82 MB, and several times that with their order
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit(data) @ unit(queries[:20]).T, 9)
    for n in range(20):
        best = sorted(range(10_000), key=lambda i: (-scores[i, n], i))[:5]
        assert found[found["query_id"] == n].sort_values(["score", "id"], ascending=[False, True])["id"].tolist() == best


def test_vector_rows_in_slices(spark, monkeypatch):
    from lodestone.operators import vectors

    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)], i % 2) for i in range(40)], "vec_id long, embedding array<float>, label int")
    for group in (None, "label"):
        whole = sorted(map(tuple, vector_topk(df, df.filter("vec_id < 4"), 3, group_col=group).collect()))
        with monkeypatch.context() as m:
            m.setattr(vectors, "TILE", 4)
            m.setattr(vectors, "ROW_BYTES", 100)
            assert sorted(map(tuple, vector_topk(df, df.filter("vec_id < 4"), 3, group_col=group).collect())) == whole


def test_terms_are_held_for_a_slice_of_a_batch(spark):
    from unittest.mock import MagicMock

    import pyarrow as pa

    docs = MagicMock(schema=spark.createDataFrame([], "id long, text string").schema)
    bm25.term_table(docs, "id", "text")
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    texts = [None, "", *[f"word{i} and word{i}" for i in range(5000)], "long " * 500_000, "é" * 10, "last"]
    found = list(run(iter([pa.record_batch({"id": list(range(len(texts))), "text": texts}), pa.record_batch({"id": [9999], "text": ["x"]}), pa.record_batch({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})])))
    assert max(b.num_rows for b in found) <= 1000
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["id"] for r in rows] == [*range(len(texts)), 9999]
    assert rows[2] == {"id": 2, "length": 2, "terms": [{"term": "word0", "tf": 2}]}
    assert rows[0]["length"] == 0 and rows[-4]["length"] == 500_000 and rows[-2]["terms"] == [{"term": "last", "tf": 1}]
