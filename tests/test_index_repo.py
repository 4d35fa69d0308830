import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, index_repo, providers


def chunks(spark, extra=""):
    files = [("money.py", "def pay(x):\n    return x\n\ndef owe(y):\n    return y" + extra), ("bill.py", "class Bill:\n    def total(self):\n        return 1")]
    return chunking.chunk_files(spark.createDataFrame(files, "path string, text string"))


def embed(rows):
    return rows.withColumn("vector", F.array(F.length("document").cast("float"), F.lit(1.0).cast("float")))


def test_builds_are_incremental(spark, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(index_repo.MissingIndexError):
        index_repo.load_index(spark, folder)
    first = index_repo.build_index(spark, chunks(spark), folder, "m", embed)
    assert (first.chunks, first.computed, first.cached, first.pruned) == (4, 4, 0, 0)
    again = index_repo.build_index(spark, chunks(spark), folder, "m", embed)
    assert (again.chunks, again.computed, again.cached, again.pruned, again.hit_rate) == (4, 0, 4, 0, 1.0)
    edited = index_repo.build_index(spark, chunks(spark, " + 1"), folder, "m", embed)
    assert (edited.computed, edited.pruned) == (1, 0)
    fewer = index_repo.build_index(spark, chunks(spark).filter("file_path = 'bill.py'"), folder, "m", embed)
    assert (fewer.chunks, fewer.computed, fewer.pruned) == (2, 0, 2)
    empty = index_repo.build_index(spark, chunks(spark).limit(0), folder, "m", embed)
    tables = index_repo.load_index(spark, folder)
    assert empty.chunks == 0 and tables["vectors"].count() == 2 and tables["postings"].count() > 0
    other = index_repo.build_index(spark, chunks(spark), folder, "other model", embed)
    assert other.computed == 4 and index_repo.load_index(spark, folder)["vectors"].select("model").distinct().collect()[0][0] == "other model"


def test_providers():
    with pytest.raises(ValueError, match="echo"):
        providers.get_provider("nobody")
    assert providers.get_provider("scripted", {"a": "x"}, "y")(["ab", "b"]) == ["x", "y"]


def test_ablation_reuses_outcomes(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    ran = []

    def config(rows):
        ran.append(sorted(r["question_id"] for r in rows.collect()))
        return rows.select("question_id", F.lit(1).alias("position"), F.lit("x").alias("answer_id"), F.col("question").alias("answer"))

    prior = spark.createDataFrame([("one", 1, 1, "x", "old")], "config string, question_id int, position int, answer_id string, answer string")
    found = providers.run_ablation(asked, {"one": config, "two": config}, prior)
    assert ran == [[2], [1, 2]] and found.count() == 4
    assert len(spark.range(1).select(providers.fingerprint(k=8, model="m")).first()[0]) == 10


def test_a_tree_into_both_indexes(spark, tmp_path):
    root, folder = tmp_path / "repo", str(tmp_path / "index")
    for name, text in {"pay.py": "def parse_jwt(token):\n    return token\n", "lib/go.go": "package go\n\nfunc Other() {}\n", "README.md": "# Pay\nhow to pay\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    stats = index_repo.index_tree(spark, str(root), folder, "m", embed)
    assert stats.chunks == 4 and stats.computed == 4
    index = index_repo.open_index(spark, folder)
    asked = spark.createDataFrame([(1, "where is parse_jwt?", [1.0, 1.0])], "query_id int, question string, vector array<float>")
    from lodestone.operators import retrieval

    assert retrieval.bm25_search(index, asked, 3).first()["id"] == "pay.py:1-2#1"
    assert retrieval.vector_search(index, asked, 9).count() == 4
    for f in (tmp_path / "index").glob("v-*/postings/*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "index").glob("v-*/postings/.*.crc"):
        f.unlink()
    assert retrieval.bm25_search(index_repo.open_index(spark, folder), asked, 3).count() == 0


def test_vectors_of_texts_and_questions(spark):
    from lodestone.operators import index_build

    def load():
        return lambda texts: [[float(len(t)), 0.0, float(t.startswith("Represent"))] for t in texts]

    rows = spark.createDataFrame([(1, "abc", "abc"), (2, "", ""), (3, None, None)], "id int, document string, question string")
    found = {r["id"]: r["vector"] for r in index_build.embedder(load, batch=2)(rows).collect()}
    assert found == {1: [1.0, 0.0, 0.0], 2: [0.0, 0.0, 0.0], 3: [0.0, 0.0, 0.0]}
    asked = index_build.query_embedder(load)(rows).filter("id = 1").first()["vector"]
    assert asked[2] > 0 and abs(sum(x * x for x in asked) - 1) < 1e-6


def test_credentials(monkeypatch):
    providers.register_provider("hosted", lambda: (lambda prompts: prompts), credential="SOME_KEY")
    monkeypatch.delenv("SOME_KEY", raising=False)
    with pytest.raises(ValueError, match="SOME_KEY"):
        providers.get_provider("hosted")
    monkeypatch.setenv("SOME_KEY", "x")
    assert providers.get_provider("hosted")(["a"]) == ["a"]


def test_texts_stay_in_place(spark, tmp_path):
    """Ids, keys and terms move in a build, texts do not; chunks with one id or one text are found all the same."""
    columns = "code string, language string, file_path string, symbol string, kind string, start_line int, end_line int, part int, part_count int"
    rows = [(f"text {i}", "Text", f"d{i}.txt", "s", "doc", 1, 1, 1, 1) for i in range(100)]
    rows += [("later", "Text", "d3.txt", "t", "doc", 1, 1, 1, 1), ("text 3", "Text", "d3.txt", "s", "doc", 1, 1, 2, 2)]  # an id twice, a text twice
    chunks, seen, plan = spark.createDataFrame(rows, columns).repartition(4), [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan(index_repo.with_keys(chunks, "m"))

    def counted(missing):
        assert "hashpartitioning" not in plan(missing)
        seen.extend(r["document"] for r in missing.select("document").collect())
        return embed(missing)

    stats = index_repo.build_index(spark, chunks, str(tmp_path / "index"), "m", counted)
    assert (stats.chunks, stats.computed, len(seen), len(set(seen))) == (101, 100, 100, 100)
    tables = index_repo.load_index(spark, str(tmp_path / "index"))
    assert tables["vectors"].count() == tables["chunks"].count() == 101
    assert tables["chunks"].filter("chunk_id = 'd3.txt:1-1#1'").first()["document"] == "d3.txt\nText doc s\n\ntext 3"
    again = index_repo.build_index(spark, chunks.withColumn("code", F.when(F.col("symbol") == "t", "other").otherwise(F.col("code"))), str(tmp_path / "index"), "m", embed)
    assert (again.chunks, again.computed, again.cached) == (101, 0, 101)


@pytest.mark.parametrize("few", [0, 1, 3, 99])
def test_only_keeps_what_is_flagged(spark, monkeypatch, few):
    from lodestone import lineage

    monkeypatch.setattr(lineage, "FEW_ROWS", few)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(8)], "row long, text string")
    flags = rows.select("row", (F.col("row") % 4 != 1).alias("kept"))
    assert sorted(r["row"] for r in lineage.only(rows, flags, "row").collect()) == [0, 2, 3, 4, 6, 7]


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_scores_of_few_and_of_many_questions(spark, monkeypatch, few):
    from lodestone.operators import bm25

    monkeypatch.setattr(bm25, "FEW_ROWS", few)
    docs = spark.createDataFrame([(i, " ".join(f"word{j}" for j in range(i % 5 + 1)) + f" only{i}") for i in range(20)], "id long, text string")
    asked = spark.createDataFrame([(q, f"word{q} word4 only{q}") for q in range(5)], "q long, text string")
    found = bm25.bm25_scores(bm25.build_index(docs, "id", "text"), asked, "q", "text")
    assert found.count() == found.select("query_id", "id").distinct().count() == sum(1 for q in range(5) for i in range(20) if i % 5 >= q or i == q)
