import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics


def test_recall_and_rank(spark):
    gold = spark.createDataFrame([(1, i, f"f{i}", f"s{i}") for i in (1, 2, 3)] + [(2, 1, "f9", "s9")], "query_id int, answer_id int, file string, symbol string")
    results = spark.createDataFrame([(1, 1, "x", "y"), (1, 2, "f1", "s1"), (1, 3, "f2", "s2"), (1, 4, "f1", "s1")], "query_id int, position int, file string, symbol string")
    found = {r["query_id"]: r for r in metrics.question_metrics(metrics.matched(results, gold, ["file", "symbol"]), (0, 2, 3)).collect()}
    assert found[1]["recall_0"] == 0 and found[1]["recall_2"] == pytest.approx(1 / 3) and found[1]["recall_3"] == pytest.approx(2 / 3)
    assert found[1]["rr"] == 0.5 and found[1]["hit_2"] and not found[1]["hit_0"] and found[2]["rr"] == 0 and not found[2]["hit_3"]


def test_slices_keep_null(spark):
    rows = spark.createDataFrame([("a", "x", 1.0, None), ("a", "y", 0.0, None), ("b", "y", 0.5, 1.0)], "split string, style string, recall double, accuracy double")
    found = metrics.slice_report(rows, [["split"], ["split", "style"]], {"recall": F.avg("recall"), "cell": metrics.cell(F.avg("accuracy"))}).collect()
    got = {(r["split"], r["style"]): (r["recall"], r["cell"]) for r in found}
    assert got[("a", None)] == (0.5, "n/a") and got[("b", None)] == (0.5, "1.000") and len(got) == 5


def test_stratified_head(spark):
    rows = spark.createDataFrame([(i, "k" if i % 2 else "l") for i in range(20)], "ord int, kind string")
    assert sorted(r["ord"] for r in metrics.stratified_head(rows, ["kind"], "ord", limit=8, groups=4).collect()) == [0, 1, 2, 3]
    assert metrics.stratified_head(rows, ["kind"], "ord", limit=1, groups=4).count() == 2


def test_markdown():
    assert metrics.markdown([{"a": 1, "b": "n/a"}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 1 | n/a |"
