import re
from collections import defaultdict

import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from lodestone.llm import mixing
from tests.llm.fixtures import frame, messy_rows, write_tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_water_fill():
    t = mixing.targets({"a": 100, "b": 100, "c": 100})
    assert t == pytest.approx({"a": 50, "b": 100, "c": 150})
    t = mixing.targets({"a": 1000, "b": 10, None: 10})
    assert t["b"] == 30 and t[None] == 30 and t["a"] == pytest.approx(960)
    assert mixing.targets({}) == {}
    assert mixing.targets({"a": 0}) == {"a": 0}


def test_quotas_are_split_exactly():
    shards = mixing.split_quotas([5, 0, 1000, 37], 9, seed=4)
    assert [sum(s[i] for s in shards) for i in range(4)] == [5, 0, 1000, 37]
    sizes = [sum(s) for s in shards]
    assert max(sizes) - min(sizes) <= 9
    assert shards == mixing.split_quotas([5, 0, 1000, 37], 9, seed=4)


def test_plan_meets_targets(spark, tmp_path):
    rows = messy_rows(n=200)
    folder = write_tables(spark, tmp_path, rows)
    found = mixing.query(spark, folder).collect()
    again = mixing.query(spark, folder).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    source = {r[0]: r[3] for r in rows}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    totals, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        totals[r[3]] += size[r[0]]
    for r in found:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == totals[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    want = mixing.targets(dict(totals))
    assert len(found) == len(rows)
    for s in totals:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.5 + 1e-6
    assert sum(target.values()) == pytest.approx(sum(totals.values()))


def test_mix_takes_what_the_plan_says(spark):
    docs = frame(spark, messy_rows(n=120))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = defaultdict(int)
    for r in mixed.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    (size,) = ["__size"]
    rows, names = mixing.mix_plan(docs.withColumn(size, mixing.word_count(F.col("text"))), size)
    plan = {r["doc_id"]: r[names["taken"]] for r in rows.collect()}
    assert {k: v for k, v in plan.items() if v} == dict(words)


def test_shards_get_their_quotas_of_whole_blocks(spark):
    docs = frame(spark, messy_rows(n=400)).withColumn("w", mixing.word_count(F.col("text")))
    plan, names = mixing.mix_plan(docs, "w", shards=7)
    of_block, held = {}, defaultdict(set)
    for r in plan.collect():
        for d in r[names["draws"]]:
            assert of_block.setdefault((r["source"], d["block"]), d["shard"]) == d["shard"]
            held[r["source"], d["shard"]].add(d["block"])
    many = defaultdict(int)
    for source, _ in of_block:
        many[source] += 1
    order = sorted(many, key=lambda s: "n" if s is None else "s" + s)
    for source in order:
        assert {b for s, b in of_block if s == source} == set(range(many[source]))
    quotas = mixing.split_quotas([many[s] for s in order], 7, seed=17)
    assert {(s, k): len(held[s, k]) for s in order for k in range(7)} == {(s, k): quotas[k][i] for i, s in enumerate(order) for k in range(7)}


def test_splits_follow_the_hypergeometric_law():
    quotas, shards, runs = [30, 10, 20], 4, 3000
    drawn = [mixing.split_quotas(quotas, shards, seed) for seed in range(runs)]
    for k in range(shards):
        for i, q in enumerate(quotas):
            x = [d[k][i] for d in drawn]
            mean, share, n = sum(x) / runs, q / sum(quotas), sum(quotas) // shards
            var = sum((v - mean) ** 2 for v in x) / runs
            want = n * share * (1 - share) * (sum(quotas) - n) / (sum(quotas) - 1)
            assert mean == pytest.approx(n * share, abs=4 * (want / runs) ** 0.5) and var == pytest.approx(want, rel=0.15)


def test_cut_text_keeps_its_white_space(spark):
    text = "\n one\ttwo\n\n  three " * 20
    mixed = mixing.mix(frame(spark, [(i, text, "en", f"s{i}", len(text), *[None] * 5) for i in range(3)])).collect()
    assert any(r["text"] != text for r in mixed)
    assert all(text.startswith(r["text"]) and r["n_chars"] == len(r["text"]) for r in mixed)


def test_one_hot_source_and_empty(spark):
    rows = [(i, "w " * 10, "en", "only", 20, *[None] * 5) for i in range(50)]
    docs = frame(spark, rows).withColumn("w", mixing.word_count(F.col("text")))
    plan, names = mixing.mix_plan(docs, "w")
    assert sum(r[names["taken"]] for r in plan.collect()) == 500
    empty = frame(spark, [])
    assert mixing.mix(empty).count() == 0
    nothing = frame(spark, [(1, None, None, None, None, *[None] * 5), (2, "", None, "a", 0, *[None] * 5)])
    assert mixing.mix(nothing).count() == 0


def test_tables_of_the_driver_start_no_python_workers(spark, monkeypatch):
    rows = messy_rows(n=50)
    docs = frame(spark, rows)
    before = mixing.mix(docs).count()
    monkeypatch.setattr(SparkContext, "parallelize", lambda *a, **b: 1 / 0)
    assert mixing.mix(docs).count() == before > 0
