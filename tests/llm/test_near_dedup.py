import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_dedup as nd
from lodestone.llm.components import components
from tests.llm.fixtures import frame, messy_rows, words


def shingles(text, size):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    sets = {r[0]: shingles(r[1], size) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_cluster(seed=6, n=150, length=150):
    """One large group whose members differ by none to many words, around the threshold."""
    rng = random.Random(seed)
    base, rows = words(rng, length).split(), []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10_000)}"
        if rng.random() < 0.2:
            w = w[: -rng.randrange(1, 20)]
        rows.append((1000 + i, " ".join(w), *[None] * 8))
    return rows


@pytest.mark.parametrize(("size", "percent", "lists"), [(3, 85, 4), (5, 80, 1), (5, 80, 1000)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, lists):
    monkeypatch.setattr(nd, "LISTS", lists)
    rows = messy_rows(n=80) + near_cluster()
    found = nd.near_components(frame(spark, rows), size=size, percent=percent).collect()
    want = brute(rows, size, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert len(found) == len(rows) and got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_drop_keeps_one_of_each_group(spark):
    rows = messy_rows(n=80) + near_cluster(n=40)
    docs = frame(spark, rows)
    kept = nd.drop_near_copies(docs, size=5, percent=80)
    want = brute(rows, 5, 80)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_columns_with_the_names_of_its_own(spark):
    rows = messy_rows(n=30)
    docs = frame(spark, rows).select("*", *[F.lit(1).alias(c) for c in ("gone", "__gone", "bits", "page", "hit", "a", "b", "component_id")])
    kept = nd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in brute(rows, 5, 80).items() if i == c)


def test_repeated_null_and_empty(spark):
    rows = [(4, "one two three four", *[None] * 8)] * 3 + [(None, "one two three four", *[None] * 8), (2, None, *[None] * 8), (1, "", *[None] * 8)]
    found = nd.near_components(frame(spark, rows), size=3, percent=85).collect()
    assert len(found) == 6
    assert {r["component_id"] for r in found if r["n_shingles"] == 2} == {None}
    assert {(r["doc_id"], r["component_id"]) for r in found if r["n_shingles"] == 0} == {(1, 1), (2, 2)}
    assert nd.near_components(frame(spark, [])).count() == 0
    assert nd.drop_near_copies(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (5, 5)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)} | {200: 200, 201: 200}


def test_overlap_floor_is_safe():
    from math import comb

    for percent in (80, 85, 95):
        x = nd.overlap_floor(nd.K, percent)
        p = percent / 100
        assert sum(comb(nd.K, i) * p**i * (1 - p) ** (nd.K - i) for i in range(x)) <= nd.LOSS < 1e-8


def test_sketch_estimate_never_misses_equal_sets():
    groups = defaultdict(list)
    for r in near_cluster(n=20):
        groups[len(nd.shingle_set(r[1], 3))].append(nd.shingle_set(r[1], 3))
    for sets in groups.values():
        for s in sets:
            assert nd.may_be_linked(s[: nd.K], s[: nd.K], nd.overlap_floor(nd.K, 85), 85)


def test_components_go_on_until_stable(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.components.ROUNDS", 1, raising=False)
    order = random.Random(2).sample(range(64), 64)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {tuple(r) for r in components(links).collect()} == {(i, 0) for i in range(64)}
