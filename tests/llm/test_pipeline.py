import re
from collections import Counter, defaultdict

import corpus_pipeline
from lodestone.llm import mixing, shared, toxicity
from tests.llm.fixtures import frame, messy_rows, write_tables
from tests.llm.test_near_dedup import brute, near_cluster
from tests.llm.test_toxicity import labelled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_equal_brute_force(spark, tmp_path):
    toxic_rows, labels = labelled(300)
    rows = messy_rows(n=60) + near_cluster(n=30) + [(10_000 + r[0], *r[1:], *[None] * 5) for r in toxic_rows]
    folder = write_tables(spark, tmp_path, rows, [(10_000 + i, q, t) for i, q, t in labels])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], folder).write.parquet(f"{tmp_path}/out{i}")
        seen.append(spark.read.parquet(f"{tmp_path}/out{i}"))
    tables = [[tuple(r) for r in df.collect()] for df in seen]
    assert all(df.columns == docs.columns for df in seen[1:-1])

    scored, name = toxicity.score_documents(docs, toxicity.learn(spark, docs, folder))
    clean = {r["doc_id"] for r in scored.filter(f"{name}.score < 0.5").collect()}
    assert Counter(tables[1]) == Counter(r for r in tables[0] if r[0] in clean)
    marks = {10_000 + i: t for i, _, t in labels}
    gone = {r[0] for r in tables[0]} - clean
    assert sum(marks.get(i, 0) for i in gone) >= 0.9 * sum(marks.values()) and all(marks.get(i) for i in gone if i in marks)

    best = defaultdict(lambda: -1)
    norm = lambda t: (t or "").translate(str.maketrans(shared.UPPER, shared.LOWER))
    for r in tables[1]:
        best[norm(r[1])] = max(best[norm(r[1])], r[0])
    assert Counter(tables[2]) == Counter(r for r in tables[1] if best[norm(r[1])] == r[0])

    groups = brute(tables[2], 5, 80)
    assert Counter(tables[3]) == Counter(r for r in tables[2] if groups[r[0]][1] == r[0])

    size = lambda t: len(WORD.findall(t or ""))
    total, taken, by_id, full = Counter(), Counter(), Counter(), {r[0]: r for r in tables[3]}
    for r in tables[3]:
        total[r[3]] += size(r[1])
    for r in tables[4]:
        taken[r[3]] += size(r[1])
        by_id[r[0]] += size(r[1])
        assert r[2:4] == full[r[0]][2:4] and (r[4] == len(r[1]) or r == full[r[0]]) and WORD.findall(full[r[0]][1])[: size(r[1])] == WORD.findall(r[1])
    want = mixing.targets(dict(total))
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in total) and all(n <= 3 * size(full[i][1]) for i, n in by_id.items())

    pieces = seen[5].collect()
    assert sum(r["piece"] == 0 for r in pieces) == len(tables[4])
    places = defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048


def test_run_gives_the_last_stage(spark, tmp_path):
    folder = write_tables(spark, tmp_path, messy_rows(n=50), [(0, 1, 0), (3, 1, 1)])
    found = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0


def test_empty_documents_and_labels(spark, tmp_path):
    folder = write_tables(spark, tmp_path, [])
    found = corpus_pipeline.run(spark, folder)
    assert found.count() == 0 and "sequence_id" in found.columns


def test_stages_keep_columns_with_the_names_of_their_own(spark, tmp_path):
    toxic_rows, labels = labelled(60)
    rows = messy_rows(n=40) + [(10_000 + r[0], *r[1:], *[None] * 5) for r in toxic_rows]
    folder = write_tables(spark, tmp_path, rows, [(10_000 + i, q, t) for i, q, t in labels])
    more = ("score", "gone", "sha", "__sha", "repeated", "bits", "page", "slot", "draws", "taken", "target", "size", "component_id", "kept")
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", *[f"'{c}' AS {c}" for c in more])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        assert all(r[c] == c for r in found.collect() for c in more), name


def test_stages_shrink_the_heap_first(spark, tmp_path):
    docs = frame(spark, messy_rows(n=30)).select("doc_id", "text", "lang", "source", "n_chars")
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    for name, stage in corpus_pipeline.STAGES[3:]:
        before = full()
        stage(spark, docs, str(tmp_path))
        assert full() > before, name
