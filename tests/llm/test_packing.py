import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from lodestone.llm import packing, shared
from tests.llm.fixtures import frame, messy_rows


def check_rules(counts, plan, capacity):
    """Every piece has one place and no two overlap."""
    used = defaultdict(list)
    keys, rules = plan.lookup()
    for length, n in counts.items():
        lengths, ranks = np.full(n, length, np.int64), np.arange(n, dtype=np.int64)
        seq, off = packing.locate(lengths, ranks, keys, rules)
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            used[s].append((o, length))
    assert len(used) == plan.sequences
    for places in used.values():
        at = 0
        for o, length in sorted(places):
            assert o == at
            at += length
        assert at <= capacity


def test_plans_are_gapless_and_tight():
    rng = random.Random(2)
    for seed in range(6):
        counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1.1)))) for _ in range(3000 + 500 * seed))
        plan = packing.best_plan(counts)
        check_rules(counts, plan, 2048)
        bound = -(-sum(k * n for k, n in counts.items()) // 2048)
        assert plan.sequences <= bound * 1.01 + 1


def optimum(pieces, capacity):
    """The least number of bins, by trying all placements."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= pieces[i] and rooms[j] not in rooms[:j]:
                place(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_small_cases_against_the_optimum():
    rng, over = random.Random(6), 0
    for _ in range(300):
        pieces = sorted((rng.choice([rng.randrange(1, 2049), rng.randrange(600, 1100)]) for _ in range(rng.randrange(1, 11))), reverse=True)
        plan, least = packing.best_plan(Counter(pieces)), optimum(pieces, 2048)
        check_rules(Counter(pieces), plan, 2048)
        assert least <= plan.sequences <= least + 1
        over += plan.sequences > least
    assert over <= 15


def test_every_setting_is_valid():
    counts = {700: 10, 699: 3, 1024: 7, 1025: 2, 1: 50, 2048: 4, 2047: 5, 513: 9, 340: 20}
    for large in (0.125, 0.25, 0.34, 0.5, 1.0):
        for groups in (1, 2, 7, 48):
            check_rules(counts, packing.Plan(counts, 2048, large, groups), 2048)
    assert packing.best_plan({}).sequences == 0


def test_groups_have_equal_cardinality():
    groups = packing._groups({5: 10, 6: 10, 9: 3}, 4)
    assert [sum(g.values()) for g in groups] == [6, 6, 6, 5]
    assert all(min(a) >= max(b) for a, b in zip(groups, groups[1:], strict=False))


def test_pieces_equal_the_library(spark):
    rows = messy_rows()
    found = packing.pack(frame(spark, rows), with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        at = 0
        for i, p in enumerate(sorted(by_doc[r[0]], key=lambda p: p["piece"])):
            part = ids[at : at + p["length"]]
            assert (p["piece"], p["start"], p["ids"]) == (i, at, part) and (i == 0 or p["length"] == 2048)
            assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    places = defaultdict(list)
    for p in found:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048


def test_repeated_rows_and_empty(spark):
    rows = [(1, "same text", *[None] * 8)] * 5
    found = packing.pack(frame(spark, rows)).collect()
    assert len(found) == 5 and len({(r["sequence_id"], r["offset"]) for r in found}) == 5
    assert packing.pack(frame(spark, [])).count() == 0


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    seen, cut, usual = [], packing.cut, spark.conf.get(shared.BATCH_ROWS)
    monkeypatch.setattr(packing, "cut", lambda df: seen.append(int(spark.conf.get(shared.BATCH_ROWS))) or cut(df))
    assert packing.pack(frame(spark, messy_rows())).count() >= 60
    assert seen and all(0 < n <= shared.TEXT_ROWS for n in seen)
    assert spark.conf.get(shared.BATCH_ROWS) == usual

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    with shared.text_batches(spark):
        found = shared.cut(spark.range(0, 2500, 1, 1).mapInArrow(sizes, "n long"))
    assert sorted(r["n"] for r in found.collect()) == [500, 1000, 1000]
