import hashlib
from collections import defaultdict

from lodestone.llm import exact_dedup
from tests.llm.fixtures import frame, messy_rows

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").translate(LOW).encode()).hexdigest()


def test_groups_equal_brute_force(spark):
    rows = messy_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[sha(r[1])].append(r[0])
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    want = sorted((r[0], max(groups[sha(r[1])]), len(groups[sha(r[1])]), r[0] == max(groups[sha(r[1])]), sha(r[1])) for r in rows)
    assert sorted(map(tuple, found)) == want


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "É", *[None] * 8), (2, "é", *[None] * 8), (3, "A", *[None] * 8), (4, "a", *[None] * 8)]
    kept = {r["doc_id"] for r in exact_dedup.exact_groups(frame(spark, rows)).filter("kept").collect()}
    assert kept == {1, 2, 4}


def test_repeated_rows_keep_one(spark):
    rows = [(7, "same", *[None] * 8)] * 3 + [(None, "same", *[None] * 8), (5, "other", *[None] * 8)]
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    same = [r for r in found if r["group_size"] == 4]
    assert len(same) == 4 and all(r["keep_id"] == 7 for r in same)
    assert sum(r["kept"] for r in same) == 1 and len(found) == 5


def test_drop_keeps_columns_and_one_row_a_text(spark):
    rows = messy_rows() + [messy_rows()[-1]] * 2
    docs = frame(spark, rows)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert len({sha(r["text"]) for r in got}) == len(got) == len({sha(r[1]) for r in rows})
    best = {}
    for r in rows:
        best[sha(r[1])] = max(best.get(sha(r[1]), -1), r[0])
    assert {r["doc_id"] for r in got} == set(best.values())


def test_empty(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0


def test_unique_rows_are_proved_single(spark):
    keys = spark.range(2000).selectExpr("sha2(cast(id as string), 256) as sha")
    bits = exact_dedup.filter_bits(2000)
    pages = exact_dedup.repeated_slots(keys, "sha", bits)
    flagged = exact_dedup.flag_possible_repeats(keys, pages, "sha", bits, "flag").filter("flag").count()
    assert flagged < 60
    twice = keys.union(keys)
    pages = exact_dedup.repeated_slots(twice, "sha", bits)
    assert exact_dedup.flag_possible_repeats(twice, pages, "sha", bits, "flag").filter("flag").count() == 4000
