"""Exact dedup by two-pass Bloom filtering, with DataFrame and SQL functions only.

Pass 1 counts, for each slot of a fixed-size two-hash Bloom filter, whether it was hit
more than once, and keeps the slots hit twice as bitmaps.  Pass 2 tests each row: a row
one of whose slots was hit once only is the single owner of its text and passes straight
through.  Only the rest, the possibly repeated hashes, shuffles, by the hash of the text;
an exact grouping by SHA-256 of the normalised text then decides.

Defined results
---------------
* Null text counts as empty text, so null and empty rows are copies of each other.
* Of equal texts, the row with the largest id stays; a null id ranks below any other.
* Identical ids with identical texts (repeated rows): each counts in ``group_size`` and is
  reported, exactly one is kept.
* An empty table gives an empty report.
* Extra columns are carried by ``drop_exact_copies`` and may have any name.

Scale: the filter has 16 bits a row, 2**16 at least and 2**31 (256 MB) at most, so what is
broadcast never exceeds 256 MB.  Pass 1 shuffles the filter's positions that rows hit, summed a task
(some 20 bytes a row), not the rows; no built-in function merges counting filters of tasks as
bitmaps.  Beyond about 130 million rows the filter fills up and more single rows shuffle (their
key only, never their text, in the report); results do not change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import ascii_lower, cut, fresh

MIN_BITS, MAX_BITS, BITS_PER_ROW = 1 << 16, 1 << 31, 16
#: A bitmap of SQL's bitmap functions covers so many positions.
PAGE = 32768
SALTS = 16


def filter_bits(rows: int, most: int = MAX_BITS) -> int:
    bits = MIN_BITS
    while bits < min(most, BITS_PER_ROW * rows):
        bits *= 2
    return bits


def text_hash(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with A-Z lower-cased."""
    return F.sha2(ascii_lower(text), 256)


def _slot(sha: str, which: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.col(sha), F.lit(which)), F.lit(bits))


def repeated_slots(keys: DataFrame, sha: str, bits: int) -> DataFrame:
    """Pass 1: (page, bitmap) of the slots that more than one insertion hit."""
    slots = keys.select(F.explode(F.array(_slot(sha, 1, bits), _slot(sha, 2, bits))).alias("slot"))
    twice = slots.groupBy("slot").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.groupBy(F.expr(f"slot div {PAGE}").alias("page")).agg(
        F.expr(f"bitmap_construct_agg(slot % {PAGE})").alias("bits")
    )


def _hit(bits: str, slot: Column) -> Column:
    at = F.pmod(slot, F.lit(PAGE))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def flag_possible_repeats(df: DataFrame, pages: DataFrame, sha: str, bits: int, flag: str) -> DataFrame:
    """Pass 2: add ``flag``, false where a Bloom slot proves the row's text unique."""
    for i in (1, 2):
        page, bitmap, hit = fresh(df, f"page{i}", f"bits{i}", f"hit{i}")
        small = F.broadcast(pages.select(F.col("page").alias(page), F.col("bits").alias(bitmap)))
        slot = _slot(sha, i, bits)
        df = df.join(small, F.floor(slot / PAGE) == F.col(page), "left").withColumn(hit, _hit(bitmap, slot)).drop(page, bitmap)
        if i == 1:
            first = hit
    return df.withColumn(flag, F.col(first) & F.col(hit)).drop(first, hit)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_hash(F.col(f"`{text_col}`")).alias("text_sha256")))
    bits = filter_bits(keys.count())
    pages = cut(repeated_slots(keys, "text_sha256", bits))
    keys = flag_possible_repeats(keys, pages, "text_sha256", bits, "repeated")
    single = keys.filter(~F.col("repeated")).select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    rows = keys.filter("repeated").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    # a group may hold a third of all rows: its one line is copied to every salt, its rows are dealt over them
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    found = dealt.join(salted, ["text_sha256", "salt"]).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return single.unionByName(
        found.select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of equal texts the one with the largest id."""
    sha, flag, row = fresh(docs, "sha", "repeated", "row")
    hashed = docs.withColumn(sha, text_hash(F.col(f"`{text_col}`")))
    keys = cut(hashed.select(F.col(sha).alias("sha")))
    bits = filter_bits(keys.count())
    pages = cut(repeated_slots(keys, "sha", bits))
    hashed = flag_possible_repeats(hashed, pages, sha, bits, flag)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = hashed.filter(~F.col(flag)).select(*columns)
    # each task keeps one row of a group before the shuffle, so that hot groups shrink at once
    rank = F.struct(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    best = (
        hashed.filter(flag)
        .select(sha, rank.alias(flag), F.struct(*columns).alias(row))
        .groupBy(sha)
        .agg(F.max_by(row, flag).alias(row))
    )
    return single.union(best.select(f"{row}.*"))


SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM h
"""


def query(spark, sf_dir):
    from lodestone.llm.shared import table

    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
