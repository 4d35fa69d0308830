"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents, in a seeded pseudo-random order, form one stream of words.  The
mix takes from each source a prefix of that stream, repeated from its start where the
target exceeds the source, so that the words taken equal the rounded target.  The prefix
is cut into blocks of whole documents, each of those that start within so many words.  A
tree over the output shards splits the exact block quotas of all sources: at each node, the
composition of the left half is one draw of the multivariate hypergeometric law, the right
half gets the rest.  Each source's blocks are permuted and handed to the shards in disjoint
ranges as long as their quotas; within a shard, rows get a local random order.

Defined results
---------------
* Null text has size 0; a source whose documents all have size 0 has target 0.
* A null source is a source of its own, last in the order of weights.
* Equal rows have the same place in the order, next to each other, and are taken by it.
* Only the last document taken of a source may be cut: its text up to the end of the last
  word taken, white space as it stands.  A document without a word is never taken.
* An empty table gives an empty result.  Same rows and seed, same mix.

Scale: texts are not shuffled by ``mix_plan``; prefix sums have two levels, (source, bucket) on the
cluster and one number per bucket, so a source with a third of all rows is dealt over as
many tasks as its buckets.  Per source, a few totals go to the driver, which holds one number for
each source and shard, ``NUMBERS`` at most: output shards are as many as ``WORDS_PER_SHARD`` fills,
``MAX_SHARDS`` and ``NUMBERS`` by the number of sources at most, and larger beyond that.  A shard
has about ``BLOCKS_PER_SHARD`` blocks, so that its words are as even as documents allow.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import WORD, cut, fresh, table

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
ROWS_PER_BUCKET = 10_000
WORDS_PER_SHARD = 2_000_000
BLOCKS_PER_SHARD = 256
MAX_SHARDS = 1 << 16
#: Numbers that the driver holds, one a source and shard.
NUMBERS = 1 << 24
#: The shards' last blocks are looked up in groups of so many.
FAN = 256
#: The table of sources is broadcast up to so many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20
#: What the cluster has to know of a source.
PLAN = pa.struct(
    [
        *[(c, pa.float64() if c == "goal" else pa.int64()) for c in ("total", "goal", "quota", "pass", "blocks", "mul", "add")],
        ("ends", pa.list_(pa.list_(pa.int64()))),
    ]
)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Water-filling: shares by weight of the total, none above ``cap`` times its source's size."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, active, out = float(sum(sizes.values())), list(order), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if rest * weight[s] / total > cap * sizes[s]]
        if not over:
            out.update({s: rest * weight[s] / total for s in active})
            break
        for s in over:
            out[s] = float(cap * sizes[s])
        rest = max(0.0, rest - sum(out[s] for s in over))
        active = [s for s in active if s not in out]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each shard its exact number of blocks from each source, drawn down a binary tree."""
    rng = np.random.default_rng(seed)
    out: list[list[int]] = [[] for _ in range(shards)]

    def down(lo: int, hi: int, here: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = [int(x) for x in here]
            return
        mid = (lo + hi) // 2
        take = int(here.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(here, take, method="marginals") if here.sum() else here
        down(lo, mid, left)
        down(mid, hi, here - left)

    down(0, shards, np.array(quotas, dtype=np.int64))
    return out


def _coprime(n: int, rng: random.Random) -> int:
    while True:
        a = rng.randrange(max(1, n // 3), n + 1)
        if math.gcd(a, n) == 1:
            return a


def mix_plan(
    docs: DataFrame,
    size_col: str,
    id_col: str = "doc_id",
    source_col: str = "source",
    shards: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns added for its part in the mix; returns (rows, names of the added columns).

    ``size_col`` holds each document's words, not null.  Added: source_size, target, taken
    (words) and draws, an array of (shard, block, place, words) with one entry for each time
    the document is taken, in whole or as its first ``words`` words; ``block`` numbers the
    blocks of a source, all of whose documents go to the shard that has it.
    """
    keys = ("source_size", "target", "taken", "draws")
    names = dict(zip(keys, fresh(docs, *keys), strict=True))
    key, src, bucket, before, block, first, plan, start = fresh(docs, "key", "src", "bucket", "before", "block", "first", "plan", "start")
    words, blocks = fresh(docs, "words", "blocks")
    size, ident = F.col(f"`{size_col}`"), F.col(f"`{id_col}`")
    source = F.col(f"`{source_col}`").cast("string")
    n = docs.count()
    bits = max(4, min(24, math.ceil(math.log2(max(1, n / ROWS_PER_BUCKET)))))
    rows = docs.withColumn(key, F.xxhash64(F.lit(seed), ident)).withColumns(
        {
            src: F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)),
            bucket: F.shiftrightunsigned(key, 64 - bits),
        }
    )
    light = cut(rows.select(src, bucket, key, ident, size))
    total = {r[0]: r[1] for r in light.groupBy(src).agg(F.sum(size)).toLocalIterator()}
    name = {s: None if s == "n" else s[1:] for s in total}
    goal = targets({name[s]: w for s, w in total.items()})
    quota = {s: min(CAP * total[s], round(goal[name[s]])) for s in total}
    shards = shards or max(1, min(MAX_SHARDS, NUMBERS // max(1, len(total)), -(-sum(quota.values()) // WORDS_PER_SHARD)))
    width = max(1, sum(quota.values()) // (shards * BLOCKS_PER_SHARD))
    local = Window.partitionBy(src, bucket).orderBy(key, ident, size)
    earlier = local.rowsBetween(Window.unboundedPreceding, -1)

    def placed(rows: DataFrame) -> DataFrame:
        """Adds the words before a row in its bucket, and whether it is the first document of a block."""
        rows = rows.withColumn(before, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
        last = F.max(F.when(size > 0, F.floor(F.col(before) / width))).over(earlier)
        opens = (size > 0) & (last.isNull() | (last < F.floor(F.col(before) / width)))
        return rows.withColumn(first, opens.cast("long"))

    level = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut(placed(light).groupBy(src, bucket).agg(F.sum(size).alias(words), F.sum(first).alias(blocks)))
    offsets = sums.select(src, bucket, *[F.coalesce(F.sum(c).over(level), F.lit(0)).alias(c) for c in (words, blocks)])
    # blocks of a whole pass over a source, and of its last pass, which ends within the stream
    # tables of the driver's go as Arrow: lists of rows would start further Python workers, which stay on the executors
    ends_in = pa.array([quota[s] % total[s] if total[s] else 0 for s in total], pa.int64())
    rest = docs.sparkSession.createDataFrame(pa.table({src: pa.array(list(total), pa.string()), start: ends_in}))
    opened = placed(light).filter(F.col(first) == 1).join(offsets, [src, bucket]).join(rest, src)
    opened = opened.groupBy(src).agg(F.count("*").alias(blocks), F.count_if(F.col(before) + F.col(words) < F.col(start)).alias(words))
    whole = {r[0]: (r[1], r[2]) for r in opened.toLocalIterator()}
    order = sorted(total)
    counts = [quota[s] // total[s] * whole[s][0] + whole[s][1] if total[s] else 0 for s in order]
    per_shard = split_quotas(counts, shards, seed)
    lines = []
    for i, s in enumerate(order):
        rng = random.Random(f"{seed}:{s}")
        count = max(1, counts[i])
        ends = np.cumsum([shard[i] for shard in per_shard]).tolist()
        ends = [ends[j : j + FAN] for j in range(0, shards, FAN)]
        values = (total[s], goal[name[s]], quota[s], whole.get(s, (0, 0))[0], count, _coprime(count, rng), rng.randrange(count), ends)
        lines.append(dict(zip(PLAN.names, values, strict=True)))
    sources = docs.sparkSession.createDataFrame(pa.table({src: pa.array(order, pa.string()), plan: pa.array(lines, PLAN)}))
    if 8 * shards * len(lines) <= BROADCAST_BYTES:
        sources = F.broadcast(sources)
    rows = placed(rows).withColumn(block, F.sum(first).over(local.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.join(offsets, [src, bucket]).join(sources, src).withColumn(start, F.col(before) + F.col(words))
    of = lambda field: F.col(f"{plan}.{field}")

    def draw(i):
        at = of("total") * i + F.col(start)
        taken = F.least(F.greatest(of("quota") - at, F.lit(0)), size)
        number = of("pass") * i + F.col(blocks) + F.col(block)
        # number * mul may pass 64 bits from some 3e9 blocks a source on
        moved = F.pmod(number.cast("decimal(20,0)") * of("mul").cast("decimal(18,0)") + of("add"), of("blocks")).cast("long")
        group = F.size(F.filter(of("ends"), lambda e: F.element_at(e, -1) <= moved))
        shard = group * FAN + F.size(F.filter(F.get(of("ends"), group), lambda e: e <= moved))
        return F.struct(shard.alias("shard"), number.alias("block"), F.xxhash64(F.lit(seed + 1), ident, i).alias("place"), taken.alias("words"))

    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(CAP)), draw), lambda d: d["words"] > 0)
    rows = rows.withColumns({names["draws"]: draws, names["source_size"]: of("total"), names["target"]: of("goal")})
    rows = rows.withColumn(names["taken"], F.aggregate(F.col(names["draws"]), F.lit(0).cast("long"), lambda a, d: a + d["words"]))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *names.values()), names


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, one row each time a document is taken.

    Rows are dealt to the output shards as the tree says and lie in each shard in its local
    random order.  Where only the first words are taken, the text is cut at the end of
    the last of them and a column ``n_chars`` is set to the new length.
    """
    (size,) = fresh(docs, "size")
    rows, names = mix_plan(docs.withColumn(size, word_count(F.col(f"`{text_col}`"))), size, id_col, source_col, shards, seed)
    (one,) = fresh(rows, "one")
    rows = rows.withColumn(one, F.explode(names["draws"]))
    text, words = F.col(f"`{text_col}`"), F.col(f"{one}.words").cast("int")
    cutting = words < F.col(size)
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))  # each word with the space before it
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest(words, F.lit(1))), "")
    rows = rows.withColumn(text_col, F.when(cutting, first).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(cutting, F.length(text).cast(kind)).otherwise(F.col("n_chars")))
    rows = rows.repartition(F.col(f"{one}.shard")).sortWithinPartitions(f"{one}.shard", f"{one}.place")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    """doc_id, size, source_size, target, taken, and the shards that the document goes to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    rows, names = mix_plan(cut(docs), "size")
    return rows.select(
        "doc_id",
        "size",
        F.col(names["source_size"]).alias("source_size"),
        F.col(names["target"]).alias("target"),
        F.col(names["taken"]).alias("taken"),
        F.transform(names["draws"], lambda d: d["shard"]).alias("shards"),
    )
