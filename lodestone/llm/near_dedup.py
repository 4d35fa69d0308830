"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles, hashed by one function to 64 bits; the ``K``
   least hashes are its sketch.  Texts with equal sets form one class, by a 128-bit digest
   of the set; from here on a class is one node, its least id.
2. Inverted lists of the retained values: of two linked texts, the least ``K`` values of the
   union hold almost surely at least ``least_overlap`` values of both sketches.  A class with
   fewer values that any other class retains has no link and leaves.
3. With the values of each sketch ordered by the length of their lists, a linked pair meets in
   one of the first ``k - least_overlap + 1``.  Of these lists, one in ``LISTS`` (all of a set
   smaller than its sketch) links its members to one hub, the member with the fewest rarer values.
4. Sizes, places in the lists and a 128-bit map of each whole set, of the parities of the
   shingles on each bit, bound the similarity; the sketch of the union gives the overlap and
   estimates; the whole sets verify, with integer arithmetic.
5. A sketch tells sets just below the threshold from linked ones only roughly, so that more
   precise lists add to these: those of the rarest shingles of whole sets (prefix filter).  They
   link to hubs, too.  In those that then have several components, each member outside the
   hub's component meets all members of other components; the bounds, the estimate and the
   whole sets decide as before.  So no link between components stays unseen, while the pairs
   inside a large group of copies are never written out.
6. Components of the verified links.

Defined results
---------------
* Null or empty texts, or texts without words, have an empty set and no links.
* A text with fewer words than a shingle has one shingle, the whole sequence.
* Equal texts and equal sets are linked; repeated rows each get a row.  Ids are taken as
  unique: rows that share an id share a node.
* An empty table gives an empty result.
* What is not exact: steps 2 and 3 lose a linked pair with a probability below 1e-9 a pair,
  and hashes of 64 bits may collide.

Scale: texts are never shuffled.  Classes shuffle as sketches (0.5 KB each), and sets move
only for classes that step 2 leaves and pairs that the estimate passes.  Broadcast are two
tables of fixed size: a bitmap of ids (64 MB at most; false hits only cost work) and counts of
shingles (4 MB; they only order the lists of step 5).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.exact_dedup import PAGE, _hit, filter_bits
from lodestone.llm.shared import SLOT_BLOCKS, cut, fresh, merged_slots, release, salted_join, slot_blocks, spread, sweep, table, text_batches

K = 64
LOSS = 1e-9
#: One in so many lists of retained values links to hubs.
LISTS = 4
SLOTS = 1 << 20
SALTS = 8
#: Stands for a null id, which comes before all others.
LOWEST = -(1 << 63)
#: Bits of a bitmap of ids, at most.
FILTER_BITS = 1 << 29


# ---------------------------------------------------------------- sets and sketches


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(w))
    m = len(w) - size + 1
    h = np.full(m, size, np.uint64)
    for j in range(size):
        h = (h ^ w[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def parities(s: np.ndarray) -> tuple[int, int]:
    """A set's map: whether each of 128 bits is that of an odd number of its members, in two halves."""
    one, high = np.uint64(1) << (s >> np.uint64(58)), s & np.uint64(1 << 57) != 0
    return int(np.bitwise_xor.reduce(one[~high]).view(np.int64)), int(np.bitwise_xor.reduce(one[high]).view(np.int64))


def overlap_floor(k: int, percent: int, loss: float = LOSS) -> int:
    """The most x with P(Binomial(k, percent/100) < x) <= loss."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > loss:
            return x
    return k


def needed(n: int, percent: int) -> int:
    """Values that two sets, one of size n, share at least if they are linked."""
    return -(-percent * n // 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def may_be_linked(a: np.ndarray, b: np.ndarray, floor: int, percent: int) -> bool:
    """Estimate from the sketch of the union of two sketches."""
    union = np.union1d(a, b)[:K]
    both = len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True))
    if len(union) < K:
        return 100 * both >= percent * len(union)
    return both >= floor


def sketched(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """doc_id, n, digest (null if n is 0), sketch and map of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, digest, sketch, bits = [], [], [], []
            for text in batch["text"]:
                s = shingle_set(text, size)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(s[:K].view(np.int64))
                bits.append(parities(s))
            low, high = zip(*bits, strict=True) if bits else ((), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "digest": digest, "sketch": sketch, "low": np.array(low, np.int64), "high": np.array(high, np.int64)})
        release()

    return _ids_and_texts(docs, id_col, text_col).mapInPandas(run, "doc_id long, n long, digest binary, sketch array<long>, low long, high long")


def _ids_and_texts(docs, id_col, text_col):
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


# ---------------------------------------------------------------- candidates


def _least_overlap(percent: int):
    """Values that the sketch of a set of size n shares at least with a linked one's, almost surely."""
    return F.least(F.expr(f"({percent} * n + 99) div 100"), F.lit(overlap_floor(K, percent)))


def _entries(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The classes with enough retained values that another class retains too, and their places in the lists of those: token (the list), at, node, n and map."""
    values = classes.select("node", F.explode("sketch").alias("value"))
    lists = values.groupBy("value").agg(F.count("*").alias("many")).filter("many > 1")
    kept = values.join(lists, "value").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "value"))).alias("v"))
    kept = kept.join(classes.select("node", "n", "low", "high"), "node")
    least = _least_overlap(percent)
    kept = cut(kept.filter(F.size("v") >= least))
    # values that no other class retains are the rarest ones and make no list
    kept = kept.withColumn("own", F.least("n", F.lit(K)) - F.size("v")).withColumn("keep", F.least("n", F.lit(K)) - least + 1)
    first = kept.select("node", "n", "low", "high", "own", "keep", F.posexplode("v").alias("i", "x"))
    first = first.filter((F.col("own") + F.col("i") < F.col("keep")) & ((F.col("n") < K) | (F.pmod(F.xxhash64("x.value"), F.lit(LISTS)) == 0)))
    return kept.select("node"), first.select(F.col("x.value").alias("token"), (F.col("own") + F.col("i")).cast("int").alias("at"), "node", "n", "low", "high")


def _slot(name: str, bits: int):
    return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(bits))


def _sets_of(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """node, set (sorted hashes, as bytes) and sketch of the rows whose id is in a bitmap of the nodes."""
    bits = filter_bits(nodes.count(), FILTER_BITS)
    slots = nodes.select(_slot("node", bits).alias("slot")).distinct()
    pages = slots.groupBy(F.expr(f"slot div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(slot % {PAGE})").alias("bits"))
    at = _slot("doc_id", bits)
    rows = docs.join(F.broadcast(pages), F.floor(at / PAGE) == F.col("page")).filter(_hit("bits", at)).select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(x, size) for x in batch["text"]]
            sketch = [s[:K].view(np.int64) for s in sets]
            yield pd.DataFrame({"node": batch["doc_id"], "set": [s.tobytes() for s in sets], "sketch": sketch})
        release()

    return rows.mapInPandas(run, "node long, set binary, sketch array<long>")


def _as_set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _slot_of(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of SLOTS slots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_slot_of(np.concatenate([_as_set(x) for x in batch["set"]])), minlength=SLOTS)
        yield from slot_blocks(total)
        release()

    return merged_slots(sets.select("set").mapInPandas(run, SLOT_BLOCKS), SLOTS)


def _rare_entries(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Each set's rarest shingles, as many as a linked pair needs to meet: token, at, node, n and map."""
    held = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = held.value
        for batch in batches:
            parts = []
            for node, raw in zip(batch["node"], batch["set"], strict=True):
                s = _as_set(raw)
                n = len(s)
                at = np.arange(n - needed(n, percent) + 1)
                first = np.lexsort((s, count[_slot_of(s)]))[: len(at)]
                low, high = parities(s)
                parts.append((s[first].view(np.int64), at, *[np.full(len(at), x) for x in (node, n, low, high)]))
            if parts:
                yield pd.DataFrame({k: np.concatenate(c) for k, c in zip(("token", "at", "node", "n", "low", "high"), zip(*parts, strict=True), strict=True)})
        release()

    return sets.select("node", "set").mapInPandas(run, "token long, at int, node long, n long, low long, high long")


def _can_meet(a: str, b: str, percent: int, whole: bool = False):
    """Sizes, places and maps of two entries of one list allow a link; places are those in sketches or ``whole`` sets."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    size = (lambda n: n) if whole else (lambda n: F.least(n, F.lit(K)))
    room = F.least(size(na) - F.col(f"{a}.at"), size(nb) - F.col(f"{b}.at"))
    floor = F.least(F.ceil(F.greatest(na, nb) * percent / 100), F.lit(overlap_floor(K, percent)))
    enough = room * (100 + percent) >= percent * (na + nb) if whole else room >= floor
    apart = F.bit_count(F.col(f"{a}.low").bitwiseXOR(F.col(f"{b}.low"))) + F.bit_count(F.col(f"{a}.high").bitwiseXOR(F.col(f"{b}.high")))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & enough & (apart * (100 + percent) <= (100 - percent) * (na + nb))


def _star_pairs(entries: DataFrame, percent: int, whole: bool = False) -> DataFrame:
    """Each list's members with its hub; places are those in sketches or ``whole`` sets."""
    hubs = entries.groupBy("token").agg(F.min(F.struct("at", "node", "n", "low", "high")).alias("h"), F.count("*").alias("many"))
    hubs = hubs.filter("many > 1").select("token", "h.*")
    met = entries.alias("e").join(hubs.alias("h"), "token").filter(F.col("e.node") != F.col("h.node")).filter(_can_meet("e", "h", percent, whole))
    return met.select(F.least("e.node", "h.node").alias("a"), F.greatest("e.node", "h.node").alias("b")).distinct()


def _rest_pairs(entries: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a list and may be linked."""
    known = entries.join(comps.select("node", F.col("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = cut(known)
    lists = known.groupBy("token").agg(
        F.min(F.struct("at", "node", "component"))["component"].alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    lists = lists.filter("lo < hi").select("token", "main")
    open_ = known.join(lists, "token")
    left = open_.filter("component <> main").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = open_.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    met = left.alias("l").join(right.alias("r"), ["token", "salt"])
    met = met.filter(
        (F.col("l.component") != F.col("r.component"))
        & ((F.col("r.component") == F.col("r.main")) | (F.col("l.node") < F.col("r.node")))
        & _can_meet("l", "r", percent, whole=True)
    )
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are links: estimated from sketches, then counted on whole sets."""
    floor = overlap_floor(K, percent)

    @F.pandas_udf("boolean")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([may_be_linked(np.asarray(x).view(np.uint64), np.asarray(y).view(np.uint64), floor, percent) for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("boolean")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(_as_set(x), _as_set(y), percent) for x, y in zip(a, b, strict=True)])

    def with_both(pairs, column, test):
        first = sets.select(F.col("node").alias("a"), F.col(column).alias("x"))
        second = sets.select(F.col("node").alias("b"), F.col(column).alias("y"))
        return pairs.join(first, "a").join(second, "b").filter(test("x", "y")).select("a", "b")

    return with_both(with_both(pairs, "sketch", estimate), "set", exact)


def _joined(of_class: DataFrame, comps: DataFrame, more: DataFrame) -> DataFrame:
    """``of_class`` with the components that the further links ``more`` connect made one."""
    edges = more
    for side in ("a", "b"):
        known = comps.select(F.col("node").alias(side), F.col("component").alias("c"))
        edges = edges.join(known, side, "left").withColumn(side, F.coalesce("c", side)).drop("c")
    above = components(edges).select(F.col("node").alias("component_id"), F.col("component").alias("top"))
    return of_class.join(above, "component_id", "left").select("digest", F.coalesce("top", "component_id").alias("component_id"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row a row: doc_id, n_shingles, component_id (least linked id), kept."""
    with text_batches(docs.sparkSession):
        rows = cut(sketched(docs, id_col, text_col, size))
    classes = cut(
        rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "sketch", "low", "high")])
    )
    nodes, entries = _entries(classes, percent)
    sweep(docs.sparkSession)
    with text_batches(docs.sparkSession):
        sets = cut(_sets_of(_ids_and_texts(docs, id_col, text_col), nodes, size))
        rare = cut(_rare_entries(sets, _slot_counts(sets), percent))
    stars = _star_pairs(entries, percent).union(_star_pairs(rare, percent, whole=True)).distinct()
    comps = components(cut(_verified(cut(stars), sets, percent)))
    sweep(docs.sparkSession)
    more = cut(_verified(cut(_rest_pairs(rare, comps, percent)), sets, percent))
    of_class = classes.select("digest", "node").join(comps, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    if not more.isEmpty():
        of_class = _joined(of_class, comps, more)
    small = rows.select("doc_id", "n", "digest")
    found = salted_join(small.filter("n > 0"), of_class, "digest", "doc_id").select("doc_id", "n", "component_id")
    empty = small.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    null = lambda c: F.nullif(F.col(c), F.lit(LOWEST)).alias(c)
    return found.unionByName(empty).select(
        null("doc_id"), F.col("n").alias("n_shingles"), null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group the one with the least id.

    Rows that a bitmap of the dropped ids clears pass straight through; only the others shuffle.
    """
    page, bitmap, slot, hit, gone_id = fresh(docs, "page", "bits", "slot", "hit", "gone")
    gone = cut(near_components(docs, id_col, text_col, size, percent).filter("NOT kept").select(F.col("doc_id").alias(gone_id)))
    bits = filter_bits(gone.count(), FILTER_BITS)
    slots = gone.select(_slot(gone_id, bits).alias(slot)).distinct()
    pages = slots.groupBy(F.expr(f"{slot} div {PAGE}").alias(page)).agg(F.expr(f"bitmap_construct_agg({slot} % {PAGE})").alias(bitmap))
    rows = docs.withColumn(slot, _slot(f"`{id_col}`", bits)).join(F.broadcast(pages), F.floor(F.col(slot) / PAGE) == F.col(page), "left")
    rows = rows.withColumn(hit, _hit(bitmap, F.col(slot)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    asked = rows.filter(hit).select(*columns).join(gone, F.col(f"`{id_col}`") == F.col(gone_id), "left_anti")
    return rows.filter(~F.col(hit)).select(*columns).union(asked)


def query(spark, sf_dir):
    return near_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), size=3, percent=85)
