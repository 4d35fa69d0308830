"""Best-fit packing of token sequences by linear grouping and few-size configurations.

Only the histogram of piece lengths (as many numbers as the capacity) is planned on the
driver; documents meet the plan by their rank among the pieces of their length.

1. Pieces longer than a share of the capacity (each of ``LARGE`` is tried, the plan with the
   fewest sequences is used) are sorted and cut into ``GROUPS`` groups of equal
   cardinality; each length is rounded up to the longest of its group.
2. The few rounded sizes are packed by configurations: column generation solves the linear
   programme over all ways to fill a sequence, and each configuration is used the whole
   number of times below its optimum.
3. The actual lengths are put back into the configurations' places, which leaves room.
4. All other pieces, longest first, go by best fit into the sequence with the least room
   that still holds them, in bulk over sequences of equal room; new sequences open only
   where none has room.

Defined results
---------------
* Null text counts as empty text; an empty text is the closing id alone.
* A document longer than the capacity is cut into pieces of the capacity, the first piece
  being the shorter one.  Others are never cut.
* Repeated rows are packed each; an empty table gives an empty plan.
* The special string of the vocabulary gives its id wherever it stands in a text.

Scale: texts are read once and not shuffled.  Pieces (some 50 bytes each) are written to
the checkpoint folder; ranks come from two-level counting over (length, bucket), so that
no length, however common, meets in one task.  The plan is bounded by the capacity.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import cut, release, spread, table, text_batches

CAPACITY = 2048
LARGE = (0.25, 0.34, 0.42, 0.5)
GROUPS = 96
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k"
ROWS_PER_BUCKET = 20_000
ROUNDS = 3000
#: Texts that are Python objects at a time.
TEXTS_AT_ONCE = 256


# ---------------------------------------------------------------- planning on a histogram


def _groups(counts: dict[int, int], groups: int) -> list[dict[int, int]]:
    """Equal-cardinality groups of the sorted lengths, longest first; a length may be in two."""
    total = sum(counts.values())
    size = max(1, -(-total // groups))
    out: list[dict[int, int]] = [{}]
    room = size
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append({})
                room = size
            n = min(room, left)
            out[-1][length] = out[-1].get(length, 0) + n
            room -= n
            left -= n
    return [g for g in out if g]


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The filling of one sequence with the highest worth: a knapsack, one item more each level."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        tried = np.full((len(sizes), capacity + 1), -1.0)
        for i, s in enumerate(sizes):
            tried[i, s:] = best[: capacity + 1 - s] + worth[i]
        pick = tried.argmax(axis=0)
        value = tried[pick, np.arange(capacity + 1)]
        pick[value <= best + 1e-12] = -1
        if (pick < 0).all():
            break
        best = np.maximum(best, value)
        picks.append(pick)
    used, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            used[i] += 1
            room -= int(sizes[i])
    return used, float(best[capacity])


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(how many of each size, how often), at most the demand in all: the linear optimum, rounded down."""
    s, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag(capacity // s).astype(float)
    for _ in range(ROUNDS):
        worth = np.linalg.solve(basis.T, np.ones(len(s)))
        column, value = _best_configuration(s, worth, capacity)
        if value <= 1 + 1e-9:
            break
        change, now = np.linalg.solve(basis, column), np.linalg.solve(basis, d)
        ratio = np.where(change > 1e-9, np.maximum(now, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    often = np.linalg.solve(basis, d)
    left, out = list(demand), []
    for j in np.argsort(-often):
        column = [int(round(x)) for x in basis[:, j]]
        n = int(often[j] + 1e-6)
        n = min([n, *(left[i] // c for i, c in enumerate(column) if c)])
        if n > 0:
            left = [x - n * c for x, c in zip(left, column, strict=True)]
            out.append((column, n))
    return out


class Plan:
    """Rules (length, first rank, end rank, first sequence, pieces a sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE[0], groups: int = GROUPS):
        self.capacity, self.rules, self.sequences = capacity, [], 0
        self.rank: dict[int, int] = defaultdict(int)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        left = {k: n for k, n in counts.items() if n}
        if full := left.pop(capacity, 0):
            self._put(capacity, full, self._new(full), 1, 0)
        big = {k: n for k, n in left.items() if k > large * capacity}
        if big:
            for length, n in self._configured(big, groups).items():
                left[length] = n
        for length in sorted(left, reverse=True):
            self._best_fit(length, left[length])

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        lo = self.rank[length]
        self.rules.append((length, lo, lo + n, sequence, each, offset))
        self.rank[length] = lo + n

    def _opened(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.open[room]:
                insort(self.rooms, room)
            self.open[room].append((sequence, n))

    def _configured(self, big: dict[int, int], groups: int) -> dict[int, int]:
        """Packs most of the large pieces; returns how many of each length are left."""
        members = _groups(big, groups)
        sizes = [max(g) for g in members]
        queues = [[[k, g[k]] for k in sorted(g)] for g in members]  # longest at the end
        for column, often in configurations(sizes, [sum(g.values()) for g in members], self.capacity):
            places = [i for i, c in enumerate(column) for _ in range(c)]
            first, runs = self._new(often), []
            for i in places:  # the actual lengths of this place in each of the sequences, as runs
                need, run = often, []
                while need:
                    k, n = queues[i][-1]
                    n = min(n, need)
                    run.append((k, n))
                    need -= n
                    queues[i][-1][1] -= n
                    if not queues[i][-1][1]:
                        queues[i].pop()
                runs.append(run)
            at = [[0, 0] for _ in places]
            done = 0
            while done < often:
                step = min(run[j][1] - used for run, (j, used) in zip(runs, at, strict=True))
                offset = 0
                for p, run in enumerate(runs):
                    j, used = at[p]
                    self._put(run[j][0], step, first + done, 1, offset)
                    offset += run[j][0]
                    at[p] = [j, used + step] if used + step < run[j][1] else [j + 1, 0]
                self._opened(self.capacity - offset, first + done, step)
                done += step
        out: dict[int, int] = {k: 0 for k in big}
        for q in queues:
            for k, n in q:
                out[k] += n
        return out

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                many = -(-n // each)
                self._opened(self.capacity, self._new(many), many)
                continue
            room = self.rooms[i]
            sequence, many = self.open[room].pop()
            each = min(room // length, n)
            used = min(many, n // each)
            self._put(length, used * each, sequence, each, self.capacity - room)
            if many > used:
                self.open[room].append((sequence + used, many - used))
            if not self.open[room]:
                self.rooms.pop(i)
            self._opened(room - each * length, sequence, used)
            n -= used * each

    def lookup(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the rules' first ranks, and the rules in that order."""
        rules = np.array(sorted(self.rules), dtype=np.int64).reshape(-1, 6)
        return (rules[:, 0] << 44) + rules[:, 1], rules


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Of the plans by several bounds between large and small pieces, the one with the fewest sequences."""
    least = -(-sum(k * n for k, n in counts.items()) // capacity)
    best = None
    for large in LARGE:
        plan = Plan(counts, capacity, large)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences == least:
            break
    return best


def locate(length: np.ndarray, rank: np.ndarray, keys: np.ndarray, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of the given lengths and ranks."""
    r = rules[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
    nth = rank - r[:, 1]
    return r[:, 3] + nth // r[:, 4], r[:, 5] + nth % r[:, 4] * length


# ---------------------------------------------------------------- tokens and pieces


class Encoder:
    """Token ids of whole texts: the rank file's merges, special strings as their own ids."""

    def __init__(self, vocabulary: str):
        with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(vocabulary + ".json"), encoding="utf-8") as f:
            spec = f.read()
        # the list alone, not the whole vocabulary once more
        added, _ = json.JSONDecoder().raw_decode(spec, spec.index("[", spec.index('"added_tokens"')))
        self.special = {t["content"]: t["id"] for t in added}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        for content, number in self.special.items():
            if content in text:
                out: list[int] = []
                for i, part in enumerate(text.split(content)):
                    out += [number] * (i > 0) + self(part)
                return out
        return self.plain.encode_ordinary(text) if text else []


@lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # of what earlier stages left in this worker
        encode = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(lo, TEXTS_AT_ONCE)
                at, rows, kept = [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = np.array([*encode(text), CLOSING_ID], dtype="<u4")
                    raw, n = memoryview(ids.tobytes()), len(ids)
                    start, stop, piece = 0, n % capacity or capacity, 0
                    while start < n:
                        at.append(i)
                        rows.append((piece, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                        start, stop, piece = stop, stop + capacity, piece + 1
                    if with_ids:
                        kept.append(ids.astype(np.int32))
                piece, start, length, crc = np.array(rows, np.int64).T
                columns = [part.column("doc_id").take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(np.concatenate(kept))))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)
        release()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text).mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = VOCABULARY,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    with text_batches(docs.sparkSession):
        pieces = cut(token_pieces(docs, id_col, text_col, capacity, vocabulary, with_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}
    keys, rules = best_plan(counts, capacity).lookup()
    plan = docs.sparkSession.sparkContext.broadcast((keys, rules))
    buckets = max(8, -(-sum(counts.values()) // ROWS_PER_BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    earlier = Window.unboundedPreceding, -1
    level = Window.partitionBy("length").orderBy("bucket").rowsBetween(*earlier)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "bucket", F.coalesce(F.sum("n").over(level), F.lit(0)).alias("before"))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(local) - 1).join(offsets, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = locate(length.to_numpy(np.int64), rank.to_numpy(np.int64), *plan.value)
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("at", place("length", F.col("before") + F.col("nth")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return placed.select(*columns, "at.sequence_id", "at.offset")


def query(spark, sf_dir):
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
