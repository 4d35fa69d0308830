"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line's tokens are its distinct words (A-Z lower-cased).  Two lines match if the Jaccard
similarity of their token sets is at least ``percent``.  A line goes if it matches a line
that comes before it, by document id, then by place in the document.

1. Words are counted over all documents in a table of fixed size, which orders tokens by
   rarity.  Lines with equal sets form a class, which stands for its first line.
2. Each class puts its rarest tokens, as many as a match must meet (prefix filter), into
   inverted lists.  A word with more than ``SHORT`` occurrences makes no list by itself: two
   matching lines whose first common word is so frequent share a second word within one more
   place, so that the lists are those of pairs of words.
3. Within a list, sizes, places (positional filter) and a 128-bit map, of the parities of the
   tokens on each bit, bound the similarity of each two entries.  Entries that no other one may match leave; no pair is
   written down.
4. The whole token sets of the entries left come to their lists and decide.  Two lines count
   as linked only in the list of their first common word (or words), so each link counts once.
   Each line gets its number of links and its earliest match.

Defined results
---------------
* Lines end at ``\\n``.  Null text counts as empty, one line without tokens.
* Lines without tokens are never removed.
* Equal lines match; of equal sets the first line stays.  A line matching only a later line
  stays.  Whether the earlier line is itself removed makes no difference.
* A class is named by its first line.  A removed line is reported with its class's first line
  or, if it is that itself, with the earliest one that it matches.
* Links are counted between classes, toward earlier and later ones.  Lines alone in their
  class and without a link are not listed.
* Ids are taken as unique; a null id comes first.  Repeated rows count as one document and
  share their result.
* An empty table gives an empty result.  Tokens are told apart by 64-bit hashes.

Scale: texts are not shuffled but where cleaned texts are asked for.  Lines shuffle as some
100 bytes, their entries as 50; the copies of a line are one class.  Token sets move once for
each list in which a line may have a match, in ``ROUNDS`` rounds over parts of the lists, the
shuffle files of a round being freed before the next.  A list longer than ``SHORT`` is dealt as a grid of pairs of
its parts, so that no task holds more than two parts of it.  Broadcast are tables of fixed
size: word counts (8 MB) and a bitmap of the lines to verify (64 MB at most; false hits only
cost work).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.exact_dedup import filter_bits
from lodestone.llm.shared import SLOT_BLOCKS, column, cut, expanded, fresh, merged_slots, salted_join, slot_blocks, spread, stored, sweep, table, whole_lists

PERCENT = 80
SLOTS = 1 << 23
SHORT = 16_384
#: SHORT words or more, on the scale of ``word_counts``.
LONG = int(8 * np.log2(1 + SHORT))
#: Members of a list that are compared with as many others at once.
CELL = 512
#: Parts of the lists whose token sets move one after the other.
ROUNDS = 1
#: Pairs of entries that are looked at together.
PAIRS = 2_000_000
#: Lists of so many members are compared pair by pair, so many pairs at once.
FEW, PAIRS_AT_ONCE = 8, 20_000
BUFFER = 1 << 20
LOWEST = -(1 << 63)
#: Bits of a bitmap of ids, at most.
FILTER_BITS = 1 << 29
WRAP = 1 << 40
BASE = 0x9E3779B97F4A7C15
#: The first so many bytes of eight.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


# ---------------------------------------------------------------- tokens of many texts at once


def _mix(h: np.ndarray, by: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def _hashed(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and line of each word of a buffer of lower-cased lines that ends with a line's end."""
    a = np.frombuffer(buffer + bytes(8), np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    space[len(buffer) :] = True
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    eight = np.ndarray(len(buffer) + 1, "<u8", a, strides=(1,))  # the eight bytes from each place on
    h = _mix(size.astype(np.uint64) * np.uint64(BASE) ^ (eight[starts] & MASKS[np.minimum(size, 8)]))
    more = np.flatnonzero(size > 8)
    for at in range(8, int(size.max(initial=0)), 8):
        more = more[size[more] > at]
        h[more] = _mix(h[more] * np.uint64(BASE) ^ (eight[starts[more] + at] & MASKS[np.minimum(size[more] - at, 8)]))
    ended = np.bincount(np.searchsorted(starts, np.flatnonzero(a[: len(buffer)] == 10)), minlength=len(starts) + 1)
    return h, np.cumsum(ended)[: len(starts)]


def buffers(texts) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(index of the first text, lines of each text, their lines in one buffer) for groups of texts."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        group.append(raw)
        size += len(raw)
        if size >= BUFFER:
            yield first, np.array([r.count(b"\n") + 1 for r in group]), b"\n".join(group) + b"\n"
            first, group, size = i + 1, [], 0
    if group:
        yield first, np.array([r.count(b"\n") + 1 for r in group]), b"\n".join(group) + b"\n"


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def sorted_sets(hashes: np.ndarray, line: np.ndarray, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines with tokens, where each one's set begins, tokens): distinct, rarest first, or by hash without ``rarity``."""
    rare = np.uint8(0) if rarity is None else rarity[_slot(hashes)]
    if len(line) and line[-1] < 1 << 20:  # line, rarity and hash in one sort key; the hash's low 28 bits never decide in practice
        order = np.argsort(line.astype(np.uint64) << np.uint64(44) | np.multiply(rare, 1 << 36, dtype=np.uint64) | hashes >> np.uint64(28))
    else:
        order = np.lexsort((hashes, np.broadcast_to(rare, line.shape), line))
    h, n = hashes[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (n[1:] != n[:-1])
    h, n = h[new], n[new]
    starts = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1]))) if len(n) else np.empty(0, np.int64)
    return n[starts] if len(n) else np.empty(0, np.int64), starts, h


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often words fall on each slot, on a scale of eighths of a power of two; 8 is a single word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.uint16)
        for batch in batches:
            for _, _, buffer in buffers(batch["text"]):
                at, n = np.unique(_slot(_hashed(buffer)[0]), return_counts=True)
                total[at] = np.minimum(total[at] + n, 65535)
        yield from slot_blocks(total)

    counts = merged_slots(docs.select("text").mapInPandas(run, SLOT_BLOCKS), SLOTS)
    return np.minimum(255, 8 * np.log2(1.0 + counts)).astype(np.uint8)


def _bits(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's bit among 128, in two halves."""
    one, high = np.uint64(1) << (h >> np.uint64(58)), h & np.uint64(1 << 57) != 0
    return np.where(high, np.uint64(0), one), np.where(high, one, np.uint64(0))


LINES = "sa long, sb long, doc long, line int, n int, own int, low long, high long, cold array<int>, hot array<int>"


def line_rows(docs: DataFrame, rarity: np.ndarray, percent: int) -> DataFrame:
    """One row a line with tokens: digest of its set, document, place, size, map and the tokens of its prefix.

    ``own`` counts the rarest tokens that no other line has; they need no list.  After them come the
    ``cold`` ones, whose lists are surely short, then the ``hot`` ones, whose words are too many; these
    reach one place further, and are empty where the prefix itself has none.
    """
    held = docs.sparkSession.sparkContext.broadcast(rarity)
    long = LONG if percent > 50 else 256  # one common word may be enough for a match: no word counts as hot
    fields = [("sa", pa.int64()), ("sb", pa.int64()), ("doc", pa.int64()), ("line", pa.int32()), ("n", pa.int32()), ("own", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("cold", pa.list_(pa.int32())), ("hot", pa.list_(pa.int32()))]
    schema = pa.schema(fields)

    def lists(h: np.ndarray, entry: np.ndarray, starts: np.ndarray) -> pa.ListArray:
        ends = np.append(0, np.cumsum(np.add.reduceat(entry, starts, dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((h[entry] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = held.value
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for first, lines, buffer in buffers(batch.column("text").to_pylist()):
                line, starts, h = sorted_sets(*_hashed(buffer), rare)
                if not len(line):
                    continue
                n = np.diff(np.append(starts, len(h)))
                count = rare[_slot(h)]
                place = np.arange(len(h)) - np.repeat(starts, n)
                keep = np.repeat(n - (-(-percent * n // 100)) + 1, n)
                many = (count >= long) & (place < keep)
                inside = np.repeat(np.logical_or.reduceat(many, starts), n)
                doc = np.searchsorted(np.cumsum(lines), line, side="right")
                begin = np.cumsum(lines) - lines
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.add.reduceat(_mix(h, 0xC4CEB9FE1A85EC53), starts).view(np.int64)),
                        pa.array(np.bitwise_xor.reduceat(_mix(h, 0xD6E8FEB86659FD93), starts).view(np.int64)),
                        pa.array(ids[first + doc].astype(np.int64)),
                        pa.array((line - begin[doc]).astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(np.add.reduceat(count == 8, starts, dtype=np.int32)),
                        *[pa.array(np.bitwise_xor.reduceat(x, starts).view(np.int64)) for x in _bits(h)],
                        lists(h, (place < keep) & (count > 8) & (count < long), starts),
                        lists(h, (place < keep + 1) & (count >= long) & inside, starts),
                    ],
                    schema=schema,
                )

    return docs.select("doc", "text").mapInArrow(run, LINES)


# ---------------------------------------------------------------- candidates


def _meeting(key, n, at, low, high, side, percent: int) -> np.ndarray:
    """Of entries sorted by list and size: those that some other of the list may match.

    Of two entries the later one's set is the larger.  Toward it, a match needs a token among fewer of
    the smaller set's rarest than toward smaller ones.
    """
    found = np.zeros(len(key), bool)
    listed = np.cumsum(np.append(True, key[1:] != key[:-1])) * (int(n.max()) * 100 // percent + 2)
    end = np.searchsorted(listed + n, listed + 100 * n // percent, side="right")
    least = (2 * percent * n + 99 + percent) // (100 + percent)
    many = np.where(at <= n - least, end - np.arange(1, len(n) + 1), 0)
    room, upto = n - at, np.cumsum(many)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - many[lo] + PAIRS, side="right")))
        some = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        both = n[i] + n[j]
        ok = np.minimum(room[i], room[j]) * (100 + percent) >= percent * both
        i, j, both = i[ok], j[ok], both[ok]
        apart = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
        ok = apart * (100 + percent) <= (100 - percent) * both
        if side is not None:
            ok &= (side[i] < 0) | (side[i] != side[j])
        found[i[ok]] = found[j[ok]] = True
        lo = hi
    return found


MEMBERS = "key long, side int, doc long, line int, at int, upto int"


def _members(entries: DataFrame, percent: int) -> DataFrame:
    """The entries that may have a match in their list: key, side, doc, line, and the places of the list's words."""
    fields = [("key", pa.int64()), ("side", pa.int32()), ("doc", pa.int64()), ("line", pa.int32()), ("at", pa.int32()), ("upto", pa.int32())]
    dealt = "side" in entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            key, n, at = column(t, "key"), column(t, "n").astype(np.int64), column(t, "at").astype(np.int64)
            side = column(t, "side") if dealt else None
            by = np.argsort(np.cumsum(np.append(True, key[1:] != key[:-1])) * (int(n.max()) + 1) + n)
            low, high = (column(t, c).view(np.uint64)[by] for c in ("low", "high"))
            found = _meeting(key, n[by], at[by], low, high, side[by] if dealt else None, percent)
            found = np.sort(by[found])
            at = at[found].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[found]),
                    pa.array(side[found] if dealt else np.full(len(found), -1, np.int32)),
                    pa.array(column(t, "doc")[found]),
                    pa.array(column(t, "line")[found]),
                    pa.array(at),
                    pa.array(column(t, "upto")[found] if dealt else at),
                ],
                schema=pa.schema(fields),
            )

    return entries.repartition("key").sortWithinPartitions("key").mapInArrow(run, MEMBERS)


def _cold_entries(classes: DataFrame) -> DataFrame:
    some = classes.select("doc", "line", "n", "own", "low", "high", F.posexplode("cold").alias("i", "token"))
    return some.select(F.col("token").cast("long").alias("key"), "doc", "line", "n", (F.col("own") + F.col("i")).alias("at"), "low", "high")


def _hot_entries(classes: DataFrame, percent: int) -> DataFrame:
    """Entries by pairs of hot words, of which the first one is in the prefix; long lists as cells of a grid.

    A cell holds two parts of a list, told apart by ``side``, or one part, where ``side`` is -1.
    """
    before = F.col("own") + F.size("cold")
    some = classes.filter(F.size("hot") > 1).select("doc", "line", "n", "low", "high", before.alias("before"), "hot", F.posexplode("hot").alias("i", "first"))
    some = some.filter(F.col("before") + F.col("i") <= F.col("n") - F.expr(f"({percent} * n + 99) div 100"))
    some = some.select("*", F.posexplode(F.expr("slice(hot, i + 2, size(hot))")).alias("k", "second"))
    at = F.col("before") + F.col("i")
    rows = some.select(F.xxhash64("first", "second").alias("key"), "doc", "line", "n", at.alias("at"), "low", "high", (at + F.col("k") + 1).alias("upto"))
    rows = stored(rows)
    parts = F.ceil(F.col("many") / SHORT).cast("int")
    longer = rows.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > SHORT).select("key", parts.alias("parts"))
    rows = rows.join(longer, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc", "line"), F.col("parts").cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("parts") == 1, -1).when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cell = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(cell.alias("key"), "doc", "line", "n", "at", "low", "high", "upto", side.alias("side"))


# ---------------------------------------------------------------- verification


def _line_sets(docs: DataFrame, members: DataFrame, rarity: np.ndarray) -> DataFrame:
    """doc, line, tokens (hashes, rarest first) of the lines that a bitmap of the members' lines holds."""
    lines = cut(members.select("doc", "line").distinct())
    bits = filter_bits(lines.count(), FILTER_BITS)
    slots = lines.select(F.pmod(F.pmod(F.col("doc"), F.lit(WRAP)) * 31 + F.col("line"), F.lit(bits)).alias("slot"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch["slot"].to_numpy(np.int64)
            np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        page = 8192
        for p in np.flatnonzero(own.reshape(-1, page).any(axis=1)):
            yield pd.DataFrame({"page": [int(p)], "raw": [own[p * page : (p + 1) * page].tobytes()]})

    bitmap = np.zeros(bits // 8, np.uint8)
    for r in slots.mapInPandas(mark, "page int, raw binary").toLocalIterator():
        bitmap[r["page"] * 8192 : (r["page"] + 1) * 8192] |= np.frombuffer(r["raw"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast((bitmap, rarity))
    fields = [("doc", pa.int64()), ("line", pa.int32()), ("tokens", pa.list_(pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, rare = held.value
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
            for first, lines, buffer in buffers(batch.column("text").to_pylist()):
                doc = np.repeat(np.arange(len(lines)), lines)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(lines) - lines, lines)
                at = (ids[first + doc] % WRAP * 31 + number) % bits
                wanted = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                if not wanted.any():
                    continue
                hashes, line = _hashed(buffer)
                chosen = wanted[line]
                line, starts, h = sorted_sets(hashes[chosen], line[chosen], rare)
                sets = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + doc[line]]), pa.array(number[line].astype(np.int32)), sets], schema=pa.schema(fields))

    return docs.select("doc", "text").mapInArrow(run, "doc long, line int, tokens array<long>")


class _Sets:
    """Token sets of a list's members, as places in the table of tokens that two of them have."""

    def __init__(self, tokens: np.ndarray, owner: np.ndarray):
        _, code, count = np.unique(tokens, return_inverse=True, return_counts=True)
        column = np.cumsum(count > 1) - 1
        keep = count[code] > 1
        self.code, self.owner, self.width = column[code[keep]], owner[keep], int((count > 1).sum())

    def rows(self, lo: int, hi: int, left: int, right: int) -> np.ndarray:
        """Of members lo to hi, which tokens from left to right they have."""
        a, b = np.searchsorted(self.owner, (lo, hi))
        code, owner = self.code[a:b], self.owner[a:b]
        here = (code >= left) & (code < right)
        out = np.zeros((hi - lo, right - left), np.float32)
        out[owner[here] - lo, code[here] - left] = 1
        return out

    def shared(self, i: tuple[int, int], j: tuple[int, int]) -> np.ndarray:
        """How many tokens each member of the range i has in common with each of the range j."""
        both = np.zeros((i[1] - i[0], j[1] - j[0]), np.float32)
        for left in range(0, self.width, 4096):
            right = min(self.width, left + 4096)
            both += self.rows(*i, left, right) @ self.rows(*j, left, right).T
        return both


def _linked(values, starts, n, at, upto, side, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member of a list, how many it is linked with and meets in this list first, and the first of them.

    Member i has the tokens values[starts[i]:][:n[i]].  Long lists are taken in tiles of CELL members.
    """
    members = len(n)
    tokens, owner = expanded(values, starts, n)
    begin = np.cumsum(n) - n
    early = np.arange(len(owner)) - begin[owner] < upto[owner]
    whole, before = _Sets(tokens, owner), _Sets(tokens[early], owner[early])
    words = [values[starts + where] for where in (at, upto)]
    links, first = np.zeros(members, np.int64), np.full(members, members)
    for lo in range(0, members, CELL):
        i = lo, min(members, lo + CELL)
        for to in range(0, members, CELL):
            j = to, min(members, to + CELL)
            both = whole.shared(i, j)
            ok = 100 * both >= percent * (n[slice(*i), None] + n[None, slice(*j)] - both)
            if lo == to:
                np.fill_diagonal(ok, False)
            if not ok.any():
                continue
            ok &= before.shared(i, j) == (upto != at)[slice(*i), None]
            for word in words:
                ok &= word[slice(*i), None] == word[None, slice(*j)]
            if side[0] >= 0:
                ok &= side[slice(*i), None] != side[None, slice(*j)]
            links[lo : i[1]] += ok.sum(axis=1)
            first[lo : i[1]] = np.minimum(first[lo : i[1]], np.where(ok.any(axis=1), to + ok.argmax(axis=1), members))
    return links, first


def _pair_shared(values, a, na, b, nb) -> np.ndarray:
    """How many tokens the sets values[a[k]:][:na[k]] and values[b[k]:][:nb[k]] have in common, for each k."""
    tokens, pair = (np.concatenate(x) for x in zip(expanded(values, a, na), expanded(values, b, nb), strict=True))
    short = pair.astype(np.uint64) << np.uint64(40) | tokens >> np.uint64(24)
    order = np.argsort(short)
    tokens, pair, short = tokens[order], pair[order], short[order]
    same, near = tokens[1:] == tokens[:-1], short[1:] == short[:-1]
    if (near & ~same).any():  # two tokens that differ in their last bits only: sort by all of them
        order = np.lexsort((tokens, pair))
        tokens, pair = tokens[order], pair[order]
        same, near = tokens[1:] == tokens[:-1], pair[1:] == pair[:-1]
    return np.bincount(pair[1:][same & near], minlength=len(a))


def _linked_pairs(values, starts, n, at, upto, side, ends, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_linked``, for the members of many short lists; ``ends`` says where the list of each member ends."""
    members = len(n)
    links, first = np.zeros(members, np.int64), np.full(members, members)
    words = [values[starts + where] for where in (at, upto)]
    many = ends - np.arange(1, members + 1)
    i = np.repeat(np.arange(members), many)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
    ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((side[i] < 0) | (side[i] != side[j]))
    for word in words:
        ok &= word[i] == word[j]
    i, j = i[ok], j[ok]
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        x, y = i[lo : lo + PAIRS_AT_ONCE], j[lo : lo + PAIRS_AT_ONCE]
        ok = _pair_shared(values, starts[x], upto[x], starts[y], upto[y]) == (upto != at)[x]
        x, y = x[ok], y[ok]
        both = _pair_shared(values, starts[x], n[x], starts[y], n[y])
        ok = 100 * both >= percent * (n[x] + n[y] - both)
        x, y = x[ok], y[ok]
        links += np.bincount(x, minlength=members) + np.bincount(y, minlength=members)
        np.minimum.at(first, x, y)
        np.minimum.at(first, y, x)
    return links, first


COUNTS = "doc long, line int, n_links long, to_doc long, to_line int"


def _counted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc, line, links counted in a list, and the earliest line before it that it is linked with there."""
    fields = [("doc", pa.int64()), ("line", pa.int32()), ("n_links", pa.int64()), ("to_doc", pa.int64()), ("to_line", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            key, doc, line, at, upto, side = (column(t, c) for c in ("key", "doc", "line", "at", "upto", "side"))
            lists = t.column("tokens").combine_chunks()
            values, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            rows = np.lexsort((upto, at, line, doc, key))
            new = np.ones(len(key), bool)  # repeated rows have theirs again
            new[1:] = np.logical_or.reduce([c[rows][1:] != c[rows][:-1] for c in (key, doc, line, at, upto)])
            rows = rows[new]
            edges = np.flatnonzero(np.append(True, key[rows][1:] != key[rows][:-1]))
            size = np.diff(np.append(edges, len(rows)))
            out = []

            def found(m, links, first):
                some = np.flatnonzero(links)
                out.append((m[some], links[some], m[first[some]], first[some] < some))

            starts = offsets[:-1].astype(np.int64)
            n = np.diff(offsets).astype(np.int64)
            for lo, hi in zip(edges[size > FEW], (edges + size)[size > FEW], strict=True):
                m = rows[lo:hi]
                found(m, *_linked(values, starts[m], n[m], at[m], upto[m], side[m], percent))
            few = np.repeat((size > 1) & (size <= FEW), size)
            ends = np.cumsum(few)[np.repeat(edges + size, size) - 1]
            m = rows[few]
            found(m, *_linked_pairs(values, starts[m], n[m], at[m], upto[m], side[m], ends[few], percent))
            m, links, to, earlier = (np.concatenate(c) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[m]), pa.array(line[m]), pa.array(links.astype(np.int64)), pa.array(doc[to], mask=~earlier), pa.array(line[to], mask=~earlier)],
                schema=pa.schema(fields),
            )

    met = members.join(sets, ["doc", "line"]).select("key", "side", "doc", "line", "at", "upto", "tokens")
    return met.repartition("key").sortWithinPartitions("key").mapInArrow(run, COUNTS)


def line_classes(docs: DataFrame, rarity: np.ndarray, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc, text): the lines with tokens (sa, sb, n, doc, line), and the classes of those with equal sets.

    A class has sa, sb, n, its first line (doc, line), its prefix, and ``more``: it has other lines.
    """
    rows = stored(line_rows(docs, rarity, percent))
    place = F.struct("doc", "line")
    found = rows.groupBy("sa", "sb", "n").agg(
        F.min(place).alias("f"), (F.min(place) != F.max(place)).alias("more"), F.first(F.struct("own", "low", "high", "cold", "hot")).alias("t")
    )
    classes = stored(found.select("sa", "sb", "n", "more", "f.doc", "f.line", "t.own", "t.low", "t.high", "t.cold", "t.hot"))
    return rows.select("sa", "sb", "n", "doc", "line"), classes


def class_links(docs: DataFrame, classes: DataFrame, rarity: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """doc, line, n_links and ``to`` (its earliest match before it: doc, line) of each class with a link."""
    members = stored(_members(_cold_entries(classes), percent).union(_members(_hot_entries(classes, percent), percent)))
    sweep(docs.sparkSession)
    sets = stored(_line_sets(docs, members, rarity))
    counts = []
    for part in range(ROUNDS):
        here = members.filter(F.pmod(F.xxhash64("key"), F.lit(ROUNDS)) == part)
        counts.append(stored(_counted(here, sets, percent)))
        sweep(docs.sparkSession)
    found = counts[0]
    for more in counts[1:]:
        found = found.union(more)
    to = F.when(F.col("to_line").isNotNull(), F.struct(F.col("to_doc").alias("doc"), F.col("to_line").alias("line")))
    return found.groupBy("doc", "line").agg(F.sum("n_links").alias("n_links"), F.min(to).alias("to"))


def line_matches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of rows (doc, text): doc, line of each line with equals or links, its class, its class's links, its match.

    The class is its first line (class_doc, class_line), ``n_links`` the number of other classes that it
    matches.  The match (to_doc, to_line) is an earlier line; it is null where the line stays.
    """
    rarity = word_counts(docs)
    rows, classes = line_classes(docs, rarity, percent)
    sweep(docs.sparkSession)
    ends = class_links(docs, classes, rarity, percent)
    key = F.struct("sa", "sb", "n").alias("key")
    heads = classes.filter("more").select(key, "doc", "line").join(ends, ["doc", "line"], "full")
    heads = heads.select("key", F.struct("doc", "line").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "to")
    alone = heads.filter("key IS NULL").select("class.doc", "class.line", "class", "n_links", "to")
    equal = salted_join(rows.select("doc", "line", key), heads.filter("key IS NOT NULL"), "key", "doc").drop("key")
    equal = equal.withColumn("to", F.when(F.struct("doc", "line") == F.col("class"), F.col("to")).otherwise(F.col("class")))
    found = alone.unionByName(equal)
    return found.select(
        "doc", "line", F.col("class.doc").alias("class_doc"), F.col("class.line").alias("class_line"), "n_links", F.col("to.doc").alias("to_doc"), F.col("to.line").alias("to_line")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST)).alias("doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_lines, n_removed, and, lines from 0,

    removed: array of (line, match_doc, match_line),
    linked: array of (line, class_doc, class_line, n_links) of each line with equals or links, removed or not.
    """
    keyed = _keyed(docs, id_col, text_col)
    null = lambda c: F.nullif(F.col(c), F.lit(LOWEST))
    one = F.struct(
        "line",
        null("class_doc").alias("class_doc"),
        "class_line",
        "n_links",
        null("to_doc").alias("match_doc"),
        F.col("to_line").alias("match_line"),
    )
    lines = line_matches(keyed, percent).groupBy("doc").agg(F.array_sort(F.collect_set(one)).alias("lines"))
    n = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    found = keyed.select("doc", n.alias("n_lines")).join(lines, "doc", "left")
    picked = lambda x, *names: F.struct(*[x[c].alias(c) for c in names])
    gone = F.transform(F.filter("lines", lambda x: x["match_line"].isNotNull()), lambda x: picked(x, "line", "match_doc", "match_line"))
    linked = F.transform("lines", lambda x: picked(x, "line", "class_doc", "class_line", "n_links"))
    removed = F.coalesce(gone, F.array().cast("array<struct<line:int,match_doc:bigint,match_line:int>>"))
    linked = F.coalesce(linked, F.array().cast("array<struct<line:int,class_doc:bigint,class_line:int,n_links:bigint>>"))
    return found.select(null("doc").alias("doc_id"), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), linked.alias("linked"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the removed lines cut out of the text, all columns kept; texts without any pass unchanged."""
    key, gone = fresh(docs, "key", "gone")
    marks = dedup_lines(docs, id_col, text_col, percent).filter("n_removed > 0")
    marks = marks.select(F.coalesce("doc_id", F.lit(LOWEST)).alias(key), F.transform("removed", lambda r: r["line"]).alias(gone)).dropDuplicates([key])
    rows = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LOWEST))).join(marks, key, "left")
    text = F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(gone, i))
    return rows.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    return dedup_lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
