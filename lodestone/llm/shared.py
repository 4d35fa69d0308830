"""Small helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word: a run of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that go to a Python worker together, and how many of them at most where they hold whole texts.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores where it has fewer parts than those: one row group of a file is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The session's ``spark.checkpoint.dir`` names it; only a local session may do without, and
    gets a temporary one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint: row by row, removed when it is no longer in use."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, smaller than a checkpoint; it stays with the folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def sweep(spark: SparkSession) -> None:
    """Frees the shuffle files of finished steps, which stay until the driver's garbage collection finds them unused."""
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Has the executors collect their garbage: a heap that an earlier step made large stays so otherwise, besides what the next one's Python workers take."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends texts to Python in batches of ``TEXT_ROWS`` rows at most; a batch of the usual 10,000 is held by both sides."""
    before = spark.conf.get(BATCH_ROWS)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def release() -> None:
    """Gives back what Arrow and the C library hold unused; a Python worker outlives its task and counts on the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built on ``names`` that do not clash with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def rows_of(df: DataFrame, schema_order: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in schema_order])


def salted_join(big: DataFrame, small: DataFrame, key: str, salt_from: str, salts: int = 16) -> DataFrame:
    """Inner join where many rows of ``big`` may have one key, ``small`` having one row a key.

    The rows of a key are dealt over ``salts`` groups, to each of which the key's row is copied.
    """
    (salt,) = fresh(big, "salt")
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(salt_from), F.lit(salts)).cast("int"))
    copied = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [key, salt]).drop(salt)


SLOT_BLOCKS = "block int, counts binary"
BLOCKS = 64


def slot_blocks(total: np.ndarray) -> Iterator[pd.DataFrame]:
    """A task's counts by slot, as BLOCKS compressed rows."""
    raw = [np.minimum(x.astype(np.int64), 2**32 - 1).astype("<u4").tobytes() for x in total.reshape(BLOCKS, -1)]
    yield pd.DataFrame({"block": np.arange(BLOCKS, dtype="int32"), "counts": [zlib.compress(x, 1) for x in raw]})


def merged_slots(parts: DataFrame, slots: int) -> np.ndarray:
    """The sum of all tasks' counts, a table of fixed size; it meets on the cluster, block by block."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch["block"], batch["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
                sums[block] = part if block not in sums else sums[block] + part
        yield pd.DataFrame({"block": np.array(list(sums), "int32"), "counts": [np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in sums.values()]})

    out = np.zeros((BLOCKS, slots // BLOCKS), np.uint32)
    for r in parts.repartition("block").mapInPandas(merge, SLOT_BLOCKS).toLocalIterator():
        out[r["block"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


#: Rows of inverted lists that a task looks at together.
TOGETHER = 100_000


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole lists, from rows that are sorted by ``key``."""
    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            key = batch.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last or waiting[0].column("key")[0].as_py() != key[-1]:
                yield pa.Table.from_batches([*waiting[:-1], batch.slice(0, last)])
                waiting, rows = [batch.slice(last)], batch.num_rows - last
    if waiting:
        yield pa.Table.from_batches(waiting)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def expanded(values: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the sets values[starts[k]:][:n[k]], and which set each is of."""
    owner = np.repeat(np.arange(len(n)), n)
    return values[np.arange(len(owner)) + np.repeat(starts - np.cumsum(n) + n, n)], owner
