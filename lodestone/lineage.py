"""Cutting the lineage of a DataFrame in the folder that the cluster shares, and spreading small inputs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are few enough for every executor to hold.
FEW_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session may do without: it gets a temporary folder.
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
    """``df`` as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A table as read, dealt over all cores where it has fewer parts than those: one row group is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def only(rows: DataFrame, flags: DataFrame, key: str) -> DataFrame:
    """The rows whose flag says so; ``flags`` has ``key`` and ``kept`` for each row.

    Where few are kept, or few are not, these are broadcast, so that the rows themselves stay in place.
    """
    held = cut(flags)
    for kept, how in ((False, "left_anti"), (True, "left_semi")):
        part = held.filter(F.col("kept") == kept).select(key)
        if part.count() <= FEW_ROWS:
            return rows.join(F.broadcast(part), key, how)
    return rows.join(held.filter("kept").select(key), key, "left_semi")
