"""Where iterations cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cut(frame: DataFrame) -> DataFrame:
    """The same rows, checkpointed to the folder of ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, local mode takes a new folder of this machine; a cluster is refused.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-shared-"))
    return frame.checkpoint()


#: Rounds after which the estimate of a size is replaced by the size.
SIZED = 8


def cut_round(frame: DataFrame, k: int) -> DataFrame:
    """:func:`cut` for round ``k`` (from 0) of those that join what the last round made.

    A checkpoint keeps its plan's estimate of the size, and a join's is the product of its
    sides', so that over rounds its digits would double and plans take ever longer. Every
    SIZED rounds rows are kept first, so that they have the size that they are found to have.
    """
    if (k + 1) % SIZED:
        return cut(frame)
    kept = frame.persist(StorageLevel.DISK_ONLY)
    try:
        kept.count()
        return cut(kept.select("*"))
    finally:
        kept.unpersist()
