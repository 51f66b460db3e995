"""Session helpers shared by the iterative operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay below this. The rows of
# the graph operators are at most two cell ids and two numbers (about 60 bytes).
BROADCAST_ROW_LIMIT = 500_000


# Bytes that a task reads of files or of a shuffle, for rows that are sorted whole. Compressed
# trips unfold to ten times their size and more, and what a task sorts must fit its memory.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside read ``TASK_BYTES`` at most in a task, where the session has no setting of its own."""
    ours = {name: size for name, size in TASK_BYTES.items() if name not in spark.conf.getAll}
    for name, size in ours.items():
        spark.conf.set(name, size)
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name)


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="urbanweave-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and go on from the written table.

    Unlike a checkpoint, the table carries no constraints of the plan it came
    from. In long loops those grow until planning takes longer than the work.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle_alone(df: DataFrame) -> DataFrame:
    """``settle``, with the shuffle files of that write removed as soon as it ends."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return settle(df)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def settle_with(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """``settle`` and the named aggregates, computed in that same pass."""
    seen = Observation()
    kept = settle(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    return kept, seen.get


def settle_counted(df: DataFrame) -> tuple[DataFrame, int]:
    kept, seen = settle_with(df, rows=F.count(F.lit(1)))
    return kept, seen["rows"]


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast when the counted rows allow it; else leave the join to AQE."""
    return F.broadcast(df) if rows <= BROADCAST_ROW_LIMIT else df
