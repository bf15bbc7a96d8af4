"""Session-level helpers: lineage cuts, shared scratch folders, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# Above this many rows a side is never broadcast by an explicit hint.
BROADCAST_ROWS = 200_000
# Rows of a shuffled table that one task sorts or groups.
TASK_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``. Only a local master may go without and gets its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="longomics-")
        sc.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written intermediate."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes non-deterministic columns and survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a written table in the shared folder: for loops, where a checkpoint would carry the size estimates of
    its joins on, which square with every round until planning alone takes longer than the work."""
    df.write.parquet(path := scratch_path(df.sparkSession, "table"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts whose number follows ``rows``, so that a task holds about ``TASK_ROWS`` of them.

    Where Spark's own number of shuffle partitions is enough, nothing is done. A join partner follows to the same parts.
    """
    parts = -(-rows // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only after counting at most ``limit`` + 1 of its rows.

    A larger side is returned without a hint, so Spark falls back to a shuffled join that AQE
    can split.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
