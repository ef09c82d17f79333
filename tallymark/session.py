"""Session helpers: durable intermediate results, scratch paths, checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size is below both bounds.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    In local mode, without either, it is a fresh temporary folder; on a cluster a machine-local
    folder would be lost with its machine, so the setting is required there.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tallymark-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so nothing is overwritten."""
    return f"{shared_root(spark).rstrip('/')}/tallymark-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, free_shuffles: bool = False) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor cannot change the rows.

    With ``free_shuffles``, Spark deletes the shuffle files behind the rows once they are written, which nothing reads again.
    """
    spark = df.sparkSession
    root = shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    if not free_shuffles:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting when it is made
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Add a broadcast hint when the measured size allows it, else leave the join to Spark.

    The measurement is one aggregate over the given side, so call it on small sides only.
    """
    width = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns]
    row_bytes = sum(width[1:], width[0]).cast("long")
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes), F.lit(0))).first()
    if rows <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES:
        return F.broadcast(df)
    return df
