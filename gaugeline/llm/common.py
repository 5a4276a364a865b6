"""Shared plumbing: the folder all executors see, written cut points, input readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    ``spark.checkpoint.dir`` decides. Where it is unset, a folder of this machine is made, which is right
    for ``local`` masters only; on any other master the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gaugeline-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/gaugeline/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives a lost executor. ``codec``: zstd takes
    less disk, for large tables."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if fits(df, rows) else df


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str, least: int = 1000) -> DataFrame:
    """``rows`` joined with ``side`` (one row a key; ``weight``: how many of ``rows`` have it) without a hot task.

    Keys with over a quarter of a task's share of rows, and ``least`` or more, are at most four a task, so that their
    side is broadcast and their rows stay where they are; all other keys are joined as usual. ``weight`` goes.
    """
    total = side.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).head()["n"]
    hot = F.col(weight) > max(least, total // (4 * partitions(rows.sparkSession)))
    few = F.broadcast(side.filter(hot).drop(weight))
    rest = rows.join(F.broadcast(side.filter(hot).select(key)), key, "left_anti").join(side.filter(~hot).drop(weight), key)
    return rows.join(few, key).unionByName(rest)
