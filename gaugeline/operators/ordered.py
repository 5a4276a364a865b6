"""Places and running sums over a whole order, without sorting all rows in one task.

Rows are put in range partitions and written, so that every later reading sees the same partitions; sizes and sums of
each partition make its offset, and a window inside each partition does the rest.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back. Where that is unset, as on one machine, below a new
    temporary folder; a cluster must set it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gaugeline-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/gaugeline/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column`` of ``sums``, the sum of the column over all rows up to and with this one in
    ``order`` as ``name``, and over all rows as ``name + "_all"``. The order should have no ties."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = written(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ordered")
    of_part = kept.groupBy("__p").agg(*(F.sum(c).alias(f"__s_{n}") for n, c in sums.items()))
    rows = of_part.orderBy("__p").collect()  # a row for each partition
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept
    for name, column in sums.items():
        total, before = 0, {}
        for r in rows:
            before[r["__p"]] = total
            total += r[f"__s_{name}"] or 0
        offsets = F.array(*(F.lit(before.get(p, 0)) for p in range(max(before, default=0) + 1)))
        out = out.withColumn(name, F.sum(column).over(inside) + offsets[F.col("__p")]).withColumn(f"{name}_all", F.lit(total))
    return out.drop("__p")
