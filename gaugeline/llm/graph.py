"""Connected components by alternating large-star and small-star steps, as joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: long); component is the least node reachable.

    Each round hangs every node's larger neighbours under its least neighbour, then every node under its
    least smaller neighbour; it ends when the edges stay the same. A node's neighbours are never gathered:
    the least is a partial aggregate and reaches them by a join. Loops and repeated edges do no harm.
    """
    links = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    before = None
    for _ in range(most_rounds):
        now = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).head()
        if (now["n"], now["h"]) == before or not now["n"]:
            break
        before = now["n"], now["h"]
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        links = materialize(small.filter("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return nodes.join(links.select(F.col("u").alias("__u"), F.col("v").alias("__v")), F.col("node") == F.col("__u"), "left").select("node", F.coalesce("__v", "node").alias("component"))
