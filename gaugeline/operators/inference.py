"""Intervals and comparisons over per-query values (measure, query_id, value)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from .ordered import running


def estimates(values: DataFrame, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """(measure, mean, lo, hi, n): percentile bootstrap of the mean; each measure starts from the same seed.

    A measure's values are one group: as many as there are queries, a property of the query set.
    """

    def one(frame):  # noqa: ANN001, ANN202
        import pandas as pd

        x = frame.sort_values("query_id")["value"].to_numpy(np.float64)
        return pd.DataFrame([(frame["measure"].iloc[0], *v.bootstrap_mean(x, times, confidence, seed), len(x))], columns=["measure", "mean", "lo", "hi", "n"])

    return values.select("measure", "query_id", "value").groupBy("measure").applyInPandas(one, "measure string, mean double, lo double, hi double, n long")


def _compared(frame, found: tuple, n: int):  # noqa: ANN001, ANN202
    import pandas as pd

    mean, lo, hi, p = found
    return pd.DataFrame([(frame["measure"].iloc[0], mean, lo, hi, p, n, lo > 0 or hi < 0)], columns=["measure", "mean_diff", "lo", "hi", "p_value", "n", "significant"])


_COMPARISON = "measure string, mean_diff double, lo double, hi double, p_value double, n long, significant boolean"


def paired(a: DataFrame, b: DataFrame, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """a - b over the queries that both have."""

    def one(frame):  # noqa: ANN001, ANN202
        d = frame.sort_values("query_id")["d"].to_numpy(np.float64)
        return _compared(frame, v.bootstrap_paired(d, times, confidence, seed), len(d))

    both = a.select("measure", "query_id", F.col("value").alias("x")).join(b.select("measure", "query_id", F.col("value").alias("y")), ["measure", "query_id"])
    return both.select("measure", "query_id", (F.col("x") - F.col("y")).alias("d")).groupBy("measure").applyInPandas(one, _COMPARISON)


def unpaired(a: DataFrame, b: DataFrame, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """mean(a) - mean(b) of independent groups; a measure that only one has is an error."""

    def one(left, right):  # noqa: ANN001, ANN202
        x, y = (f.sort_values("query_id")["value"].to_numpy(np.float64) for f in (left, right))
        return _compared(left if len(left) else right, v.bootstrap_unpaired(x, y, times, confidence, seed), len(x) + len(y))

    # columns by new names, so that two parts of one frame can meet
    pick = lambda d: d.select(F.col("measure").alias("measure"), F.col("query_id").alias("query_id"), F.col("value").alias("value")).groupBy("measure")
    return pick(a).cogroup(pick(b)).applyInPandas(one, _COMPARISON)


def average_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the average rank of ``column``, from counts of its distinct values."""
    by = df.groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__c"))
    ranks = running(by, [F.col("__v")], {"__upto": "__c"}).select("__v", (F.col("__upto") - (F.col("__c") - 1) / 2).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("__v"))).drop("__v")


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``rho``; 0 with fewer than three rows or a constant side."""
    ranked = average_rank(average_rank(pairs, x, "__x"), y, "__y")
    s = ranked.agg(F.count("*").alias("n"), F.stddev_pop("__x").alias("sx"), F.stddev_pop("__y").alias("sy"), F.covar_pop("__x", "__y").alias("c"))
    return s.select(F.when((F.col("n") < 3) | (F.col("sx") == 0) | (F.col("sy") == 0), 0.0).otherwise(F.try_divide("c", F.col("sx") * F.col("sy"))).alias("rho"))


def spearman_interval(pairs: DataFrame, x: str, y: str, times: int = 2000, seed: int = 0) -> DataFrame:
    def one(frame):  # noqa: ANN001, ANN202
        import pandas as pd

        f = frame.sort_values("query_id")
        return pd.DataFrame([(*v.spearman_interval(f["x"].to_numpy(np.float64), f["y"].to_numpy(np.float64), times, seed), len(f))], columns=["rho", "lo", "hi", "n"])

    return pairs.select("query_id", F.col(x).alias("x"), F.col(y).alias("y")).withColumn("__one", F.lit(1)).groupBy("__one").applyInPandas(one, "rho double, lo double, hi double, n long")


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``tau`` of two orderings (item, place), small tables: over pairs of shared items; 1 without any."""
    both = a.select("item", F.col("place").alias("p")).join(b.select("item", F.col("place").alias("q")), "item")
    one, two = both.select("p", "q"), both.select(F.col("p").alias("p2"), F.col("q").alias("q2"))
    sign = F.signum((F.col("p") - F.col("p2")) * (F.col("q") - F.col("q2")))
    s = one.join(two, F.col("p") < F.col("p2")).agg(F.sum(sign).alias("s"), F.count(F.when(sign != 0, 1)).alias("n"))
    return s.select(F.when(F.col("n") > 0, F.try_divide("s", "n")).otherwise(1.0).alias("tau"))


def verdict(points, significant):  # noqa: ANN001, ANN201
    """NULL, CONFIRMED, OPPOSITE DIRECTION or weak/ambiguous, by the thresholds fixed beforehand."""
    return F.when(~significant | (F.abs(points) < 2), "NULL").when(points >= 5, "CONFIRMED").when(points <= -2, "OPPOSITE DIRECTION").otherwise("weak/ambiguous")


def separated(a_lo, a_hi, b_lo, b_hi):  # noqa: ANN001, ANN201
    """Intervals that don't touch."""
    return (a_lo > b_hi) | (b_lo > a_hi)
