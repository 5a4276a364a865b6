"""Ranking of runs (query_id, doc_id, score): explicit ties, top-k, flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TIES = {"trec": lambda: F.col("doc_id").desc(), "docid_asc": lambda: F.col("doc_id").asc()}


def rank(run: DataFrame, k: int | None = None, ties: str = "trec") -> DataFrame:
    """Adds ``rank`` from 1 by falling score; equal scores by doc_id as a string, falling (trec) or rising.

    With ``k`` the filter is a limit inside each query, which Spark applies before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), TIES[ties]())
    ranked = run.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def truncate(run: DataFrame, k: int, ties: str = "trec") -> DataFrame:
    return rank(run, k, ties).drop("rank")


def scored_docs(run: DataFrame, k: int, ties: str = "trec") -> DataFrame:
    """Flattened: queries in id order, ranks from 1."""
    return rank(run, k, ties).select("query_id", "doc_id", "rank", "score").orderBy("query_id", "rank")
