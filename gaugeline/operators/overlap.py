"""Lexical overlap of queries with their gold documents, and its strata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment
from ..functions.vectors import char_jaccard, lcs_ratio
from .ordered import running


def pairs(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, threshold: int = 1) -> DataFrame:
    """(query_id, doc_id, query, passage) of gold pairs; missing documents and queries are left out. Only texts of gold
    documents are moved."""
    gold = qrels.filter(F.col("grade") >= threshold).select("query_id", "doc_id")
    corpus = corpus.join(gold.select("doc_id"), "doc_id", "left_semi")
    return gold.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(corpus.select("doc_id", F.col("full_text").alias("passage")), "doc_id")


def score(pairs: DataFrame, with_lcs: bool = False) -> DataFrame:
    """Adds jaccard (distinct 5-character strings) and containment (tokens); with_lcs also lcs_ratio."""
    out = pairs.withColumn("jaccard", _over_pairs(char_jaccard)("query", "passage")).withColumn("containment", containment(F.col("query"), F.col("passage")))
    return out.withColumn("lcs_ratio", _over_pairs(lcs_ratio)("query", "passage")) if with_lcs else out


def _over_pairs(f):  # noqa: ANN001, ANN202
    """A vectorised UDF of two texts. Gold pairs are few and long: as lambdas over a text's characters, the
    same work splits the text again for every n-gram (45 s against under 1 s on 26 pairs)."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([f(a or "", b or "") for a, b in zip(q, p, strict=True)], dtype="float64")

    return run


def per_query(scored: DataFrame) -> DataFrame:
    """The gold document of greatest jaccard for each query; ties to the least doc_id."""
    w = Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), "doc_id")
    return scored.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def summary(scores: DataFrame, column: str = "jaccard") -> DataFrame:
    p = F.percentile(column, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return scores.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), p.alias("p"), F.max(column).alias("max")).select("n", "mean", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "max")


def _numbered(scores: DataFrame, column: str) -> DataFrame:
    """Adds ``place``, from 0 in order of (column, query_id), and ``__all``, the count of rows."""
    found = running(scores.withColumn("__one", F.lit(1).cast("long")), [F.col(column), F.col("query_id")], {"__n": "__one"})
    return found.withColumn("place", F.col("__n") - 1).withColumnRenamed("__n_all", "__all").drop("__n", "__one")


def deciles(scores: DataFrame, column: str = "jaccard", bins: int = 10) -> DataFrame:
    """Adds ``decile`` from 0: place * bins / n, rounded down; ties in order of query_id."""
    return _numbered(scores, column).withColumn("decile", F.least(F.floor(F.col("place") * bins / F.col("__all")), F.lit(bins - 1)).cast("int")).drop("place", "__all")


def boundaries(scores: DataFrame, column: str = "jaccard", bins: int = 10) -> DataFrame:
    """(edge, value): the bins + 1 linear quantiles."""
    cuts = F.percentile(column, F.array(*(F.lit(i / bins) for i in range(bins + 1))))
    return scores.agg(cuts.alias("c")).select(F.posexplode("c").alias("edge", "value"))


def stratified(deciled: DataFrame, metrics: DataFrame, column: str = "jaccard") -> DataFrame:
    """(decile, measure, n, mean_overlap, mean): empty bins have no row."""
    both = deciled.join(metrics, "query_id")
    return both.groupBy("decile", "measure").agg(F.count("*").alias("n"), F.avg(column).alias("mean_overlap"), F.avg("value").alias("mean"))
