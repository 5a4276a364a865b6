"""Recall, reciprocal rank and nDCG per query, in one grouping whatever the number of cutoffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries that have a judgment."""
    return queries.join(qrels.select("query_id"), "query_id", "left_semi")


def _ideal(qrels: DataFrame, deepest: int) -> DataFrame:
    gain = F.greatest(F.col("grade"), F.lit(0))
    w = Window.partitionBy("query_id").orderBy(gain.desc(), "doc_id")
    return qrels.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= deepest).select("query_id", "place", gain.alias("gain"))


def evaluate(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10), ties: str = "trec", threshold: int = 1, complete: bool = False) -> DataFrame:
    """(query_id, k, recall, mrr, ndcg). Gain is linear, negative grades gain nothing, the ideal is cut at k
    and takes every judged document. Queries are those that run and judgments share; with ``complete`` all
    judged ones, those without results scoring 0."""
    if not ks or min(ks) < 1:
        raise ValueError("cutoffs start at 1")
    deepest = max(ks)
    top = rank(run, deepest, ties).select("query_id", "doc_id", "rank")
    graded = top.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "inner")
    gain = F.greatest(F.col("grade"), F.lit(0)) / F.log2(F.col("rank") + 1.0)
    hit = F.col("grade") >= threshold
    got = graded.groupBy("query_id").agg(*(a for k in ks for a in (F.count(F.when(hit & (F.col("rank") <= k), 1)).alias(f"hits{k}"), F.min(F.when(hit & (F.col("rank") <= k), F.col("rank"))).alias(f"first{k}"), F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg{k}"))))
    best = _ideal(qrels, deepest).groupBy("query_id").agg(*(F.sum(F.when(F.col("place") <= k, F.col("gain") / F.log2(F.col("place") + 1.0))).alias(f"idcg{k}") for k in ks))
    wanted = qrels.groupBy("query_id").agg(F.count(F.when(F.col("grade") >= threshold, 1)).alias("relevant")).join(best, "query_id")
    if not complete:
        wanted = wanted.join(run.select("query_id"), "query_id", "left_semi")
    rows = wanted.join(got, "query_id", "left")
    zero = F.lit(0.0)
    per_k = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col("relevant") > 0, F.coalesce(F.col(f"hits{k}"), F.lit(0)) / F.col("relevant")).otherwise(zero).alias("recall"), F.coalesce(1.0 / F.col(f"first{k}"), zero).alias("mrr"), F.when(F.col(f"idcg{k}") > 0, F.coalesce(F.col(f"dcg{k}"), zero) / F.col(f"idcg{k}")).otherwise(zero).alias("ndcg")) for k in ks)))
    return rows.select("query_id", per_k.alias("m")).select("query_id", "m.*")


def long_form(scores: DataFrame) -> DataFrame:
    """(measure, query_id, value), measures named like ``recall@10``."""
    parts = F.explode(F.array(*(F.struct(F.concat(F.lit(f"{m}@"), F.col("k").cast("string")).alias("measure"), F.col(m).alias("value")) for m in ("recall", "mrr", "ndcg"))))
    return scores.select("query_id", parts.alias("p")).select("p.measure", "query_id", "p.value")


def mean_scores(scores: DataFrame) -> DataFrame:
    """Macro means (k, recall, mrr, ndcg)."""
    return scores.groupBy("k").agg(*(F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg")))


def corpus_stats(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: counts, judgments and relevant documents a query, mean characters of a document."""
    per = qrels.groupBy("query_id").agg(F.count("*").alias("j"), F.count(F.when(F.col("grade") > 0, 1)).alias("r"))
    judgments = per.agg(F.sum("j").alias("n_judgments"), F.avg("j").alias("judgments_per_query"), F.avg("r").alias("relevant_per_query"))
    docs = corpus.agg(F.count("*").alias("n_docs"), F.avg(F.length(F.coalesce("text", F.lit("")))).alias("mean_chars"))
    asked = judged(queries, qrels).agg(F.count("*").alias("n_queries"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    return one(docs).join(one(asked), "__one").join(one(judgments), "__one").drop("__one")


def first_relevant(run: DataFrame, qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """(query_id, found): rank of the first relevant document over the whole run; 0 if there is none."""
    ranked = rank(run).join(qrels.filter(F.col("grade") >= threshold).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    found = ranked.groupBy("query_id").agg(F.min("rank").alias("found"))
    return qrels.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("found", F.lit(0)).alias("found"))


def difficulty_bands(found: DataFrame) -> DataFrame:
    """(band, n): rank 1, 2-10, 11-100, never found; a rank beyond 100 is in no band."""
    band = F.when(F.col("found") == 1, "1").when(F.col("found").between(2, 10), "2-10").when(F.col("found").between(11, 100), "11-100").when(F.col("found") == 0, "none")
    return found.select(band.alias("band")).filter("band is not null").groupBy("band").agg(F.count("*").alias("n"))
