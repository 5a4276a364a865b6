"""Hard negatives: mining, calibration of a scorer, suspected false negatives."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment
from .ordered import running
from .ranking import rank


def mine(run: DataFrame, qrels: DataFrame, depth: int = 50, per_query: int = 10, threshold: int = 1, ties: str = "trec") -> DataFrame:
    """(query_id, doc_id, rank, score): the first ``per_query`` documents to ``depth`` that aren't relevant;
    the rank counts the relevant ones too."""
    positive = qrels.filter(F.col("grade") >= threshold).select("query_id", "doc_id")
    left = rank(run, depth, ties).join(positive, ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank")
    return left.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= per_query).select("query_id", "doc_id", "rank", "score")


def score_pairs(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, scorer=containment) -> DataFrame:  # noqa: ANN001
    """Adds ``ce_score`` by ``scorer(query column, passage column)``; null where a text is missing. Only texts of documents
    in ``pairs`` are moved."""
    corpus = corpus.join(pairs.select("doc_id"), "doc_id", "left_semi")
    with_texts = pairs.join(queries.select("query_id", F.col("text").alias("__q")), "query_id", "left").join(corpus.select("doc_id", F.col("full_text").alias("__p")), "doc_id", "left")
    return with_texts.withColumn("ce_score", F.when(F.col("__q").isNotNull() & F.col("__p").isNotNull(), scorer(F.col("__q"), F.col("__p")))).drop("__q", "__p")


def flag(mined: DataFrame, threshold: float | Column) -> DataFrame:
    """Adds ``suspected`` (score at or over the threshold); nothing is deleted, unscored rows aren't suspected."""
    return mined.withColumn("suspected", F.coalesce(F.col("ce_score") >= threshold, F.lit(False)))


def counters(flagged: DataFrame) -> DataFrame:
    n, s = F.count("*"), F.count(F.when(F.col("suspected"), 1))
    return flagged.agg(n.alias("n_candidates"), s.alias("n_suspected")).withColumn("suspected_fraction", F.when(F.col("n_candidates") > 0, F.col("n_suspected") / F.col("n_candidates")).otherwise(0.0))


def confusion(flagged: DataFrame, queries: DataFrame, qrels: DataFrame, corpus: DataFrame, threshold: int = 1) -> DataFrame:
    """Mean token containment of usable negatives and of gold documents, and the gap (0 if either is empty)."""
    side = lambda pairs, name: score_pairs(pairs.select("query_id", "doc_id"), queries, corpus, containment).filter("ce_score is not null").agg(F.avg("ce_score").alias(f"m_{name}"), F.count("*").alias(f"n_{name}s")).withColumn("__one", F.lit(1))
    both = side(flagged.filter("not suspected"), "negative").join(side(qrels.filter(F.col("grade") >= threshold), "positive"), "__one")
    zero = F.lit(0.0)
    return both.select(F.coalesce("m_negative", zero).alias("mean_negative_containment"), F.coalesce("m_positive", zero).alias("mean_positive_containment"), F.coalesce(F.col("m_negative") - F.col("m_positive"), zero).alias("gap"), "n_negatives", "n_positives")


def auc(scores: DataFrame) -> DataFrame:
    """One row ``auc`` of (score, positive): Mann-Whitney with half credit for ties; 0.5 if a side is empty.

    Counts by distinct score and a running sum of them; ranks are never assigned to rows.
    """
    by = scores.groupBy("score").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("q"))
    upto = running(by, [F.col("score")], {"below": "q"})
    wins = upto.select("p", "q", (F.col("p") * (F.col("below") - F.col("q") / 2)).alias("w"))
    return wins.agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q")).select(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w") / (F.col("p") * F.col("q"))).otherwise(0.5).alias("auc"))


def youden(scores: DataFrame) -> DataFrame:
    """One row (threshold, tpr, fpr) of (score, positive): greatest tpr - fpr, the least threshold on ties; an
    infinite threshold if a side is empty."""
    by = scores.groupBy("score").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("q"))
    down = running(by, [F.col("score").desc()], {"tp": "p", "fp": "q"})
    rates = down.filter("tp_all > 0 and fp_all > 0").select("score", (F.col("tp") / F.col("tp_all")).alias("tpr"), (F.col("fp") / F.col("fp_all")).alias("fpr"))
    best = rates.agg(F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), -F.col("score"), "score", "tpr", "fpr")).alias("b"))
    return best.select(F.coalesce("b.score", F.lit(math.inf)).alias("threshold"), F.coalesce("b.tpr", F.lit(0.0)).alias("tpr"), F.coalesce("b.fpr", F.lit(0.0)).alias("fpr"))


def background_pairs(query_ids: list[str], relevant: dict[str, set[str]], doc_ids: list[str], per_query: int = 5, seed: int = 0) -> list[tuple[str, str]]:
    """A seeded sample: for each query in order ``per_query`` draws; a draw that hits a relevant one is lost."""
    rng = np.random.default_rng(seed)
    out = []
    for q in sorted(query_ids):
        for _ in range(per_query):
            d = doc_ids[int(rng.integers(0, len(doc_ids)))]
            if d not in relevant.get(q, set()):
                out.append((q, d))
    return out


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row: element n // 2 of the sorted values, from counts of the distinct ones."""
    by = values.groupBy(column).agg(F.count("*").alias("n"))
    upto = running(by, [F.col(column)], {"upto": "n"})
    return upto.filter(F.col("upto") > F.floor(F.col("upto_all") / 2)).agg(F.min(column).alias("median"))
