"""From chunks to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import rank

POLICIES = {"max": lambda: F.max("score"), "sum": lambda: F.sum("score"), "mean": lambda: F.avg("score"), "first": lambda: F.max("score")}


def _mapped(run: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk runs (query_id, chunk_id, score) with doc_id; an unknown chunk is an error, not a lost row."""
    known = chunks.select(F.col("chunk_id").alias("__chunk"), F.col("doc_id"))
    both = run.join(known, F.col("chunk_id") == F.col("__chunk"), "left")
    return both.withColumn("doc_id", F.when(F.col("__chunk").isNull(), F.raise_error(F.concat(F.lit("no document for chunk "), "chunk_id")).cast("string")).otherwise(F.col("doc_id"))).drop("__chunk")


def to_documents(run: DataFrame, chunks: DataFrame, policy: str = "max") -> DataFrame:
    """A document's score from its retrieved chunks. The highest-ranked chunk has the highest score, so
    ``first`` is ``max`` by another name."""
    return _mapped(run, chunks).groupBy("query_id", "doc_id").agg(POLICIES[policy]().alias("score"))


def best_chunks(run: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk of each document, still a chunk run; ties to the least chunk_id."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "chunk_id")
    return _mapped(run, chunks).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("query_id", "chunk_id", "score")


def distinct_documents(run: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, n_docs): documents among the first k chunks."""
    top = rank(run.withColumnRenamed("chunk_id", "doc_id"), k).select("query_id", F.col("doc_id").alias("chunk_id"), "score")
    return _mapped(top, chunks).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_docs"))


def merge(*parts: DataFrame) -> DataFrame:
    """Union of runs; the larger score of a document that several have."""
    both = parts[0].select("query_id", "doc_id", "score")
    for p in parts[1:]:
        both = both.unionByName(p.select("query_id", "doc_id", "score"))
    return both.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
