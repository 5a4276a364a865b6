"""The driver's tables in the roles of a retrieval collection."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import full_text, split_words
from ..operators import metrics
from ..operators.ordered import written
from ..operators.retrieval import BM25

#: A query set above this many bytes is searched for in the texts part by part.
MOST_QUERY_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, text, full_text) of ``documents``."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("full_text", full_text(F.col("title"), F.col("text")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def mentions(docs: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, doc_id) where a document contains a query's text, in one pass over the documents with an
    automaton of all queries (not a comparison of every pair)."""
    size = needles.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).head()["b"]
    if size > MOST_QUERY_BYTES:
        raise ValueError("too many bytes of queries for one pass; split them")
    wanted: dict[str, list[str]] = {}
    for r in needles.filter("text <> ''").collect():
        wanted.setdefault(r["text"], []).append(r["query_id"])
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator) -> Iterator:
        import ahocorasick
        import pyarrow as pa

        found = ahocorasick.Automaton()
        for text, ids in sent.value.items():
            found.add_word(text, ids)
        if sent.value:
            found.make_automaton()
        for batch in batches:
            out = set()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if sent.value and text:
                    out.update((q, doc) for _, ids in found.iter(text) for q in ids)
            rows = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["query_id", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "query_id string, doc_id string")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, grade): documents that hold an item word for word; one grade more for quality. Written, so that
    the documents are scanned once however often it is read."""
    gold = mentions(corpus(spark, sf_dir), queries(spark, sf_dir))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    return written(gold.join(labels, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("grade")), "qrels")


def pseudo_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk."""
    return corpus(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def run(spark: SparkSession, sf_dir: str, k: int = 100, judgments: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score): sparse search of the judged items in whole documents."""
    asked = metrics.judged(queries(spark, sf_dir), qrels(spark, sf_dir) if judgments is None else judgments)
    return BM25().index(pseudo_chunks(spark, sf_dir)).search(asked, k).select("query_id", F.col("chunk_id").alias("doc_id"), "score")


def synthetic(spark: SparkSession, sf_dir: str, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """Generated queries in the circular way under study: words 6 to 17 of ``n`` documents, a sample in the
    order of their ids' digests; gold is the source."""
    docs = corpus(spark, sf_dir).select("doc_id", split_words(F.col("text")).alias("w")).filter(F.size("w") >= 17)
    picked = docs.orderBy(F.md5("doc_id"), "doc_id").limit(n).select(F.concat(F.lit("s"), "doc_id").alias("query_id"), "doc_id", F.array_join(F.slice("w", 6, 12), " ").alias("text"))
    return picked.select("query_id", "text"), picked.select("query_id", "doc_id", F.lit(1).alias("grade"))
