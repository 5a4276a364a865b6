"""Tables that grow: the embedding cache, vector indexes by fingerprint, synthetic query sets, reports."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exclusion_reason
from ..operators.retrieval import encode, fingerprint


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class EmbeddingCache:
    """Embeddings by content: key = SHA-256 of identity, NUL and text. Hits are a join, misses an anti join;
    only misses are encoded and appended."""

    SCHEMA = "key string, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if _exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def encode(self, rows: DataFrame, encoder, id_col: str, kind: str = "document") -> DataFrame:  # noqa: ANN001
        """(id_col, embedding) of ``rows`` (id_col, text); equal texts are encoded and stored once."""
        prefix = getattr(encoder, "prefix", {}).get(kind, "")
        key = F.sha2(F.concat(F.lit(f"{encoder.identity}|{prefix}\0"), F.coalesce("text", F.lit(""))), 256)
        keyed = rows.select(F.col(id_col).cast("string").alias(id_col), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
        missing = keyed.select("key", "text").dropDuplicates(["key"]).join(self.table().select("key"), "key", "left_anti")
        encode(missing, encoder, "key", kind).write.mode("append").parquet(self.path)
        return keyed.select(id_col, "key").join(self.table(), "key").select(id_col, "embedding")

    def stats(self) -> DataFrame:
        return self.table().agg(F.count("*").alias("entries"), F.max(F.size("embedding")).alias("dim"))


class VectorStore:
    """An index's vectors in a folder named by its fingerprint; built once, reused while contents agree."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def upsert(self, chunks: DataFrame, encoder, force: bool = False) -> DataFrame:  # noqa: ANN001
        path = f"{self.root}/{fingerprint(encoder.identity, chunks)}"
        if force or not _exists(self.spark, f"{path}/_SUCCESS"):
            encode(chunks, encoder, "chunk_id").write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def sample_passages(ids: list[str], n: int, seed: int) -> list[str]:
    """A seeded sample of the sorted ids, sorted; all if there are no more than n."""
    ids = sorted(ids)
    return ids if n >= len(ids) else sorted(random.Random(seed).sample(ids, n))


def generated(rows: DataFrame) -> DataFrame:
    """Adds ``reason`` (null: usable) to generated queries (query_id, doc_id, text, stop_reason)."""
    return rows.withColumn("reason", exclusion_reason(F.col("text"), F.col("stop_reason")))


def to_query_set(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, qrels, excluded by reason) of generated queries; gold is the source document at grade 1."""
    usable = rows.filter("reason is null")
    return usable.select("query_id", "text"), usable.select("query_id", "doc_id", F.lit(1).alias("grade")), rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def latest_records(rows: DataFrame, key: str = "doc_id", order: str = "at") -> DataFrame:
    """A resume log's last record of each source document."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def todo(wanted: DataFrame, log: DataFrame, key: str = "doc_id") -> DataFrame:
    return wanted.join(log.select(key), key, "left_anti")


def save_query_set(path: str, queries: dict[str, str], qrels: dict[str, dict[str, int]], **provenance) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({**provenance, "queries": queries, "qrels": qrels}, f, sort_keys=True, indent=2)


def load_query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of a saved set."""
    whole = spark.read.option("multiLine", True).schema("queries map<string,string>, qrels map<string,map<string,int>>").json(path)
    queries = whole.select(F.explode("queries").alias("query_id", "text"))
    return queries, whole.select(F.explode("qrels").alias("query_id", "docs")).select("query_id", F.explode("docs").alias("doc_id", "grade"))


def load_prompt(path: str) -> tuple[str, str]:
    """A template without its ``#`` lines, and the first 16 digits of its SHA-256."""
    import hashlib

    with open(path, encoding="utf-8") as f:
        body = "\n".join(x for x in f.read().splitlines() if not x.lstrip().startswith("#")).strip()
    if "{passage}" not in body:
        raise ValueError(f"{path} has no {{passage}}")
    return body, hashlib.sha256(body.encode()).hexdigest()[:16]


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved experiment reports (the long Parquet tables that ``plans.experiment`` writes)."""
    return spark.read.parquet(path)
