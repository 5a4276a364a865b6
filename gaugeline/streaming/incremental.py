"""Structured Streaming: resumable logs, embeddings that are added once, run shards merged as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.stores import EmbeddingCache


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append_once(log: DataFrame, path: str, checkpoint: str, key: str = "doc_id", time: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Appends each key's first record to a Parquet table; with ``time`` state older than ``late`` is let go."""
    rows = log.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else log.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def embed_new(texts: DataFrame, cache: EmbeddingCache, encoder, checkpoint: str) -> StreamingQuery:  # noqa: ANN001
    """Encodes what the cache lacks of each micro-batch (text_id, text)."""
    return texts.writeStream.foreachBatch(lambda batch, _: cache.encode(batch, encoder, "text_id").write.format("noop").mode("overwrite").save()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_runs(shards: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The best score of each (query_id, doc_id) over all shards so far, in a table of memory for inspection."""
    best = shards.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return best.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
