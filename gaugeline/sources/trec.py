"""Run and judgment files, six and four columns, separated by white space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import rank
from .beir import _lines, last_wins


def _fields(spark: SparkSession, path: str) -> DataFrame:
    trimmed = F.regexp_replace("value", r"^\s+|\s+$", "")
    return _lines(spark, path).withColumn("line", trimmed).filter("line <> ''").withColumn("f", F.split("line", r"\s+"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score); the rank column is not read; ``#`` lines are comments; gzip by suffix; a line
    of fewer than five fields is an error."""
    rows = _fields(spark, path).filter(~F.col("line").startswith("#"))
    score = F.when(F.size("f") >= 5, F.get("f", F.lit(4))).otherwise(F.raise_error(F.concat(F.lit("not a run line: "), "line")).cast("string"))
    return last_wins(rows.select(F.col("f")[0].alias("query_id"), F.get("f", F.lit(2)).alias("doc_id"), score.cast("double").alias("score"), "__at"), ["query_id", "doc_id"])


def read_scored_docs(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rank, score) as written; short lines are passed over."""
    rows = _fields(spark, path).filter(F.size("f") >= 5)
    return rows.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    rows = _fields(spark, path).filter(F.size("f") >= 4)
    return last_wins(rows.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("grade"), "__at"), ["query_id", "doc_id"])


def write_run(run: DataFrame, path: str, name: str, k: int = 1000, ties: str = "trec", zipped: bool = False) -> None:
    """A folder of text parts in order: queries by id, ranks from 1. Range partitions, not one task, sort it."""
    line = F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", "rank", F.col("score").cast("string"), F.lit(name))
    out = rank(run, k, ties).orderBy("query_id", "rank").select(line.alias("value"))
    out.write.option("compression", "gzip" if zipped else "none").mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", "grade")
    qrels.orderBy("query_id", "doc_id").select(line.alias("value")).write.mode("overwrite").text(path)
