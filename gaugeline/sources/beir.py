"""Collections on disk: corpus and queries as JSON lines, judgments as tab-separated lines."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import full_text

#: The public collections' documents, test queries and test judgments.
REGISTRY = {
    "scifact": {"docs": 5183, "queries": 300, "judgments": 339, "split": "test"},
    "nfcorpus": {"docs": 3633, "queries": 323, "judgments": 12334, "split": "test"},
    "fiqa": {"docs": 57638, "queries": 648, "judgments": 1706, "split": "test"},
}


def dataset_names() -> list[str]:
    return sorted(REGISTRY)


def spec(name: str) -> dict:
    if name not in REGISTRY:
        raise KeyError(f"unknown collection {name!r}; there are {', '.join(dataset_names())}")
    return REGISTRY[name]


@dataclass
class Dataset:
    name: str
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    split: str = "test"
    checksums: dict[str, str] = field(default_factory=dict)

    def relevant(self, threshold: int = 1) -> DataFrame:
        return self.qrels.filter(F.col("grade") >= threshold)


def last_wins(df: DataFrame, keys: list[str], order: str = "__at") -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", order)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, __at): lines and their place (file, then position)."""
    place = F.struct(F.col("_metadata.file_path").alias("file_path"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).withColumn("__at", place)


def _documents(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows of a JSON-lines file; a line that isn't an object with an ``_id`` is an error that shows the line."""
    parsed = F.from_json("value", "_id string, " + ", ".join(f"{f} string" for f in fields))
    rows = _lines(spark, path).filter(F.trim("value") != "").select(parsed.alias("j"), "__at", "value")
    broken = F.raise_error(F.concat(F.lit(f"{path}: not a JSON object with an _id: "), F.substring("value", 1, 200))).cast("string")
    checked = F.when(F.col("j._id").isNotNull(), F.col("j._id")).otherwise(broken)
    return rows.select(checked.alias("id"), *(F.coalesce(f"j.{f}", F.lit("")).alias(f) for f in fields), "__at")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, title, text, full_text); missing fields are empty, the last of equal ids wins."""
    rows = last_wins(_documents(spark, path, ("title", "text")), ["id"]).withColumnRenamed("id", "doc_id")
    return rows.withColumn("full_text", full_text(F.col("title"), F.col("text")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return last_wins(_documents(spark, path, ("text",)), ["id"]).withColumnRenamed("id", "query_id")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, grade); the first line of a file is a header if it begins with ``query-id``, in any case;
    lines of fewer than three fields are passed over; grades are cut to whole numbers."""
    lines = _lines(spark, path)
    heads = lines.filter(F.lower("value").startswith("query-id")).select("value", "__at", F.col("__at").getField("file_path").alias("file"))
    heads = heads.groupBy("file").agg(F.min("__at").alias("head"))  # a row a file
    firsts = lines.groupBy(F.col("__at").getField("file_path").alias("file")).agg(F.min("__at").alias("head")).join(heads, ["file", "head"])
    lines = lines.join(F.broadcast(firsts.select(F.col("head").alias("__head"))), F.col("__at") == F.col("__head"), "left_anti")
    rows = lines.withColumn("f", F.split("value", "\t")).filter(F.size("f") >= 3)
    typed = rows.select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("doc_id"), F.col("f")[2].cast("double").cast("int").alias("grade"), "__at")
    return last_wins(typed, ["query_id", "doc_id"])


def file_sha256(path: str, piece: int = 1 << 20) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while data := f.read(piece):
            digest.update(data)
    return digest.hexdigest()


def load(spark: SparkSession, folder: str, name: str | None = None, split: str = "test") -> Dataset:
    """A collection's folder: corpus.jsonl, queries.jsonl, qrels/<split>.tsv. Only judged queries stay."""
    root = Path(folder)
    judged = root / "qrels" / f"{split}.tsv"
    if not judged.exists():
        raise FileNotFoundError(f"no split {split!r} in {root}; there are {sorted(p.stem for p in (root / 'qrels').glob('*.tsv'))}")
    files = {"corpus": root / "corpus.jsonl", "queries": root / "queries.jsonl", "qrels": judged}
    qrels = read_qrels(spark, str(judged))
    queries = read_queries(spark, str(files["queries"])).join(qrels.select("query_id"), "query_id", "left_semi")
    return Dataset(name or root.name, read_corpus(spark, str(files["corpus"])), queries, qrels, split, {k: file_sha256(str(p)) for k, p in files.items()})
