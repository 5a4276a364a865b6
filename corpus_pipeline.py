"""The corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as Parquet to the shared
folder and rereads for the next: a lost executor costs tasks, never an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import bpe, decontaminate, lines, quality, simhash
from gaugeline.llm.common import materialize, table
from gaugeline.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language and source's cloud go. Each row is judged by its
    own text: null text goes, null and repeated ids make no difference."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no word is left goes. Rows without an id stay as they are; rows that repeat
    id and text are one document; the earlier of equal lines, by id and place, stays."""
    return lines.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8), that of the least id.
    Rows without an id stay; rows that repeat id and text stay or go together."""
    return simhash.drop_near_duplicates(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser benchmark passages are cut out. Each row by its own text; null text stays."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests, a row for each row; null text is empty. An empty table is empty after every stage."""
    return bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), with_ids=True).drop("decoded")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("decontamination", decontamination), ("bpe", encoding)]

#: Rank estimates, wide fingerprints and merges can't be said in SQL. The tests hold near-dedup, line dedup and
#: decontamination against brute force stage by stage; there is no brute-force run of the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
