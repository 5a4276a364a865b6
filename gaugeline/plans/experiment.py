"""Whole experiments: one index, many query conditions, metrics, intervals, provenance."""

from __future__ import annotations

import json
import platform
import subprocess
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregation, chunking, inference, metrics, overlap
from ..operators.retrieval import BM25, Dense, HashingEncoder, encode
from ..sources import trec
from ..sources.beir import Dataset
from .config import ChunkerConfig, ExperimentConfig, RetrieverConfig


def build_chunker(c: ChunkerConfig, encoder=None) -> chunking.Chunker:  # noqa: ANN001
    plain = {"fixed": lambda: chunking.FixedTokens(c.chunk_tokens, c.overlap_tokens), "recursive": lambda: chunking.RecursiveCharacters(c.chunk_chars, c.overlap_chars)}
    if c.kind == "semantic":
        return chunking.Semantic(encoder or HashingEncoder(), c.breakpoint_percentile, c.min_chunk_chars, c.max_chunk_chars)
    return chunking.Parents(plain[c.child_kind](), c.parent_chars) if c.kind == "parent" else plain[c.kind]()


def search(chunks: DataFrame, queries: DataFrame, r: RetrieverConfig, k: int) -> DataFrame:
    """A chunk run (query_id, chunk_id, score)."""
    if r.kind == "bm25":
        return BM25(r.k1, r.b).index(chunks).search(queries, k)
    encoder = HashingEncoder(r.dim)
    return Dense().index(encode(chunks, encoder, "chunk_id")).search(encode(queries, encoder, "query_id", "query"), k)


@dataclass
class Timer:
    spans: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.spans[name] = self.spans.get(name, 0.0) + time.perf_counter() - began


@dataclass
class Result:
    run: DataFrame
    scores: DataFrame
    means: DataFrame
    dedup_means: DataFrame
    estimates: DataFrame
    manifest: dict


def run_experiment(data: Dataset, config: ExperimentConfig, out: str | None = None, queries: DataFrame | None = None, qrels: DataFrame | None = None) -> Result:
    """Chunk, index, search, collapse, score, infer; with ``out`` also Parquet tables, a run and a manifest."""
    if (queries is None) != (qrels is None):
        raise ValueError("queries and judgments are replaced together or not at all")
    queries, qrels, e, timer = (data.queries, data.qrels, config.eval, Timer()) if queries is None else (queries, qrels, config.eval, Timer())
    asked = metrics.judged(queries, qrels)
    with timer.span("chunk"):
        chunks = chunking.chunk(data.corpus, build_chunker(config.chunker)).cache()
        n_chunks = chunks.count()
    with timer.span("search"):
        found = search(chunks, asked, config.retriever, e.top_k).cache()
        found.count()
    scored = lambda run: metrics.evaluate(run, qrels, tuple(e.ks), e.tie_break, e.rel_threshold, complete=True)
    run = aggregation.to_documents(found, chunks, e.aggregation)
    scores = scored(run)
    dedup = scored(aggregation.to_documents(aggregation.best_chunks(found, chunks), chunks, e.aggregation))
    estimates = inference.estimates(metrics.long_form(scores), config.bootstrap.n_resamples, config.bootstrap.confidence, config.seed)
    manifest = {"config": config.model_dump(mode="json"), "config_hash": config.config_hash(), "run_tag": config.run_tag(), "checksums": data.checksums, "chunks": n_chunks, "timings": timer.spans, **provenance()}
    result = Result(run, scores, metrics.mean_scores(scores), metrics.mean_scores(dedup), estimates, manifest)
    if out:
        with timer.span("write"):
            trec.write_run(run, f"{out}/run", config.run_tag(), e.top_k, e.tie_break)
            for name in ("scores", "means", "dedup_means", "estimates"):
                getattr(result, name).write.mode("overwrite").parquet(f"{out}/{name}")
        with open(f"{out}/manifest.json", "w", encoding="utf-8") as f:
            json.dump(manifest, f, sort_keys=True, indent=2)
    return result


def provenance() -> dict:
    import numpy
    import pyspark

    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10).stdout.strip()
        except (OSError, subprocess.TimeoutExpired):
            return ""

    return {"git": {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}}


def conditions(human: tuple[DataFrame, DataFrame], synthetic: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Queries and judgments of all conditions in one frame each; ids carry their condition: ``human`` first,
    then the others by name."""
    every = {"human": human, **{k: synthetic[k] for k in sorted(synthetic)}}
    tag = lambda df, name: df.withColumn("condition", F.lit(name)).withColumn("query_id", F.concat(F.lit(name + "\x1f"), "query_id"))
    queries, qrels = None, None
    for name, (q, r) in every.items():
        a, b = tag(q.select("query_id", "text"), name), tag(r.select("query_id", "doc_id", "grade"), name)
        queries, qrels = (a, b) if queries is None else (queries.unionByName(a), qrels.unionByName(b))
    return queries, qrels


def score_conditions(corpus: DataFrame, chunks: DataFrame, queries: DataFrame, qrels: DataFrame, r: RetrieverConfig, k: int = 100, ks: tuple[int, ...] = (1, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """One index and one search for all conditions: (condition, measure, query_id, value) and each query's
    overlap (condition, query_id, jaccard, containment)."""
    of = queries.select("query_id", "condition")
    run = aggregation.to_documents(search(chunks, metrics.judged(queries, qrels), r, k), chunks)
    values = metrics.long_form(metrics.evaluate(run, qrels, ks, complete=True)).join(of, "query_id").select("condition", "measure", "query_id", "value")
    best = overlap.per_query(overlap.score(overlap.pairs(queries, qrels, corpus)))
    return values, best.select("query_id", "jaccard", "containment").join(of, "query_id").select("condition", "query_id", "jaccard", "containment")


def contrast(values: DataFrame, condition: str, against: str = "human", times: int = 10_000, seed: int = 0) -> DataFrame:
    """Unpaired comparison of a condition with another, in points and with a verdict for each measure."""
    pick = lambda c: values.filter(F.col("condition") == c)
    found = inference.unpaired(pick(condition), pick(against), times, seed=seed)
    return found.withColumn("points", F.col("mean_diff") * 100).withColumn("verdict", inference.verdict(F.col("points"), F.col("significant")))
