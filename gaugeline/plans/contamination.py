"""The contamination experiment: every chunker with every retriever under every query condition, as long tables."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, inference, metrics, overlap
from ..sources.beir import Dataset
from .config import ContaminationConfig
from .experiment import build_chunker, conditions, contrast, score_conditions


@dataclass
class Report:
    """Tables that all start with (chunker, retriever)."""

    estimates: DataFrame  # condition, measure, mean, lo, hi, n
    contrasts: DataFrame  # condition, measure, mean_diff, lo, hi, p_value, n, significant, points, verdict
    strata: DataFrame  # condition, decile, measure, n, mean_overlap, mean
    correlations: DataFrame  # condition, measure, rho, lo, hi, n

    def write(self, path: str) -> None:
        for f in fields(self):
            getattr(self, f.name).write.mode("overwrite").parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Report:
        return cls(*(spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)))


def run_contamination(data: Dataset, config: ContaminationConfig, synthetic: dict[str, tuple[DataFrame, DataFrame]], measure: str = "recall@10", bins: int = 10) -> Report:
    """``synthetic``: (queries, qrels) by condition name. Strata and correlations are of ``measure``."""
    queries, qrels = conditions((data.queries, data.qrels), synthetic)
    e, times = config.eval, config.bootstrap.n_resamples
    made: dict[str, list[DataFrame]] = {f.name: [] for f in fields(Report)}
    for c in config.chunkers:
        chunks = chunking.chunk(data.corpus, build_chunker(c)).cache()
        for r in config.retrievers:
            values, overlaps = (t.cache() for t in score_conditions(data.corpus, chunks, queries, qrels, r, e.top_k, tuple(e.ks)))
            keep = lambda name, df, condition: made[name].append(df.select(F.lit(c.kind).alias("chunker"), F.lit(r.kind).alias("retriever"), F.lit(condition).alias("condition"), *df.columns))  # noqa: B023, E731
            for name in ("human", *sorted(synthetic)):
                own = values.filter(F.col("condition") == name).drop("condition")
                keep("estimates", inference.estimates(own, times, config.bootstrap.confidence, config.seed), name)
                if name != "human":
                    keep("contrasts", contrast(values, name, times=times, seed=config.seed), name)
                one = own.filter(F.col("measure") == measure)
                mine = overlaps.filter(F.col("condition") == name).drop("condition")
                keep("strata", overlap.stratified(overlap.deciles(mine, bins=bins), one), name)
                both = mine.join(one, "query_id")
                keep("correlations", inference.spearman_interval(both, "jaccard", "value", min(times, 2000), config.seed).select(F.lit(measure).alias("measure"), "rho", "lo", "hi", "n"), name)
    empty = {"contrasts": "chunker string, retriever string, condition string, measure string, mean_diff double, lo double, hi double, p_value double, n long, significant boolean, points double, verdict string"}
    spark = data.corpus.sparkSession
    return Report(**{k: reduce(DataFrame.unionByName, v) if v else spark.createDataFrame([], empty[k]) for k, v in made.items()})


def inflation(contrasts: DataFrame, measure: str = "recall@10") -> DataFrame:
    """(chunker, condition, bm25, dense, difference) in points, where both retrievers ran."""
    wide = contrasts.filter(F.col("measure") == measure).groupBy("chunker", "condition").pivot("retriever", ["bm25", "dense"]).agg(F.first("points"))
    return wide.filter("bm25 is not null and dense is not null").withColumn("difference", F.col("bm25") - F.col("dense"))


def reorderings(estimates: DataFrame, measure: str = "recall@10") -> DataFrame:
    """(retriever, condition, chunker_a, chunker_b, kind): pairs of chunkers that a condition puts in another order
    than people's queries do: ``inversion`` (apart under both, the other way round) or ``newly separated``."""
    e = estimates.filter(F.col("measure") == measure).select("retriever", "condition", "chunker", "mean", "lo", "hi")
    side = lambda s: e.select("retriever", "condition", *(F.col(c).alias(f"{c}_{s}") for c in ("chunker", "mean", "lo", "hi")))
    pairs = side("a").join(side("b"), ["retriever", "condition"]).filter("chunker_a < chunker_b")
    pairs = pairs.select("retriever", "condition", "chunker_a", "chunker_b", inference.separated(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b")).alias("apart"), (F.col("mean_a") > F.col("mean_b")).alias("first"))
    human = pairs.filter("condition = 'human'").select("retriever", "chunker_a", "chunker_b", F.col("apart").alias("h_apart"), F.col("first").alias("h_first"))
    both = pairs.filter("condition <> 'human'").join(human, ["retriever", "chunker_a", "chunker_b"])
    kind = F.when(F.col("apart") & F.col("h_apart") & (F.col("first") != F.col("h_first")), "inversion").when(F.col("apart") & ~F.col("h_apart"), "newly separated")
    return both.withColumn("kind", kind).filter("kind is not null").select("retriever", "condition", "chunker_a", "chunker_b", "kind")


def chunker_orders(estimates: DataFrame, measure: str = "recall@10") -> DataFrame:
    """(retriever, condition, place, chunker, mean): by mean, then name, both falling."""
    from pyspark.sql import Window

    w = Window.partitionBy("retriever", "condition").orderBy(F.col("mean").desc(), F.col("chunker").desc())
    return estimates.filter(F.col("measure") == measure).select("retriever", "condition", F.row_number().over(w).alias("place"), "chunker", "mean")


def judged_overlap(data: Dataset) -> DataFrame:
    """Each judged query's greatest overlap with its gold documents."""
    asked = metrics.judged(data.queries, data.qrels)
    return overlap.per_query(overlap.score(overlap.pairs(asked, data.qrels, data.corpus)))
