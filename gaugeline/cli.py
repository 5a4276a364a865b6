"""Command line: version, corpus list and stats, run, compare, dupes, overlap, sample, contaminate, show, negatives."""

from __future__ import annotations

import argparse

from . import __version__


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gaugeline").getOrCreate()


def _show(report) -> None:  # noqa: ANN001
    from .plans import contamination

    keys = ["chunker", "retriever", "condition"]
    report.contrasts.orderBy(*keys, "measure").show(200, False)
    report.correlations.orderBy(*keys).show(100, False)
    contamination.inflation(report.contrasts).orderBy("chunker", "condition").show(100, False)
    contamination.reorderings(report.estimates).show(100, False)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="gaugeline")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("corpora")
    for name in ("stats", "dupes", "overlap"):
        c = sub.add_parser(name)
        c.add_argument("folder")
    run = sub.add_parser("run")
    run.add_argument("folder")
    run.add_argument("--config")
    run.add_argument("--ks", help="comma-separated cutoffs")
    run.add_argument("--out")
    compare = sub.add_parser("compare")
    compare.add_argument("a", help="folder of a run's scores")
    compare.add_argument("b")
    mine = sub.add_parser("negatives")
    mine.add_argument("folder")
    mine.add_argument("--depth", type=int, default=50)
    mine.add_argument("--per-query", type=int, default=10)
    sample = sub.add_parser("sample", help="source documents for generated queries")
    sample.add_argument("folder")
    sample.add_argument("--n", type=int, default=500)
    sample.add_argument("--seed", type=int, default=0)
    mixed = sub.add_parser("contaminate")
    mixed.add_argument("folder")
    mixed.add_argument("--config")
    mixed.add_argument("--set", action="append", default=[], metavar="NAME=FILE", help="a saved query set")
    mixed.add_argument("--out")
    sub.add_parser("show").add_argument("folder", help="what contaminate wrote")
    a = p.parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    from .sources import beir

    if a.command == "corpora":
        for name in beir.dataset_names():
            print(name, beir.spec(name))
        return 0
    from .operators import duplicates, inference, metrics, negatives, overlap
    from .plans import contamination
    from .plans.config import ContaminationConfig, ExperimentConfig
    from .plans.experiment import run_experiment
    from .sources import stores

    spark = _session()
    if a.command == "compare":
        read = lambda f: metrics.long_form(spark.read.parquet(f"{f}/scores"))
        inference.paired(read(a.a), read(a.b)).orderBy("measure").show(100, False)
        return 0
    if a.command == "show":
        _show(contamination.Report.read(spark, a.folder))
        return 0
    data = beir.load(spark, a.folder)
    if a.command == "sample":
        for doc in stores.sample_passages([r["doc_id"] for r in data.corpus.select("doc_id").collect()], a.n, a.seed):
            print(doc)
        return 0
    if a.command == "overlap":
        overlap.summary(contamination.judged_overlap(data)).show(truncate=False)
        return 0
    if a.command == "contaminate":
        settings = ContaminationConfig.from_yaml(a.config) if a.config else ContaminationConfig(dataset=data.name)
        sets = {**settings.synthetic, **dict(x.split("=", 1) for x in a.set)}
        report = contamination.run_contamination(data, settings, {k: stores.load_query_set(spark, v) for k, v in sets.items()})
        if a.out:
            report.write(a.out)
            report = contamination.Report.read(spark, a.out)
        _show(report)
        return 0
    if a.command == "stats":
        metrics.corpus_stats(data.corpus, data.queries, data.qrels).show(truncate=False)
    elif a.command == "dupes":
        duplicates.clusters(duplicates.minhash_pairs(data.corpus), checkpoint=False).groupBy("cluster_id").count().orderBy("count", ascending=False).show(50, False)
    else:
        config = ExperimentConfig.from_yaml(a.config) if a.command == "run" and a.config else ExperimentConfig(dataset=data.name)
        if a.command == "run" and a.ks:
            ks = [int(k) for k in a.ks.split(",")]
            config = config.model_copy(update={"eval": config.eval.model_copy(update={"ks": ks, "top_k": max(config.eval.top_k, *ks)})})
        result = run_experiment(data, config, a.out if a.command == "run" else None)
        if a.command == "run":
            result.means.orderBy("k").show(100, False)
        else:
            negatives.counters(negatives.flag(negatives.score_pairs(negatives.mine(result.run, data.qrels, a.depth, a.per_query), data.queries, data.corpus), 1.0)).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
