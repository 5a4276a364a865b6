import json

import pytest

from gaugeline.cli import main
from gaugeline.plans import contamination
from gaugeline.plans.config import BootstrapConfig, ChunkerConfig, ContaminationConfig, EvalConfig, RetrieverConfig
from gaugeline.sources import beir, stores

ESTIMATES = "chunker string, retriever string, condition string, measure string, mean double, lo double, hi double, n long"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    subjects = ["amber trains cross northern rivers", "violet kites follow desert wind", "copper clocks count winter hours", "silver foxes guard quiet harbours"]
    (root / "qrels").mkdir()
    (root / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "title": "", "text": s + ". " + s}) + "\n" for i, s in enumerate(subjects)))
    (root / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": s.split()[0] + " unrelated"}) + "\n" for i, s in enumerate(subjects)))
    (root / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\n" + "".join(f"q{i}\td{i}\t1\n" for i in range(4)))
    stores.save_query_set(str(root / "copied.json"), {f"s{i}": s for i, s in enumerate(subjects)}, {f"s{i}": {f"d{i}": 1} for i in range(4)})
    return root


def test_every_condition_is_scored_and_written(spark, folder, tmp_path):
    data = beir.load(spark, str(folder))
    settings = ContaminationConfig(chunkers=[ChunkerConfig()], retrievers=[RetrieverConfig()], eval=EvalConfig(ks=[1, 10], top_k=10), bootstrap=BootstrapConfig(n_resamples=200))
    contamination.run_contamination(data, settings, {"copied": stores.load_query_set(spark, str(folder / "copied.json"))}, bins=2).write(str(tmp_path / "r"))
    got = contamination.Report.read(spark, str(tmp_path / "r"))
    means = {(r["condition"], r["measure"]): r["mean"] for r in got.estimates.collect()}
    assert means[("human", "recall@10")] == means[("copied", "recall@1")] == 1.0 and len(means) == 12
    found = got.contrasts.filter("measure = 'recall@10'").head()
    assert (found["condition"], found["points"], found["verdict"]) == ("copied", 0.0, "NULL")
    strata = got.strata.filter("condition = 'copied'").collect()
    assert {(r["decile"], r["n"]) for r in strata} == {(0, 2), (1, 2)} and all(r["mean_overlap"] > 0.5 for r in strata)
    assert {r["rho"] for r in got.correlations.collect()} == {0.0}  # every query finds its document
    assert main(["show", str(tmp_path / "r")]) == 0


def test_inflation_needs_both_retrievers(rows):
    c = rows([("fixed", "bm25", "x", "recall@10", 1.0), ("fixed", "dense", "x", "recall@10", 4.0), ("parent", "bm25", "x", "recall@10", 2.0)], "chunker string, retriever string, condition string, measure string, points double")
    assert [tuple(r) for r in contamination.inflation(c).collect()] == [("fixed", "x", 1.0, 4.0, -3.0)]


def test_reorderings(rows):
    line = lambda chunker, condition, mean, w=0.01: (chunker, "bm25", condition, "recall@10", mean, mean - w, mean + w, 9)
    e = rows([line("a", "human", 0.5), line("b", "human", 0.6), line("c", "human", 0.605), line("a", "x", 0.7), line("b", "x", 0.5), line("c", "x", 0.6)], ESTIMATES)
    got = {(r["chunker_a"], r["chunker_b"], r["kind"]) for r in contamination.reorderings(e).collect()}
    assert got == {("a", "b", "inversion"), ("a", "c", "inversion"), ("b", "c", "newly separated")}
    order = [r["chunker"] for r in contamination.chunker_orders(e).filter("condition = 'x'").orderBy("place").collect()]
    assert order == ["a", "c", "b"]


def test_sample_and_overlap_from_the_command_line(spark, folder, capsys):
    assert main(["sample", str(folder), "--n", "2"]) == 0
    assert len(capsys.readouterr().out.split()) == 2
    assert main(["overlap", str(folder)]) == 0
