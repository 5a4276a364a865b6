import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import vectors as v
from gaugeline.operators import aggregation, inference, metrics, negatives, overlap, ranking

RUN, QRELS = "query_id string, doc_id string, score double", "query_id string, doc_id string, grade int"


def test_trec_ties_are_by_string_falling(rows):
    run = rows([("q", d, 1.0) for d in ("9", "10", "aaa", "zzz")], RUN)
    order = [r["doc_id"] for r in ranking.rank(run).orderBy("rank").collect()]
    assert order == ["zzz", "aaa", "9", "10"]
    assert [r["doc_id"] for r in ranking.rank(run, 2, "docid_asc").orderBy("rank").collect()] == ["10", "9"]
    assert ranking.truncate(run, 0).count() == 0


def test_ndcg_is_linear_with_a_cut_ideal(rows):
    qrels = rows([("q", "a", 1), ("q", "b", 2)], QRELS)
    run = rows([("q", "a", 2.0), ("q", "b", 1.0)], RUN)
    got = metrics.evaluate(run, qrels, (2,)).head()
    assert got["ndcg"] == pytest.approx(0.8597186999, abs=1e-9)
    many = rows([("q", d, 1) for d in "abc"], QRELS)
    assert metrics.evaluate(run, many, (2,)).head()["ndcg"] == pytest.approx(1.0)


def test_negative_and_zero_grades_and_complete(rows):
    qrels = rows([("q1", "a", -1), ("q1", "b", 0), ("q2", "a", 1)], QRELS)
    run = rows([("q1", "a", 1.0), ("q3", "a", 1.0)], RUN)
    got = {r["query_id"]: r for r in metrics.evaluate(run, qrels, (1,)).collect()}
    assert set(got) == {"q1"} and (got["q1"]["recall"], got["q1"]["mrr"], got["q1"]["ndcg"]) == (0, 0, 0)
    assert {r["query_id"] for r in metrics.evaluate(run, qrels, (1,), complete=True).collect()} == {"q1", "q2"}
    with pytest.raises(ValueError):
        metrics.evaluate(run, qrels, (0,))


def test_unknown_chunk_raises(rows):
    run = rows([("q", "c1", 1.0), ("q", "gone", 1.0)], "query_id string, chunk_id string, score double")
    chunks = rows([("c1", "d1")], "chunk_id string, doc_id string")
    with pytest.raises(Exception, match="no document for chunk gone"):
        aggregation.to_documents(run, chunks).collect()


def test_aggregation_policies(rows):
    run = rows([("q", "c1", 1.0), ("q", "c2", 3.0), ("q", "c3", 3.0)], "query_id string, chunk_id string, score double")
    chunks = rows([("c1", "d"), ("c2", "d"), ("c3", "e")], "chunk_id string, doc_id string")
    value = lambda p: {r["doc_id"]: r["score"] for r in aggregation.to_documents(run, chunks, p).collect()}
    assert value("max")["d"] == 3 and value("sum")["d"] == 4 and value("mean")["d"] == 2 and value("first")["d"] == 3
    assert {r["chunk_id"] for r in aggregation.best_chunks(run, chunks).collect()} == {"c2", "c3"}
    assert aggregation.distinct_documents(run, chunks, 2).head()["n_docs"] == 2


def test_bootstrap_matches_plain_numpy(rows):
    x = np.random.default_rng(1).random(40)
    values = rows([("m", str(i), float(a)) for i, a in enumerate(x)], "measure string, query_id string, value double")
    got = inference.estimates(values, 2000).head()
    order = sorted(range(40), key=str)
    draws = x[order][np.random.default_rng(0).integers(0, 40, size=(2000, 40))].mean(1)
    assert (got["lo"], got["hi"]) == tuple(np.quantile(draws, [0.025, 0.975]))
    same = inference.paired(values, values, 500).head()
    assert same["mean_diff"] == 0 and same["p_value"] == 1 and not same["significant"]
    assert v.bootstrap_mean(np.zeros(0)) == (0, 0, 0) and v.bootstrap_mean(np.array([2.0])) == (2, 2, 2)
    with pytest.raises(ValueError):
        v.bootstrap_unpaired(np.zeros(0), x)


def test_spearman_and_kendall(rows):
    pairs = rows([(str(i), float(a), float(b)) for i, (a, b) in enumerate([(1, 2), (2, 1), (2, 4), (5, 9)])], "query_id string, x double, y double")
    assert inference.spearman(pairs, "x", "y").head()["rho"] == pytest.approx(v.spearman(np.array([1, 2, 2, 5.0]), np.array([2, 1, 4, 9.0])))
    flat = pairs.withColumn("y", F.lit(1.0))
    assert inference.spearman(flat, "x", "y").head()["rho"] == 0
    order = lambda s: rows([(c, i) for i, c in enumerate(s)], "item string, place int")
    assert inference.kendall(order("abc"), order("abc")).head()["tau"] == 1
    assert inference.kendall(order("abc"), order("cba")).head()["tau"] == -1
    assert inference.kendall(order("a"), order("b")).head()["tau"] == 1


def test_deciles_are_not_ntile(rows):
    scores = rows([(f"q{i:02d}", 1.0) for i in range(23)], "query_id string, jaccard double")
    got = {r["query_id"]: r["decile"] for r in overlap.deciles(scores).collect()}
    assert got == {f"q{i:02d}": min(i * 10 // 23, 9) for i in range(23)}


def test_auc_and_youden(rows):
    data = [(0.9, True), (0.5, True), (0.5, False), (0.1, False)]
    scores = rows(data, "score double, positive boolean")
    assert negatives.auc(scores).head()["auc"] == pytest.approx(0.875)
    best = negatives.youden(scores).head()
    assert (best["threshold"], best["tpr"], best["fpr"]) == (0.5, 1.0, 0.5)
    one = scores.filter("positive")
    assert negatives.auc(one).head()["auc"] == 0.5 and math.isinf(negatives.youden(one).head()["threshold"])


def test_mining_keeps_the_first_rank(rows):
    run = rows([("q", d, s) for d, s in (("a", 4.0), ("gold", 3.0), ("b", 2.0), ("c", 1.0))], RUN)
    qrels = rows([("q", "gold", 1), ("q", "b", 0)], QRELS)
    got = [(r["doc_id"], r["rank"]) for r in negatives.mine(run, qrels, 4, 2).orderBy("rank").collect()]
    assert got == [("a", 1), ("b", 3)]


def test_verdict_order(rows):
    got = rows([(5.0, True), (-2.0, True), (1.9, True), (9.0, False), (3.0, True)], "p double, s boolean").select("p", inference.verdict(F.col("p"), F.col("s")).alias("v")).collect()
    assert {r["p"]: r["v"] for r in got} == {5.0: "CONFIRMED", -2.0: "OPPOSITE DIRECTION", 1.9: "NULL", 9.0: "NULL", 3.0: "weak/ambiguous"}
