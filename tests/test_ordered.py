import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import inference, negatives, overlap
from gaugeline.sources import beir


def test_places_of_many_rows_are_each_met_once(spark):
    """Far more rows than a range sample: places 0 to n - 1, once each, in order; deciles of equal size."""
    n = 400_000
    rows = spark.range(0, n, 1, 8).select(F.col("id").cast("string").alias("query_id"), (F.xxhash64("id") % 1000 / 7.0).alias("jaccard"))
    got = overlap._numbered(rows, "jaccard").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.countDistinct("place").alias("n"), F.count("*").alias("rows")).head()
    assert tuple(got) == (0, n - 1, n, n)
    assert {r["count"] for r in overlap.deciles(rows).groupBy("decile").count().collect()} == {n // 10}


def test_running_sums_against_numpy(spark):
    rng = np.random.default_rng(0)
    score, positive = np.round(rng.normal(size=3000), 2), rng.random(3000) < 0.4
    rows = spark.createDataFrame(list(zip(score.tolist(), positive.tolist())), "score double, positive boolean").repartition(5)
    p, q = score[positive], score[~positive]
    wins = (p[:, None] > q[None]).mean() + (p[:, None] == q[None]).mean() / 2
    assert negatives.auc(rows).head()["auc"] == pytest.approx(wins)
    best = max((round((p >= t).mean() - (q >= t).mean(), 12), -t) for t in set(score))
    assert negatives.youden(rows).head()["threshold"] == -best[1]
    assert negatives.upper_median(rows, "score").head()["median"] == np.sort(score)[1500]
    ranked = {r["score"]: r["rank"] for r in inference.average_rank(rows, "score", "rank").collect()}
    assert all(ranked[x] == (score < x).sum() + ((score == x).sum() + 1) / 2 for x in set(score))
    assert negatives.auc(rows.limit(0)).head()["auc"] == 0.5


def test_headers_and_broken_lines(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("Query-ID\tcorpus-id\tscore\nq1\td1\t1\nquery-id7\td2\t2\n")
    (tmp_path / "plain.tsv").write_text("q1\td1\t1\nquery-id7\td2\t2\n")
    for name in ("q.tsv", "plain.tsv"):
        assert {tuple(r) for r in beir.read_qrels(spark, str(tmp_path / name)).collect()} == {("q1", "d1", 1), ("query-id7", "d2", 2)}
    (tmp_path / "bad.jsonl").write_text('{"_id": "a", "text": "x"}\n{"_id": \n')
    with pytest.raises(Exception, match="not a JSON object"):
        beir.read_queries(spark, str(tmp_path / "bad.jsonl")).collect()
