import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.functions import text, vectors
from gaugeline.operators import chunking, duplicates
from gaugeline.operators.retrieval import BM25, Dense, HashingEncoder
from gaugeline.plans.config import ExperimentConfig
from gaugeline.plans.experiment import run_experiment
from gaugeline.sources import beir, stores, trec

PROSE = "First sentence here. Second one follows! Third?\n\nA new paragraph. " * 60


def test_strip_and_full_text(rows):
    got = rows([("  t\x1c ", "　body\n"), ("", " x "), ("y", None)], "t string, b string").select("b", text.full_text(F.col("t"), F.col("b")).alias("f")).collect()
    assert {r["f"] for r in got} == {"t body", "x", "y"}


def test_overlap_functions(rows):
    got = rows([("Abcdef", "abcdeg")], "a string, b string").select(text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b"))).alias("j"), text.containment(F.col("a"), F.col("b")).alias("c")).head()
    assert got["j"] == pytest.approx(1 / 3) == vectors.char_jaccard("Abcdef", "abcdeg") and got["c"] == 0
    assert vectors.lcs_ratio("xabcx", "yabcz") == 3 / 5 and vectors.char_jaccard("", "a") == 0


@pytest.mark.parametrize("chunker", [chunking.FixedTokens(20, 5), chunking.RecursiveCharacters(200, 30), chunking.Semantic(HashingEncoder()), chunking.Parents(chunking.FixedTokens(20, 5), 300)])
def test_chunkers(rows, chunker):
    corpus = rows([("1", "", PROSE), ("2", "", ""), ("3", "", "one")], "doc_id string, title string, text string")
    got = chunking.chunk(corpus, chunker).collect()
    body = PROSE.strip()
    assert len({r["chunk_id"] for r in got}) == len(got) and {r["doc_id"] for r in got} == {"1", "2", "3"}
    seen = np.zeros(len(body), bool)
    for r in got:
        if r["doc_id"] == "1":
            assert r["text"] == body[r["char_start"] : r["char_end"]]
            seen[r["char_start"] : r["char_end"]] = True
            assert r["parent_text"] is None or r["text"] in r["parent_text"]
    assert all(c.isspace() or s or c == "." for c, s in zip(body, seen, strict=True))
    assert chunker.fingerprint() == chunker.fingerprint() and len(chunker.fingerprint()) == 16


def test_fixed_windows_end_at_the_tail():
    words = " ".join(f"w{i}" for i in range(50))
    spans = chunking.FixedTokens(20, 5).spans(words)
    assert [len(words[a:b].split()) for a, b in spans] == [20, 20, 20]
    with pytest.raises(ValueError):
        chunking.FixedTokens(5, 5)


def test_bm25(rows):
    chunks = rows([("c1", "red apple pie"), ("c2", "green apple"), ("c3", "the of and")], "chunk_id string, text string")
    found = BM25().index(chunks).search(rows([("q", "apple"), ("none", "zzz")], "query_id string, text string"), 10)
    assert [(r["query_id"], r["chunk_id"]) for r in found.orderBy(F.col("score").desc()).collect()] == [("q", "c2"), ("q", "c1")]
    with pytest.raises(RuntimeError):
        BM25().search(chunks, 1)


def test_bm25_against_brute_force(rows):
    """Ties both ways, queries in blocks, repeated terms; what comes back was written, not a plan over the chunks."""
    import math
    import re

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 12, rng.integers(0, 9))) for _ in range(40)] * 3
    asked = {str(q): " ".join(f"w{x}" for x in rng.integers(0, 14, 4)) for q in range(7)}
    terms = {f"d{i}": re.findall(r"\w+", t) for i, t in enumerate(texts)}
    df, mean = {t: sum(t in v for v in terms.values()) for t in {t for v in terms.values() for t in v}}, np.mean([len(v) for v in terms.values()])
    idf = {t: math.log(1 + (len(texts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    chunks = rows([(f"d{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    queries = rows([*asked.items(), ("none", "zzz")], "query_id string, text string")
    for ties in ("trec", "docid_asc"):
        want = set()
        for q, text in asked.items():
            all_ = [(round(sum(idf.get(t, 0) * v.count(t) / (v.count(t) + 0.9 * (0.6 + 0.4 * len(v) / mean)) for t in text.split()), 9), d) for d, v in terms.items()]
            best = sorted(sorted((x for x in all_ if x[0] > 0), key=lambda x: x[1], reverse=ties == "trec"), key=lambda x: -x[0])[:5]
            want |= {(q, d) for _, d in best}
        for block in (3, 8192):
            found = BM25(block=block).index(chunks).search(queries, 5, ties)
            assert {(r["query_id"], r["chunk_id"]) for r in found.collect()} == want
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_judgments_are_found_once(spark):
    """They are written, so no later reading scans the documents again."""
    from gaugeline.plans import frames

    assert "MapInArrow" not in frames.qrels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_dense_in_blocks(rows):
    x = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    vectors_ = rows([(str(i), a.tolist()) for i, a in enumerate(x)], "chunk_id string, embedding array<float>")
    asked = rows([(str(i), x[i].tolist()) for i in range(10)], "query_id string, embedding array<float>")
    got = {(r["query_id"], r["chunk_id"]) for r in Dense(block=4).index(vectors_).search(asked, 3).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert got == {(str(i), str(j)) for i in range(10) for j in np.argsort(-(u[i] @ u.T))[:3]}


def test_pairs_of_shingle_sets_against_brute_force(spark, rows):
    """Near copies that share a template: exactly the pairs within the threshold; nothing read from them cuts texts anew."""
    rng = np.random.default_rng(2)
    template = [f"t{i}" for i in range(20)]
    bodies = [[f"w{x}" for x in rng.integers(0, 400, int(rng.integers(5, 60)))] for _ in range(25)]
    texts = [" ".join(template + b) for b in bodies] + [" ".join(template + b[:-1] + ["end"] * int(rng.integers(1, 9))) for b in bodies] + [" ".join(b[2:] + b[:1]) for b in bodies]
    grams = {f"d{i}": {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in enumerate(t.split() for t in texts) if len(w) >= 5}
    corpus = rows([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").withColumn("full_text", F.col("text"))
    got = duplicates.jaccard_pairs(corpus)
    want = {(a, b) for a in grams for b in grams if a < b and grams[a] != grams[b] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert {(r["doc_a"], r["doc_b"]) for r in got.collect()} == want and want
    assert "MapInArrow" not in got._jdf.queryExecution().toString()
    assert "MapInArrow" not in duplicates.minhash_pairs(corpus)._jdf.queryExecution().toString()


def test_near_duplicates(rows):
    a = " ".join(f"w{i}" for i in range(60))
    corpus = rows([("1", a), ("2", a), ("3", a.replace("w59", "zz")), ("4", "other words entirely unlike the rest of them"), ("5", ""), ("6", "")], "doc_id string, text string").withColumn("full_text", F.col("text"))
    pairs = [tuple(r)[:2] for r in duplicates.jaccard_pairs(corpus).collect()]
    assert pairs == [("1", "3")]
    assert {(r["doc_id"], r["class_id"]) for r in duplicates.classes(corpus).filter("doc_id <> class_id").collect()} == {("2", "1")}
    found = duplicates.clusters(duplicates.minhash_pairs(corpus), checkpoint=False)
    assert {tuple(r) for r in found.collect()} >= {("1", "1"), ("2", "1")}
    assert {r["doc_id"] for r in duplicates.degenerate(corpus).collect()} == {"5", "6"}
    assert vectors.bands_for(128, 0.8) == (8, 16)
    h = vectors.MinHash(256)
    x, y = np.arange(50, dtype=np.uint64), np.arange(20, 70, dtype=np.uint64)
    assert abs((h.signature(x) == h.signature(y)).mean() - 30 / 70) < 0.12


def test_collection_and_experiment(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"_id": i, "title": "T", "text": f"apple number {i}"}) + "\n" for i in "abc") + "\n" + json.dumps({"_id": "a", "text": "the last apple wins"}) + "\n")
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q1", "text": "last apple"}) + "\n" + json.dumps({"_id": "q2", "text": "unjudged"}) + "\n")
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\ta\t1.9\nshort\tline\n")
    data = beir.load(spark, str(tmp_path))
    assert data.queries.count() == 1 and data.qrels.head()["grade"] == 1
    assert {r["full_text"] for r in data.corpus.collect()} == {"T apple number b", "T apple number c", "the last apple wins"}
    with pytest.raises(FileNotFoundError):
        beir.load(spark, str(tmp_path), split="dev")
    out = str(tmp_path / "out")
    result = run_experiment(data, ExperimentConfig(dataset="toy"), out)
    assert {r["recall"] for r in result.means.collect()} == {1.0}
    back = trec.read_run(spark, f"{out}/run")
    assert {(r["doc_id"], r["score"]) for r in back.collect()} == {(r["doc_id"], r["score"]) for r in result.run.collect()}


def test_run_files(spark, tmp_path):
    path = tmp_path / "run.txt"
    path.write_text(f"# a comment\n\nq1 Q0 d1 1 {2.0**-44!r} tag\nq1 Q0 d1 2 1e-05 tag\n")
    assert trec.read_run(spark, str(path)).head()["score"] == 1e-05
    path.write_text("q1 Q0 d1\n")
    with pytest.raises(Exception, match="not a run line"):
        trec.read_run(spark, str(path)).collect()


def test_embedding_cache(spark, rows, tmp_path):
    class Counting(HashingEncoder):
        identity = "counting"

    cache = stores.EmbeddingCache(spark, str(tmp_path / "cache"))
    data = rows([("1", "a"), ("2", "b"), ("3", "a")], "id string, text string")
    first = {r["id"]: list(r["embedding"]) for r in cache.encode(data, Counting(8), "id").collect()}
    assert cache.stats().head()["entries"] == 2 and first["1"] == first["3"]
    assert {r["id"]: list(r["embedding"]) for r in cache.encode(data, Counting(8), "id").collect()} == first
    assert cache.table().count() == 2


def test_config_is_strict_and_stable(tmp_path):
    c = ExperimentConfig()
    c.to_yaml(str(tmp_path / "c.yaml"))
    assert ExperimentConfig.from_yaml(str(tmp_path / "c.yaml")).config_hash() == c.config_hash()
    for bad in ({"nonsense": 1}, {"eval": {"ks": [200]}}, {"chunker": {"overlap_tokens": 256}}):
        with pytest.raises(ValueError):
            ExperimentConfig.model_validate(bad)


def test_streams(spark, tmp_path):
    from gaugeline.streaming import incremental

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"query_id": "q", "doc_id": "a", "score": 1.0}\n{"query_id": "q", "doc_id": "a", "score": 3.0}\n')
    log = incremental.read_json_log(spark, str(tmp_path / "in"), "query_id string, doc_id string, score double")
    incremental.merge_runs(log, "best", str(tmp_path / "c1")).awaitTermination()
    assert [tuple(r) for r in spark.table("best").collect()] == [("q", "a", 3.0)]
    incremental.append_once(log, str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
