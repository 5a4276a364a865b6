"""Every operator as a named query over the driver's tables, and its twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS
from ..functions.text import exclusion_reason as reason_of
from ..operators import aggregation, chunking, duplicates, inference, metrics, negatives, overlap, ranking
from ..operators.ordered import written
from ..operators.retrieval import BM25, Dense
from . import frames
from .config import RetrieverConfig
from .experiment import conditions, score_conditions

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
KS = (1, 5, 10)


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query, with its SQL where there is one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


# --- SQL parts -------------------------------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')".format
_SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORDS = ("list_filter(regexp_split_to_array(lower(coalesce({}, '')), '" + _SPACE.replace("{", "{{").replace("}", "}}") + "+'), lambda w: w <> '')").format
_STRIP = ("regexp_replace(regexp_replace(coalesce({}, ''), '^" + _SPACE.replace("{", "{{").replace("}", "}}") + "+', ''), '" + _SPACE.replace("{", "{{").replace("}", "}}") + "+$', '')").format
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

_QRELS = """qrels AS (SELECT b.item_id::VARCHAR AS query_id, d.doc_id::VARCHAR AS doc_id, (1 + coalesce(l.quality, 0))::INT AS grade
  FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '' LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_TERMS = f"""terms AS (SELECT doc_id::VARCHAR AS doc_id, list_filter({_TOKENS('text')}, lambda t: length(t) > 1 AND t NOT IN ({_STOP})) AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM terms)"""
_BM25 = f"""{_QRELS}, {_TERMS},
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id::VARCHAR AS query_id, unnest(list_filter({_TOKENS('text')}, lambda t: length(t) > 1 AND t NOT IN ({_STOP}))) AS term
  FROM benchmark WHERE item_id::VARCHAR IN (SELECT query_id FROM qrels)) x GROUP BY query_id, term),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM terms) x WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sums AS (SELECT a.query_id, tf.doc_id, round(sum(a.times * ln(1 + (s.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf / (tf.tf + 0.9 * (1 - 0.4 + 0.4 * tf.dl / s.avgdl))), 9) AS score
  FROM tf JOIN df USING (term) JOIN asked a USING (term) CROSS JOIN stat s GROUP BY a.query_id, tf.doc_id),
run AS (SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rn FROM sums WHERE score > 0) x WHERE rn <= 100),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM run)"""
_KS = "ks AS (SELECT unnest([1, 5, 10]) AS k)"
_EVAL = f"""{_BM25}, {_KS},
ideal AS (SELECT query_id, greatest(grade, 0) AS gain, row_number() OVER (PARTITION BY query_id ORDER BY greatest(grade, 0) DESC, doc_id) AS place FROM qrels),
best AS (SELECT query_id, k, sum(gain / log2(place + 1)) AS idcg FROM ideal JOIN ks ON place <= k GROUP BY query_id, k),
rel AS (SELECT query_id, count(*) FILTER (WHERE grade >= 1) AS n FROM qrels GROUP BY query_id),
got AS (SELECT r.query_id, k, count(*) FILTER (WHERE grade >= 1) AS hits, min(rank) FILTER (WHERE grade >= 1) AS first, sum(greatest(grade, 0) / log2(rank + 1)) AS dcg
  FROM ranked r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id JOIN ks ON rank <= k GROUP BY r.query_id, k),
scores AS (SELECT b.query_id, b.k, CASE WHEN rel.n > 0 THEN coalesce(g.hits, 0) / rel.n ELSE 0 END AS recall, coalesce(1.0 / g.first, 0) AS mrr, CASE WHEN b.idcg > 0 THEN coalesce(g.dcg, 0) / b.idcg ELSE 0 END AS ndcg
  FROM best b JOIN rel USING (query_id) LEFT JOIN got g ON g.query_id = b.query_id AND g.k = b.k)"""
_PAIRS = f"""{_QRELS}, pairs AS (SELECT q.query_id, q.doc_id, b.text AS query, {_STRIP('d.text')} AS passage FROM qrels q
  JOIN benchmark b ON b.item_id::VARCHAR = q.query_id JOIN documents d ON d.doc_id::VARCHAR = q.doc_id WHERE q.grade >= 1)"""
_GRAM = "(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) <= 5 THEN [lower({0})] ELSE list_distinct(list_transform(range(1, length({0}) - 3), lambda i: lower({0})[i : i + 4])) END)".format
_OVERLAP = f"""{_PAIRS}, grams AS (SELECT *, {_GRAM('query')} AS x, {_GRAM('passage')} AS y, list_distinct({_TOKENS('query')}) AS tq, list_distinct({_TOKENS('passage')}) AS tp FROM pairs),
scored AS (SELECT query_id, doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS jaccard,
  CASE WHEN len(tq) = 0 THEN 0 ELSE len(list_intersect(tq, tp)) / len(tq) END AS containment FROM grams),
top AS (SELECT query_id, doc_id, jaccard, containment FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard DESC, doc_id) AS rn FROM scored) x WHERE rn = 1)"""
_DECILES = f"{_OVERLAP}, deciles AS (SELECT *, least(floor((row_number() OVER (ORDER BY jaccard, query_id) - 1) * 10 / count(*) OVER ()), 9)::INT AS decile FROM top)"
_MINED = f"""{_BM25}, mined AS (SELECT * FROM (SELECT query_id, doc_id, rank, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM ranked r
  WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM qrels q WHERE q.query_id = r.query_id AND q.doc_id = r.doc_id AND q.grade >= 1)) x WHERE rn <= 10)"""
_CONT = f"""(CASE WHEN len(list_distinct({_TOKENS('b.text')})) = 0 THEN 0 ELSE len(list_intersect(list_distinct({_TOKENS('b.text')}), list_distinct({_TOKENS('d.text')}))) / len(list_distinct({_TOKENS('b.text')})) END)"""
_FLAGGED = f"""{_MINED}, flagged AS (SELECT m.query_id, m.doc_id, m.rank, {_CONT} AS ce, {_CONT} >= 0.5 AS suspected FROM mined m JOIN benchmark b ON b.item_id::VARCHAR = m.query_id JOIN documents d ON d.doc_id::VARCHAR = m.doc_id)"""
_LABELLED = f"""{_FLAGGED}, gold AS (SELECT {_CONT} AS score FROM qrels q JOIN benchmark b ON b.item_id::VARCHAR = q.query_id JOIN documents d ON d.doc_id::VARCHAR = q.doc_id),
sides AS (SELECT round(score, 9) AS score, true AS positive FROM gold UNION ALL SELECT round(ce, 9), false FROM flagged)"""
_SHINGLES = f"""words AS (SELECT doc_id::VARCHAR AS doc_id, {_WORDS('text')} AS w FROM documents), long AS (SELECT * FROM words WHERE len(w) >= 5),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM long),
classes AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS class_id FROM sets),
heads AS (SELECT doc_id, s, len(s) AS n FROM classes WHERE doc_id = class_id),
rows AS (SELECT doc_id, n, unnest(s) AS g FROM heads),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM rows a JOIN rows b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b, c / (na + nb - c) AS similarity FROM shared WHERE c / (na + nb - c) >= 0.8)"""
_CLUSTERS = f"""RECURSIVE {_SHINGLES}, edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT class_id, doc_id FROM classes WHERE class_id <> doc_id UNION SELECT doc_id, class_id FROM classes WHERE class_id <> doc_id),
walk(start, node) AS (SELECT a, a FROM edges UNION SELECT w.start, e.b FROM walk w JOIN edges e ON e.a = w.node),
clusters AS (SELECT node AS doc_id, min(start) AS cluster_id FROM walk GROUP BY node)"""


# --- collection ------------------------------------------------------------------------------------------


@query(f"""WITH {_QRELS}, per AS (SELECT query_id, count(*) AS j, count(*) FILTER (WHERE grade > 0) AS r FROM qrels GROUP BY query_id)
SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT round(avg(length(coalesce(text, ''))), 6) FROM documents) AS mean_chars, count(*) AS n_queries,
  sum(j)::BIGINT AS n_judgments, round(avg(j), 6) AS judgments_per_query, round(avg(r), 6) AS relevant_per_query FROM per""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.corpus_stats(frames.corpus(spark, sf_dir), frames.queries(spark, sf_dir), frames.qrels(spark, sf_dir))
    return _r(out, "mean_chars", "judgments_per_query", "relevant_per_query")


@query(f"WITH {_QRELS} SELECT grade, count(*) AS n FROM qrels GROUP BY grade")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.qrels(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("n"))


@query(f"WITH {_QRELS} SELECT item_id::VARCHAR AS query_id, text FROM benchmark WHERE item_id::VARCHAR IN (SELECT query_id FROM qrels)")
def judged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.judged(frames.queries(spark, sf_dir), frames.qrels(spark, sf_dir))


@query(f"SELECT doc_id::VARCHAR AS doc_id, sha256({_STRIP('text')}) AS body FROM documents")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.corpus(spark, sf_dir).select("doc_id", F.sha2("full_text", 256).alias("body"))


@query(f"SELECT doc_id::VARCHAR AS doc_id FROM documents WHERE len({_WORDS('text')}) < 5")
def degenerate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.degenerate(frames.corpus(spark, sf_dir))


@query(f"""WITH g AS (SELECT CASE WHEN role = 'tool' THEN 'model_declined' WHEN {_STRIP('text')} = '' THEN 'empty' WHEN length(text) > 300 THEN 'too_long' END AS reason FROM conversations)
SELECT coalesce(reason, 'usable') AS reason, count(*) AS n FROM g GROUP BY 1""")
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = frames.table(spark, sf_dir, "conversations")
    reason = reason_of(F.coalesce("text", F.lit("")), F.when(F.col("role") == "tool", "refusal"))
    return turns.select(F.coalesce(reason, F.lit("usable")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query()
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(frames.corpus(spark, sf_dir), chunking.FixedTokens()).drop("parent_text")


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(frames.corpus(spark, sf_dir), chunking.RecursiveCharacters()).drop("parent_text")


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import HashingEncoder

    return chunking.chunk(frames.corpus(spark, sf_dir), chunking.Semantic(HashingEncoder())).drop("parent_text")


@query()
def parent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chunking.chunk(frames.corpus(spark, sf_dir), chunking.Parents())
    return out.select("chunk_id", "char_start", "char_end", F.length("parent_text").alias("parent_chars"), F.sha2("parent_text", 256).alias("parent"))


# --- search and ranking ----------------------------------------------------------------------------------


@query(f"WITH {_BM25} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM ranked")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(ranking.rank(frames.run(spark, sf_dir)).select("query_id", "doc_id", "rank", "score"), "score")


@query("""WITH q AS (SELECT vec_id::VARCHAR AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id % 20 = 0),
v AS (SELECT vec_id::VARCHAR AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT query_id, doc_id, round(list_cosine_similarity(q.e, v.e), 9) AS score FROM q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM s)
SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = frames.table(spark, sf_dir, "embeddings")
    found = Dense().index(vectors.select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")).search(vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding"), 10)
    return _r(ranking.rank(found.withColumnRenamed("chunk_id", "doc_id")).select("query_id", "doc_id", "rank", "score"), "score")


_DENSE_RUN = """q AS (SELECT conv_id::VARCHAR || '.' || turn AS query_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL),
c AS (SELECT conv_id::VARCHAR || '#' || turn AS chunk_id, conv_id::VARCHAR AS doc_id, turn, length(coalesce(text, '')) AS n FROM conversations WHERE role <> 'user'),
crun AS (SELECT q.query_id, c.chunk_id, c.doc_id, round(c.n / (1.0 + abs(c.turn - split_part(q.query_id, '.', 2)::INT)), 9) AS score FROM q JOIN c ON c.doc_id = split_part(q.query_id, '.', 1))"""


def _chunk_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(chunk run, chunk map): turns of the same conversation, scored by length and nearness."""
    turns = frames.table(spark, sf_dir, "conversations")
    q = turns.filter("role = 'user' and text is not null").select(F.col("conv_id").cast("string").alias("c"), F.concat(F.col("conv_id").cast("string"), F.lit("."), "turn").alias("query_id"), F.col("turn").alias("t"))
    chunks = turns.filter("role <> 'user'").select(F.concat(F.col("conv_id").cast("string"), F.lit("#"), "turn").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"), "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    run = q.join(chunks, q["c"] == chunks["doc_id"]).select("query_id", "chunk_id", F.round(F.col("n") / (1.0 + F.abs(F.col("turn") - F.col("t"))), 9).alias("score"))
    return run, chunks.select("chunk_id", "doc_id")


def _aggregate(policy: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, chunks = _chunk_run(spark, sf_dir)
        return _r(aggregation.to_documents(found, chunks, policy), "score")

    run.__name__ = f"agg_{policy}"
    query(f"WITH {_DENSE_RUN} SELECT query_id, doc_id, round({sql}, 6) AS score FROM crun GROUP BY query_id, doc_id")(run)


for _policy, _sql in {"max": "max(score)", "sum": "sum(score)", "mean": "avg(score)", "first": "max(score)"}.items():
    _aggregate(_policy, _sql)


@query(f"""WITH {_DENSE_RUN} SELECT query_id, chunk_id, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) AS rn FROM crun) x WHERE rn = 1""")
def dedup_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(aggregation.best_chunks(*_chunk_run(spark, sf_dir)), "score")


@query(f"""WITH {_DENSE_RUN} SELECT query_id, count(DISTINCT doc_id) AS n_docs FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id DESC) AS rn FROM crun) x WHERE rn <= 5 GROUP BY query_id""")
def distinct_docs_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.distinct_documents(*_chunk_run(spark, sf_dir), 5)


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ranked = ranking.rank(frames.run(spark, sf_dir))
    return ranked.filter("rank <= 60").select("query_id", "doc_id", "score"), ranked.filter("rank > 40").select("query_id", "doc_id", (F.col("score") * 1.5).alias("score"))


@query(f"""WITH {_BM25} SELECT query_id, doc_id, round(max(s), 6) AS score FROM
(SELECT query_id, doc_id, score AS s FROM ranked WHERE rank <= 60 UNION ALL SELECT query_id, doc_id, score * 1.5 FROM ranked WHERE rank > 40) x GROUP BY query_id, doc_id""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(aggregation.merge(*_halves(spark, sf_dir)), "score")


_COARSE = "coarse AS (SELECT query_id, doc_id, floor(score) AS score FROM run)"


def _coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with scores cut to whole numbers: many ties."""
    return _cut(frames.run(spark, sf_dir))


def _cut(run: DataFrame) -> DataFrame:
    return run.withColumn("score", F.floor("score").cast("double"))


@query(f"WITH {_BM25}, {_COARSE} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC)::INT AS rank FROM coarse")
def rank_trec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_coarse(spark, sf_dir))


@query(f"WITH {_BM25}, {_COARSE} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM coarse")
def rank_docid_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_coarse(spark, sf_dir), ties="docid_asc")


@query(f"WITH {_BM25}, {_COARSE} SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rn FROM coarse) x WHERE rn <= 7")
def truncate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.truncate(_coarse(spark, sf_dir), 7)


# --- metrics ---------------------------------------------------------------------------------------------


def _judged_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(run, judgments), both written: made once for a query."""
    qrels = frames.qrels(spark, sf_dir)
    return frames.run(spark, sf_dir, judgments=qrels), qrels


def _scores(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> DataFrame:
    qrels = frames.qrels(spark, sf_dir) if qrels is None else qrels
    return metrics.evaluate(frames.run(spark, sf_dir, judgments=qrels), qrels, KS, complete=True)


def _metric(name: str, column: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _r(_scores(spark, sf_dir).select("query_id", "k", column), column)

    run.__name__ = name
    query(f"WITH {_EVAL} SELECT query_id, k, round({column}, 6) AS {column} FROM scores")(run)


for _name, _column in {"recall_at_k": "recall", "mrr_at_k": "mrr", "ndcg_at_k": "ndcg"}.items():
    _metric(_name, _column)


@query(f"WITH {_EVAL} SELECT k, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scores GROUP BY k")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(metrics.mean_scores(_scores(spark, sf_dir)), "recall", "mrr", "ndcg")


@query(f"WITH {_EVAL} SELECT query_id, k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM scores")
def evaluate_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_scores(spark, sf_dir), "recall", "mrr", "ndcg")


@query()
def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, index, search, collapse, rank, score: macro means."""
    qrels = frames.qrels(spark, sf_dir)
    chunks = written(chunking.chunk(frames.corpus(spark, sf_dir), chunking.FixedTokens()).select("chunk_id", "doc_id", "text"), "chunks")
    found = BM25().index(chunks).search(metrics.judged(frames.queries(spark, sf_dir), qrels), 100)
    run = aggregation.to_documents(found, chunks.join(found.select("chunk_id"), "chunk_id", "left_semi"))
    return _r(metrics.mean_scores(metrics.evaluate(run, qrels, KS, complete=True)), "recall", "mrr", "ndcg")


@query(f"WITH {_BM25}, f AS (SELECT r.query_id, min(rank) AS found FROM ranked r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id GROUP BY r.query_id) SELECT DISTINCT q.query_id, coalesce(f.found, 0)::INT AS found FROM qrels q LEFT JOIN f ON f.query_id = q.query_id")
def difficulty_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.first_relevant(*_judged_run(spark, sf_dir))


@query(f"""WITH {_BM25}, f AS (SELECT r.query_id, min(rank) AS found FROM ranked r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id GROUP BY r.query_id),
w AS (SELECT DISTINCT q.query_id, coalesce(f.found, 0) AS found FROM qrels q LEFT JOIN f ON f.query_id = q.query_id)
SELECT CASE WHEN found = 1 THEN '1' WHEN found BETWEEN 2 AND 10 THEN '2-10' WHEN found BETWEEN 11 AND 100 THEN '11-100' ELSE 'none' END AS band, count(*) AS n FROM w WHERE found <= 100 GROUP BY 1""")
def difficulty_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.difficulty_bands(metrics.first_relevant(*_judged_run(spark, sf_dir)))


@query(f"""WITH {_BM25}, f AS (SELECT r.query_id, min(rank) AS found FROM ranked r JOIN qrels q ON q.query_id = r.query_id AND q.doc_id = r.doc_id GROUP BY r.query_id),
n AS (SELECT found, row_number() OVER (ORDER BY found) AS i, count(*) OVER () AS c FROM f) SELECT found::INT AS median FROM n WHERE i = c // 2 + 1""")
def median_found_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.upper_median(metrics.first_relevant(*_judged_run(spark, sf_dir)).filter("found > 0"), "found")


# --- overlap ---------------------------------------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> DataFrame:
    qrels = frames.qrels(spark, sf_dir) if qrels is None else qrels
    return overlap.pairs(frames.queries(spark, sf_dir), qrels, frames.corpus(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> DataFrame:
    return written(overlap.per_query(overlap.score(_pairs(spark, sf_dir, qrels))).select("query_id", "doc_id", "jaccard", "containment"), "overlap")


@query(f"WITH {_OVERLAP} SELECT query_id, doc_id, round(jaccard, 6) AS jaccard FROM scored")
def char5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(overlap.score(_pairs(spark, sf_dir)).select("query_id", "doc_id", "jaccard"), "jaccard")


@query(f"WITH {_OVERLAP} SELECT query_id, doc_id, round(containment, 6) AS containment FROM scored")
def token_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(overlap.score(_pairs(spark, sf_dir)).select("query_id", "doc_id", "containment"), "containment")


@query()
def lcs_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(overlap.score(_pairs(spark, sf_dir), with_lcs=True).select("query_id", "doc_id", "lcs_ratio"), "lcs_ratio")


@query(f"WITH {_OVERLAP} SELECT query_id, doc_id, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment FROM top")
def query_overlap_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_best(spark, sf_dir), "jaccard", "containment")


@query(f"""WITH {_OVERLAP} SELECT count(*) AS n, round(avg(jaccard), 6) AS mean, round(quantile_cont(jaccard, 0.1), 6) AS p10, round(quantile_cont(jaccard, 0.5), 6) AS p50,
round(quantile_cont(jaccard, 0.9), 6) AS p90, round(max(jaccard), 6) AS max FROM top""")
def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(overlap.summary(_best(spark, sf_dir)), "mean", "p10", "p50", "p90", "max")


@query(f"WITH {_DECILES} SELECT query_id, decile FROM deciles")
def overlap_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.deciles(_best(spark, sf_dir)).select("query_id", "decile")


@query(f"WITH {_OVERLAP}, e AS (SELECT unnest(range(11)) AS edge) SELECT e.edge::INT AS edge, round(list_extract((SELECT quantile_cont(jaccard, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM top), (e.edge + 1)::INT), 6) AS value FROM e")
def decile_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(overlap.boundaries(_best(spark, sf_dir)), "value")


@query(f"""WITH {_EVAL}, {_DECILES.replace(_QRELS + ", ", "", 1)}
SELECT d.decile, s.k, count(*) AS n, round(avg(d.jaccard), 6) AS mean_overlap, round(avg(s.recall), 6) AS mean FROM deciles d JOIN scores s USING (query_id) GROUP BY d.decile, s.k""")
def stratified_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = frames.qrels(spark, sf_dir)
    values = _scores(spark, sf_dir, qrels).select("query_id", F.col("k").alias("measure"), F.col("recall").alias("value"))
    return _r(overlap.stratified(overlap.deciles(_best(spark, sf_dir, qrels)), values).withColumnRenamed("measure", "k"), "mean_overlap", "mean")


# --- near duplicates -------------------------------------------------------------------------------------


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus = frames.corpus(spark, sf_dir)
    sets = duplicates.shingle_sets(corpus)
    of = duplicates.classes(corpus, sets=sets)
    return duplicates.jaccard_pairs(corpus, sets=sets, of=of), of


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, classes = _linked(spark, sf_dir)
    same = classes.filter("doc_id <> class_id").select(F.col("class_id").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    return duplicates.clusters(pairs.select("doc_a", "doc_b").union(same))


@query(f"""WITH {_SHINGLES}, n AS (SELECT d, count(*) AS n FROM (SELECT a AS d FROM links UNION ALL SELECT b FROM links) x GROUP BY d)
SELECT c.doc_id, c.class_id, coalesce(n.n, 0) AS n_links FROM classes c LEFT JOIN n ON n.d = c.class_id""")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class (equal shingle sets) and the number of other classes within 0.8."""
    pairs, classes = _linked(spark, sf_dir)
    n = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n"))
    return classes.join(n, "class_id", "left").select("doc_id", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


@query()
def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.minhash_pairs(frames.corpus(spark, sf_dir))


@query(f"WITH {_CLUSTERS} SELECT doc_id, cluster_id FROM clusters")
def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)


@query(f"WITH {_CLUSTERS}, {_QRELS} SELECT DISTINCT cluster_id FROM clusters WHERE doc_id IN (SELECT doc_id FROM qrels)")
def dup_clusters_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = frames.qrels(spark, sf_dir).select("doc_id")
    return _clustered(spark, sf_dir).join(judged, "doc_id", "left_semi").select("cluster_id").distinct()


# --- inference -------------------------------------------------------------------------------------------


def _overlap_and_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, jaccard, recall): recall at 10; written, as ranks read it several times."""
    qrels = frames.qrels(spark, sf_dir)
    both = _best(spark, sf_dir, qrels).join(_scores(spark, sf_dir, qrels).filter("k = 10"), "query_id")
    return written(both.select("query_id", "jaccard", "recall"), "both")


@query(f"""WITH {_EVAL}, {_OVERLAP.replace(_QRELS + ", ", "", 1)}, p AS (SELECT jaccard AS x, recall AS y FROM top JOIN scores USING (query_id) WHERE k = 10),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS b FROM p)
SELECT CASE WHEN count(*) < 3 OR stddev_pop(a) = 0 OR stddev_pop(b) = 0 THEN 0 ELSE round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) END AS rho FROM r""")
def spearman_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _overlap_and_recall(spark, sf_dir)
    return _r(inference.spearman(both, "jaccard", "recall"), "rho")


@query()
def spearman_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _overlap_and_recall(spark, sf_dir)
    return _r(inference.spearman_interval(both, "jaccard", "recall"), "rho", "lo", "hi")


_ORDERS = "o AS (SELECT source AS item, row_number() OVER (ORDER BY count(*) DESC, source) AS p, row_number() OVER (ORDER BY avg(length(text)) DESC, source) AS q FROM documents GROUP BY source)"


@query(f"WITH {_ORDERS}, s AS (SELECT sign((a.p - b.p) * (a.q - b.q)) AS g FROM o a JOIN o b ON a.p < b.p) SELECT CASE WHEN count(*) FILTER (WHERE g <> 0) > 0 THEN round(sum(g) / count(*) FILTER (WHERE g <> 0), 6) ELSE 1 END AS tau FROM s")
def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources ordered by documents and by mean length."""
    from pyspark.sql import Window

    by = frames.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("item")).agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("m"))
    order = lambda c: by.select("item", F.row_number().over(Window.orderBy(F.col(c).desc(), "item")).alias("place"))
    return _r(inference.kendall(order("n"), order("m")), "tau")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(inference.estimates(metrics.long_form(_scores(spark, sf_dir))), "mean", "lo", "hi")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Values of the sparse run, and of the same run with ties broken the other way on coarse scores."""
    run, qrels = _judged_run(spark, sf_dir)
    return metrics.long_form(metrics.evaluate(run, qrels, KS, complete=True)), metrics.long_form(metrics.evaluate(_cut(run), qrels, KS, "docid_asc", complete=True))


@query()
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(inference.paired(*_two(spark, sf_dir)), "mean_diff", "lo", "hi", "p_value")


@query()
def unpaired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(inference.unpaired(*_two(spark, sf_dir)), "mean_diff", "lo", "hi", "p_value")


@query()
def condition_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circular query set against the human one, over one index and one search."""
    from .experiment import contrast

    queries, qrels = conditions((frames.queries(spark, sf_dir), frames.qrels(spark, sf_dir)), {"synthetic": frames.synthetic(spark, sf_dir)})
    values, _ = score_conditions(frames.corpus(spark, sf_dir), frames.pseudo_chunks(spark, sf_dir), queries, qrels, RetrieverConfig())
    return _r(contrast(values, "synthetic"), "mean_diff", "lo", "hi", "p_value", "points")


@query("""WITH g AS (SELECT source, round((avg(l.quality) - 0.8) * 100, 9) AS points, count(*) >= 10 AS significant FROM documents d JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN NOT significant OR abs(points) < 2 THEN 'NULL' WHEN points >= 5 THEN 'CONFIRMED' WHEN points <= -2 THEN 'OPPOSITE DIRECTION' ELSE 'weak/ambiguous' END AS verdict FROM g""")
def h1_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision rule on the quality share of each source against 0.8."""
    both = frames.table(spark, sf_dir, "documents").select("doc_id", "source").join(frames.table(spark, sf_dir, "labels"), "doc_id")
    by = both.groupBy("source").agg(F.round((F.avg("quality") - 0.8) * 100, 9).alias("points"), (F.count("*") >= 10).alias("significant"))
    return by.select("source", inference.verdict(F.col("points"), F.col("significant")).alias("verdict"))


# --- hard negatives --------------------------------------------------------------------------------------


def _mined(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> DataFrame:
    qrels = frames.qrels(spark, sf_dir) if qrels is None else qrels
    return written(negatives.mine(frames.run(spark, sf_dir, judgments=qrels), qrels), "mined")


def _flagged(spark: SparkSession, sf_dir: str, qrels: DataFrame | None = None) -> DataFrame:
    return negatives.flag(negatives.score_pairs(_mined(spark, sf_dir, qrels), frames.queries(spark, sf_dir), frames.corpus(spark, sf_dir)), 0.5)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(score, positive): gold pairs and mined ones; written, as places are found in two readings."""
    qrels = frames.qrels(spark, sf_dir)
    gold = negatives.score_pairs(qrels, frames.queries(spark, sf_dir), frames.corpus(spark, sf_dir))
    return written(gold.select(F.round("ce_score", 9).alias("score"), F.lit(True).alias("positive")).union(_flagged(spark, sf_dir, qrels).select(F.round("ce_score", 9), F.lit(False))), "labelled")


@query(f"WITH {_MINED} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM mined")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(_mined(spark, sf_dir), "score")


@query(f"WITH {_FLAGGED} SELECT count(*) AS n_candidates, count(*) FILTER (WHERE suspected) AS n_suspected, round(count(*) FILTER (WHERE suspected) / count(*), 6) AS suspected_fraction FROM flagged")
def suspected_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(negatives.counters(_flagged(spark, sf_dir)), "suspected_fraction")


@query(f"""WITH {_LABELLED}, n AS (SELECT avg(ce) AS m, count(*) AS c FROM flagged WHERE NOT suspected), p AS (SELECT avg(score) AS m, count(*) AS c FROM gold)
SELECT round(coalesce(n.m, 0), 6) AS mean_negative_containment, round(coalesce(p.m, 0), 6) AS mean_positive_containment, round(coalesce(n.m - p.m, 0), 6) AS gap, n.c AS n_negatives, p.c AS n_positives FROM n CROSS JOIN p""")
def confusion_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = frames.qrels(spark, sf_dir)
    out = negatives.confusion(written(_flagged(spark, sf_dir, qrels), "flagged"), frames.queries(spark, sf_dir), qrels, frames.corpus(spark, sf_dir))
    return _r(out, "mean_negative_containment", "mean_positive_containment", "gap")


@query(f"""WITH {_LABELLED} SELECT round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
FROM (SELECT score FROM sides WHERE positive) p CROSS JOIN (SELECT score FROM sides WHERE NOT positive) q""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(negatives.auc(_labelled(spark, sf_dir)), "auc")


@query(f"""WITH {_LABELLED}, t AS (SELECT DISTINCT score AS t FROM sides), n AS (SELECT count(*) FILTER (WHERE positive) AS p, count(*) FILTER (WHERE NOT positive) AS q FROM sides),
j AS (SELECT t, count(*) FILTER (WHERE positive AND score >= t) / any_value(n.p) AS tpr, count(*) FILTER (WHERE NOT positive AND score >= t) / any_value(n.q) AS fpr FROM t CROSS JOIN sides CROSS JOIN n GROUP BY t)
SELECT round(t, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM j ORDER BY round(tpr - fpr, 12) DESC, t LIMIT 1""")
def youden_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(negatives.youden(_labelled(spark, sf_dir)), "threshold", "tpr", "fpr")
