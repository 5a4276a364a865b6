"""One thin query for each operator, with production parameters, over whole tables; SQL where SQL can say it."""

from __future__ import annotations

import string
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, bpe, decontaminate, langid, lines, quality, shards, simhash, substrings, warc
from .common import table


def _remainder(n: int, wanted: int):
    """crc32 of doc_id as text, modulo n, is ``wanted``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n)) == wanted, F.lit(False))


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reject_outliers(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), _remainder(3, 1))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score(table(spark, sf_dir, "documents"), _remainder(7, 2), tokenizer("byte_bpe_50k.tiktoken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), 50, with_text=False).withColumnRenamed("kept", "kept_sha256")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 13)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), 1000)


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"), 24)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_simhash, op4_language, op5_bpe, op6_lm_score, op7_substring_dedup, op8_decontaminate, op9_warc, op10_shards, pipeline)}

_SPACED = r"[^\x20\x09-\x0D]"
_LOWERED = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP1 = f"""
WITH cut AS (SELECT doc_id, str_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS line FROM cut),
worded AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth
           FROM every WHERE regexp_matches(line, '{_SPACED}')),
firsts AS (SELECT doc_id, pos, line, length(line) AS n FROM worded WHERE nth = 1 AND length(line) >= 20),
keyed AS (SELECT *, n AS c FROM firsts UNION ALL SELECT *, n - 1 AS c FROM firsts),
halves AS (SELECT *, c AS k, 0 AS side, left(line, (c // 2)::INT) AS half FROM keyed
           UNION ALL SELECT *, c AS k, 1 AS side, right(line, (c - c // 2)::INT) AS half FROM keyed),
pairs AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS n, b.n AS m, a.doc_id AS ad, a.pos AS ap, b.doc_id AS bd, b.pos AS bp
          FROM halves a JOIN halves b ON a.k = b.k AND a.side = b.side AND a.half = b.half AND a.n = a.c AND a.line <> b.line),
near AS (SELECT CASE WHEN (ad, ap) > (bd, bp) THEN a ELSE b END AS line FROM pairs
         WHERE n <= m AND len(list_filter(range(0, n + 1), lambda k: left(a, k::INT) = left(b, k::INT)
               AND substr(a, (k + 1 + CASE WHEN n = m THEN 1 ELSE 0 END)::INT) = substr(b, (k + 2)::INT))) > 0),
gone AS (SELECT doc_id, pos, nth > 1 AS eq FROM worded WHERE nth > 1 OR line IN (SELECT line FROM near)),
kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.pos) AS t FROM every e
         LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos WHERE g.pos IS NULL GROUP BY e.doc_id),
counts AS (SELECT doc_id, count(*) FILTER (WHERE eq) AS e, count(*) FILTER (WHERE NOT eq) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.e, 0)::BIGINT AS n_equal, coalesce(c.n, 0)::BIGINT AS n_near, sha256(coalesce(k.t, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

_OP7 = f"""
WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}+') AS s FROM documents),
words AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS word FROM cut),
windows AS (SELECT doc_id, pos, string_agg(word, ' ') OVER f AS body, count(*) OVER f AS n FROM words
            WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
late AS (SELECT doc_id, pos, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 1 ELSE 0 END AS bad FROM windows WHERE n = 50),
marked AS (SELECT w.doc_id, w.pos, w.word, max(coalesce(l.bad, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
           FROM words w LEFT JOIN late l ON l.doc_id = w.doc_id AND l.pos = w.pos),
sums AS (SELECT doc_id, count(*) AS n, sum(gone) AS g, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.g, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums s ON s.doc_id = d.doc_id
"""

_GRAMS = " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS k, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING) AS body FROM words WHERE {k} IN (SELECT k FROM bench)" for k in range(1, 14))
_OP8 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS s FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
starts AS (SELECT item, s, least(len(s), 13) AS k, unnest(range(1, len(s) - least(len(s), 13) + 2)) AS p FROM items WHERE len(s) > 0),
bench AS (SELECT DISTINCT item, k, array_to_string(s[p : p + k - 1], ' ') AS body FROM starts),
cut AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS s FROM documents),
words AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS word FROM cut),
grams AS ({_GRAMS}),
hits AS (SELECT g.doc_id, g.pos, g.k, b.item FROM grams g JOIN bench b ON b.k = g.k AND b.body = g.body),
spots AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS pos FROM hits),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) x GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id)
SELECT c.doc_id, len(c.s)::BIGINT AS n_words, coalesce(z.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items, sha256(coalesce(f.items, '')) AS items_sha256,
       coalesce(z.n_hit, 0) > 0 AND 20 * coalesce(z.n_hit, 0) >= len(c.s) AS contaminated
FROM cut c LEFT JOIN found f ON f.doc_id = c.doc_id LEFT JOIN sizes z ON z.doc_id = c.doc_id
"""

_OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY body) ELSE page_id END AS lead FROM p)
SELECT page_id, n AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN lead > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead > page_id THEN lead END AS refers_to
FROM m
"""

ORACLE = {"op1_line_dedup": _OP1, "op7_substring_dedup": _OP7, "op8_decontaminate": _OP8, "op9_warc": _OP9}
