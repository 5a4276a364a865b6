"""Benchmark decontamination: a broadcast hash set of normalised test windows, a scan, exact verification.

Words are ``[0-9a-z\\x80-]`` runs after lowering A-Z. A window is ``width`` consecutive words of an item; an
item of fewer words, but not none, is one window. The set of window hashes is broadcast: its size is that of
the benchmark, which is counted first and refused above ``most_windows`` (split the benchmark then). Documents
are scanned block by block; each hit by hash is compared word by word before it counts. Nothing is shuffled.

Null or empty texts have no words and no hits; repeated items count once each by item_id; null item ids are
ignored; an empty benchmark hits nothing; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordstream import ALNUM, BLOCK, Words, blocks, covered, giving_back, rows_of


@dataclass
class WindowSet:
    """``hashes[k]``: sorted hashes of the windows of k words; ``items``: window words -> the items it is of."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    items: dict[bytes, list[str]] = field(default_factory=dict)


def window_set(items: list[tuple[str, bytes]], width: int) -> WindowSet:
    out, found = WindowSet(), {}
    for name, text in items:
        w = Words([text], ALNUM, lower=True)
        n = len(w.starts)
        k = min(n, width)
        if not k:
            continue
        at, hashes = w.windows(k)
        found.setdefault(k, []).append(hashes)
        words = [w.word(i) for i in range(n)]
        for i in at:
            names = out.items.setdefault(b" ".join(words[i : i + k]), [])
            if name not in names:
                names.append(name)
    out.hashes = {k: np.unique(np.concatenate(v)) for k, v in sorted(found.items())}
    return out


def _member(values: np.ndarray, pool: np.ndarray) -> np.ndarray:
    at = np.searchsorted(pool, values)
    at[at == len(pool)] = 0
    return pool[at] == values


def hits(texts: list[bytes], known: WindowSet) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words of the texts, which of them lie in an occurrence, and each text's items."""
    w = Words(texts, ALNUM, lower=True)
    hit = np.zeros(len(w.starts), bool)
    items: list[set[str]] = [set() for _ in texts]
    for k, pool in known.hashes.items():
        at, hashes = w.windows(k)
        true = []
        for i in at[_member(hashes, pool)].tolist():
            names = known.items.get(b" ".join(w.word(j) for j in range(i, i + k)))
            if names:
                true.append(i)
                items[w.doc[i]].update(names)
        if true:
            hit |= covered(np.array(true), k, len(hit))
    return w, hit, items


def _benchmark(benchmark: DataFrame, width: int, most_windows: int) -> WindowSet:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).head()["b"]
    if size > 8 * most_windows:  # a window starts with a word, words take two bytes or more
        raise ValueError(f"a benchmark of {size} bytes is too large to broadcast; split it and scan once for each part")
    return window_set([(r["item_id"], r["text"].encode()) for r in rows.collect()], width)


def report(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_windows: int = 4_000_000) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 (sorted ids, comma-joined), contaminated."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(_benchmark(benchmark, width, most_windows))

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows in blocks(rows_of(batch, "doc_id"), BLOCK):
                w, hit, items = hits([t for _, t in rows], known.value)
                total = np.concatenate(([0], np.cumsum(hit)))
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                n = np.diff(w.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.int64()), pa.array(n), pa.array(n_hit), pa.array([len(s) for s in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(s)).encode()).hexdigest() for s in items]), pa.array((n_hit > 0) & (20 * n_hit >= n))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, most_windows: int = 4_000_000) -> DataFrame:
    """``docs`` without the hit words, and without the documents that are contaminated.

    A document with hits below the threshold keeps its text but for the bytes from the first to the last word
    of each occurrence. Every column stays; ``text`` changes, and ``n_chars`` with it where there is one.
    """
    known = docs.sparkSession.sparkContext.broadcast(_benchmark(benchmark, width, most_windows))
    schema = docs.schema
    where = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            for rows in blocks(rows_of(batch), BLOCK):
                yield cleaned(batch.slice(at, len(rows)), [t for (t,) in rows])
                at += len(rows)

    def cleaned(part, texts: list[bytes]):
        import pyarrow as pa

        w, hit, _ = hits(texts, known.value)
        keep, cut = [], {}
        for i, text in enumerate(texts):
            a, b = w.first[i], w.first[i + 1]
            n_hit = int(hit[a:b].sum())
            if n_hit and 20 * n_hit >= b - a:
                continue
            if n_hit:
                cut[len(keep)] = _without(text, w, hit, a, b)
            keep.append(i)
        kept = part.take(pa.array(keep, pa.int64()))
        if cut:
            for c, of in [(where, str)] + [(size, len)] * (size is not None):
                values = kept.column(c).to_pylist()
                for i, text in cut.items():
                    values[i] = of(text)
                field = kept.schema.field(c)
                kept = kept.set_column(c, field, pa.array(values, pa.string() if of is str else pa.int64()).cast(field.type))
        return kept

    return docs.mapInArrow(giving_back(scan), schema)


def _without(text: bytes, w: Words, hit: np.ndarray, a: int, b: int) -> str:
    base, out, at = w.bounds[w.doc[a]], [], 0
    edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
    for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(text[at : w.starts[a + s] - base])
        at = int(w.ends[a + e - 1] - base)
    return b"".join([*out, text[at:]]).decode()
