"""Language identification by rank-order profiles (out-of-place distance of frequent n-grams).

A text is lowered; runs of anything but letters become one gap; its profile is the ``size`` most frequent
n-grams of one to three characters (gaps mark word edges), by falling count, ties by the n-gram's code. A
language's profile is made the same way from the counts of *all* training texts of that language. The
distance sums, over a document's n-grams, how far each is out of place; an absent one costs ``size``.

Text without a letter, or null, is ``und`` with score 0; with no training text every document is ``und``.
Ties go to the language first in order. Rows with a null language only don't teach. An empty table gives an
empty result; other columns are ignored. Language, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wordstream import U, rows_of

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8)


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed 21 bits a character (a gap is 1), and their counts."""
    code = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.where(_letters()[code] > 0, code, 0) if len(code) else code
    code = np.concatenate(([0], code, [0])).astype(U)
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    packed = np.where(code == 0, U(1), code)  # so that a gap in front makes another n-gram
    one, two = code, packed[:-1] << U(21) | packed[1:]
    three = (two[:-1] << U(21)) | packed[2:]
    inner = code[1:-1] != 0  # a gap in the middle says nothing
    every = np.concatenate((one[one != 0], two, three[inner]))
    if not (code != 0).any():
        return np.zeros(0, U), np.zeros(0, np.int64)
    every.sort()
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[new], np.diff(np.append(new, len(every)))


def profile(text: bytes, size: int) -> np.ndarray:
    """The text's n-grams, most frequent first."""
    g, n = grams(text)
    if len(g) > 4 * size:  # what can't be among the first needs no sorting
        least = np.partition(n, len(n) - size)[len(n) - size]
        g, n = g[n >= least], n[n >= least]
    return g[np.lexsort((g, -n))][:size]


def _counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held: dict[str, list] = {}

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        g, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(g, kind="stable")
        g, n = g[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        return g[new], np.add.reduceat(n, new) if len(new) else n

    def out(lang: str) -> Iterator:
        g, n = merged(held.pop(lang))
        for s in range(0, len(g), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[s : s + (1 << 16)])), pa.array(g[s : s + (1 << 16)].view(np.int64)), pa.array(n[s : s + (1 << 16)])], names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in rows_of(batch, "lang"):
            parts = held.setdefault(lang, [])
            parts.append(grams(text))
            if len(parts) >= 256:
                held[lang] = [merged(parts)]
                if len(held[lang][0][0]) > 1 << 20:  # strange texts: pass on what is there
                    yield from out(lang)
        if len(held) > 64:
            for lang in list(held):
                yield from out(lang)
    for lang in list(held):
        yield from out(lang)


def learn(docs: DataFrame, size: int = 400) -> DataFrame:
    """(lang, gram, place) of each language's ``size`` most frequent n-grams over all of ``docs`` (lang, text)."""
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1)
    return ranked.filter(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs, self.grams, self.places = size, [], [], []
        for lang in sorted({r[0] for r in rows}):
            g = np.array([r[1] for r in rows if r[0] == lang], np.int64).view(U)
            p = np.array([r[2] for r in rows if r[0] == lang], np.int64)
            order = np.argsort(g)
            self.langs.append(lang)
            self.grams.append(g[order])
            self.places.append(p[order])

    def predict(self, text: bytes) -> tuple[str, float]:
        own = profile(text, self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        place, best = np.arange(len(own)), []
        for g, p in zip(self.grams, self.places, strict=True):
            at = np.minimum(np.searchsorted(g, own), len(g) - 1)
            best.append(int(np.where(g[at] == own, np.minimum(np.abs(p[at] - place), self.size), self.size).sum()))
        k = int(np.argmin(best))
        return self.langs[k], 1 - best[k] / (self.size * len(own))


def identify(docs: DataFrame, held_out: Column, size: int = 400, most_languages: int = 2000) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (1 less the distance as a share of the largest).

    Learns from the rows with a language that aren't held out. Profiles go to every task: ``size`` n-grams for
    each of at most ``most_languages`` languages, which is checked.
    """
    spark = docs.sparkSession
    rows = learn(docs.filter(~held_out), size).limit(size * most_languages + 1).collect()
    if len(rows) > size * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    known = spark.sparkContext.broadcast(Profiles([tuple(r) for r in rows], size))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(doc, out, *known.value.predict(text)) for doc, out, text in rows_of(batch, "doc_id", "held_out")]
            cols = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "held_out", "lang_pred", "score"])

    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return every.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
