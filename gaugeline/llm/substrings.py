"""Substring dedup by difference-cover anchors.

A *window* is ``window`` consecutive words. Words covered by a window whose word sequence also starts in a
document with a smaller doc_id are removed; windows are judged on the input.

Only windows that can repeat are hashed in full. A difference cover D modulo v holds, for any two residues, a
shift that takes both into D. So of two equal runs of a + v - 1 words, whatever their places i and j, some
pair of equal *anchors* (a words) starts at i + s and j + s with both places in D modulo v: anchors at cover
places alone (6 of 31) find every repeat. Steps:

1. anchors of every text; an anchor of several documents of a batch is known to be shared there and only one
   of its rows goes on to be compared;
2. documents with a shared anchor extend it: each window that holds a shared anchor is hashed;
3. a document loses the windows of whose hash it isn't the least document; inside a batch that is known at
   once, so only each hash's least document of a batch is compared with those of other batches.

One value thus brings at most one row per batch to the task that compares it, however many documents hold it and
however often: a row has a value's first place in a document, and a list of the others.

No pairs of documents are made: rows grow with shared words, not with the square of a group. Removal rests on 128 bits
of a window, two hashes by different bases; an anchor, which only proposes, has 64. A task that compares holds the rows
of one value at a time.

Null texts have no words; rows that repeat doc_id and text are one document; rows of one doc_id with different texts
(told apart by CRC-32) have their own places and, having no smaller doc_id, never remove from one another; texts shorter
than a window are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, materialize, partitions
from .wordstream import U, Words, blocks, covered, mix, rows_of

#: Perfect difference sets (Singer); period -> cover.
COVERS = {13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words of an anchor) for windows of that many words."""
    fit = [v for v in COVERS if v <= 2 * window // 3]
    if not fit:
        return 1, (0,), window
    v = max(fit)
    return v, COVERS[v], window - v + 1


def anchors(texts: list[bytes], window: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words; index of each anchor's first word, its place in its text, its hash."""
    v, cover, a = cover_for(window)
    w = Words(texts)
    n = len(w.hashes)
    place = np.arange(n) - w.first[w.doc]
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    ok = inside[place % v]
    ok[max(0, n - a + 1) :] = False
    at = np.flatnonzero(ok)
    at = at[w.doc[at] == w.doc[at + a - 1]] if len(at) else at
    at = at[(np.diff(w.first)[w.doc[at]] >= window)]
    return w, at, place[at], w.hash_at(at, a)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_KINDS = "key long, second long, doc_id long, at long, more array<long>, known boolean"


def _packed(h: np.ndarray, second: np.ndarray, doc: np.ndarray, at: np.ndarray, known_if: str) -> Iterator:
    """Rows of ``_KINDS`` of a batch, of which at most one a value must be compared. ``at`` is the text's CRC-32 and
    the place.

    ``known_if`` says what the batch decides by itself: ``shared``, a value of several documents; ``later``, a row whose
    document isn't the least of its value here. Known rows have a scattered key; of a shared value one row keeps the
    hash as its key, so that other batches learn of it.
    """
    import pyarrow as pa

    order = np.lexsort((at, doc, second, h))
    h, second, doc, at = h[order], second[order], doc[order], at[order]
    new, first, group = _groups(h, second)
    last = np.append(first[1:], len(h)) - 1
    known = (doc[first] != doc[last])[group] if known_if == "shared" else doc != doc[first][group]
    head = new.copy()  # the first place of a value in a text
    head[1:] |= (doc[1:] != doc[:-1]) | (at[1:] >> 32 != at[:-1] >> 32)
    heads = np.flatnonzero(head)
    away = known & ~new
    key = np.where(away, mix(h + (np.arange(len(h), dtype=U) + U(1)) * U(0x9E3779B97F4A7C15)), h)
    ends = np.append(heads[1:], len(h))
    for s in range(0, len(heads), 1 << 17):
        mine, stop = heads[s : s + (1 << 17)], ends[s : s + (1 << 17)]
        rest = ~head[mine[0] : stop[-1]]
        extra = stop - mine - 1
        lists = pa.ListArray.from_arrays(pa.array([None if not n else a for a, n in zip((np.cumsum(extra) - extra).tolist(), extra.tolist(), strict=True)] + [int(extra.sum())], pa.int32()), pa.array(at[mine[0] : stop[-1]][rest]))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(key[mine])), pa.array(_signed(second[mine])), pa.array(doc[mine]), pa.array(at[mine]), lists, pa.array(known[mine])], names=["key", "second", "doc_id", "at", "more", "known"])


def _groups(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted values: where a new one starts, as flags and as places, and each row's group."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
    return new, np.flatnonzero(new), np.cumsum(new) - 1


def _emit_anchors(window: int):
    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            docs, spots, hashes = [], [], []
            for rows in blocks(rows_of(batch, "doc_id", "crc")):
                ids, crcs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                w, at, place, h = anchors([r[-1] for r in rows], window)
                docs.append(ids[w.doc[at]])
                spots.append((crcs << 32)[w.doc[at]] + place)
                hashes.append(h)
            if docs:
                h = np.concatenate(hashes)
                yield from _packed(h, np.zeros(len(h), U), np.concatenate(docs), np.concatenate(spots), "shared")

    return run


def _compared(keep: str, rows: int = 1 << 17):
    def run(batches: Iterator) -> Iterator:
        """Of a partition sorted by (key, second, doc_id) that holds all rows to compare of its keys: (doc, at) of the
        rows that are known or turn out ``shared`` or ``later``."""
        import pyarrow as pa

        def decide(part: list) -> Iterator:
            key, second, doc, at, known, more, extra = part
            new, first, group = _groups(key, second)
            if keep == "shared":
                last = np.append(first[1:], len(key)) - 1
                right = ((doc[first] != doc[last]) | (np.add.reduceat(known.astype(np.int64), first) > 0))[group]
            else:
                right = known | (doc != doc[first][group])
            docs, spots = np.concatenate((doc[right], np.repeat(doc, extra)[np.repeat(right, extra)])), np.concatenate((at[right], more[np.repeat(right, extra)]))
            for s in range(0, len(docs), rows):
                yield pa.RecordBatch.from_arrays([pa.array(docs[s : s + rows]), pa.array(spots[s : s + rows])], names=["doc_id", "at"])

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("more")
            extra = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append([*(batch.column(c).to_numpy() for c in ("key", "second", "doc_id", "at")), batch.column("known").to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), extra])
            if sum(len(p[0]) for p in held) < rows:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
            if cut:
                n = int(whole[6][:cut].sum())
                yield from decide([*(x[:cut] for x in whole[:5]), whole[5][:n], whole[6][:cut]])
                held = [[*(x[cut:] for x in whole[:5]), whole[5][n:], whole[6][cut:]]]
            else:
                held = [whole]
        if held:
            yield from decide([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _emit_windows(window: int):
    a = cover_for(window)[2]

    def run(batches: Iterator) -> Iterator:
        """Windows that hold a shared anchor."""
        for batch in batches:
            hs, others, ds, ps = [], [], [], []
            for rows in blocks(rows_of(batch, "doc_id", "crc", "places")):
                w = Words([t for *_, t in rows])
                n = len(w.hashes)
                edge = np.zeros(n + 1, np.int64)
                for j, (_, _, places, _) in enumerate(rows):
                    p = np.array(places, np.int64) + w.first[j]
                    np.add.at(edge, np.maximum(p + a - window, w.first[j]), 1)
                    np.add.at(edge, p + 1, -1)
                at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                at = at[at + window <= n]
                at = at[w.doc[at] == w.doc[at + window - 1]]
                ids, crcs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
                hs.append(w.hash_at(at, window))
                others.append(w.second_at(at, window))
                ds.append(ids[w.doc[at]])
                ps.append((crcs << 32)[w.doc[at]] + at - w.first[w.doc[at]])
            if hs:
                yield from _packed(np.concatenate(hs), np.concatenate(others), np.concatenate(ds), np.concatenate(ps), "later")

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.crc32(text).alias("crc"), text.alias("text"))


def _few_texts(rows: DataFrame, places: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with their places, and the rows that have none, if the ids of those that have are few enough to
    broadcast, as counted: the other texts then are never shuffled. Else all rows, and None."""
    keys = ["doc_id", "crc"]
    if not fits(places, broadcast_rows):
        return rows.join(places, keys, "left"), None
    ids = F.broadcast(places.select(*keys))
    return rows.join(ids, keys, "left_semi").join(places, keys), rows.join(ids, keys, "left_anti").withColumn("places", F.lit(None).cast("array<int>"))


def _places(found: DataFrame) -> DataFrame:
    place = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return found.groupBy("doc_id", F.shiftrightunsigned("at", 32).alias("crc")).agg(F.collect_set(place).alias("places"))


def repeated_windows(docs: DataFrame, window: int = 50, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, crc of the text, places) of the windows that also start in a document with a smaller doc_id."""
    rows = _texts(docs).filter("doc_id is not null and text is not null")
    n = partitions(docs.sparkSession)

    def compare(found: DataFrame, keep: str) -> DataFrame:
        return found.repartition(n, "key").sortWithinPartitions("key", "second", "doc_id").mapInArrow(_compared(keep), "doc_id long, at long")

    shared = materialize(_places(compare(rows.mapInArrow(_emit_anchors(window), _KINDS), "shared")), "substring-anchors")
    held, _ = _few_texts(rows, shared, broadcast_rows)
    windows = held.filter("places is not null").select("doc_id", "crc", "places", "text").mapInArrow(_emit_windows(window), _KINDS)
    return materialize(_places(compare(windows, "later")), "substring-windows")


def _finish(window: int, with_text: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for rows in blocks(rows_of(batch, "doc_id", "places")):
                out = []
                for doc, places, text in rows:
                    words = text.split()
                    gone = covered(np.unique(np.array(places, np.int64)), window, len(words)) if places else np.zeros(len(words), bool)
                    kept = b" ".join(x for x, g in zip(words, gone.tolist(), strict=True) if not g) if places else b" ".join(words)
                    out.append((doc, len(words), int(gone.sum()), kept.decode() if with_text else hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = 50, with_text: bool = True, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the kept words joined by a space; else their SHA-256).

    A row with a null doc_id is never a source or a target of removal.
    """
    held, rest = _few_texts(_texts(docs), repeated_windows(docs, window, broadcast_rows), broadcast_rows)
    full = held if rest is None else held.unionByName(rest)
    return full.select("doc_id", "places", "text").mapInArrow(_finish(window, with_text), "doc_id long, n_words long, n_removed long, kept string")
