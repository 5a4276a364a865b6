"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: 64-bit words of majority bits over a text's word shingles. Equal fingerprints collapse first,
so copies cost one row. Distinct fingerprints meet in buckets:

* ``exact_keys``: the 64 bits are cut in ``radius + 2`` blocks; two fingerprints within ``radius`` bits agree
  in at least two of them, so the pairs of blocks as keys find every link (an exact join);
* ``band_keys``: bands of a wide fingerprint, for thresholds on similarity that no exact blocking reaches.

Inside buckets, rows are stored as vertical bit planes: plane k holds bit k of all rows, eight rows a byte. The
planes of row i and of row i + s differ by one XOR for all i at once; a carry-save counter of a few planes
adds the differences up, and blocks of rows all over the radius are abandoned between plane groups. Large buckets
compare a block of rows with all others the same way. Each bucket gives a forest (at most one edge a row); where
links are yet to be proven, each row's nearest and first hit, in rounds. Buckets over ``tile`` rows are dealt out as
pairs of tiles over many tasks; a task holds one bucket at a time. Links become components in ``graph``.

Null text has no words: fingerprint zero, linked like any other. Repeated rows are rows of one fingerprint;
null doc_ids take part and are never a component's id unless it holds nothing else; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, small_side
from .graph import components
from .wordstream import LOWER, U, giving_back, mix, rows_of

_BYTE = 8


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, U)
    flat = memoryview(b" ".join(words))
    if len(words) <= k:
        return np.array([xxh64_intdigest(flat, 42)], U)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return np.array([xxh64_intdigest(flat[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], U)


#: Byte -> its bits as eight byte-wide lanes of one word, so that adding words counts eight bits at once.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U).ravel()


def majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words; a bit is set if it is in over half the hashes. Word 0 takes the hashes as they
    are, others scramble them first."""
    n = len(hashes)
    if not n:
        return np.zeros(words, U)
    salts = np.array([j * 0x9E3779B97F4A7C15 % 2**64 for j in range(1, words)], U)
    counts = np.zeros((words, 64), np.int64)
    for s in range(0, n, 255):  # a lane holds 255
        h = hashes[None, s : s + 255]
        h = np.concatenate((h, mix(h + salts[:, None]))) if words > 1 else np.ascontiguousarray(h)
        counts += _LANES[h.view(np.uint8).reshape(words, -1, 8)].sum(1).view(np.uint8).reshape(words, 64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(U).ravel()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, f: array of one long)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for doc, text in rows_of(batch, "doc_id"):
                ids.append(doc)
                out.append(majority(shingle_hashes(text, shingle)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(np.array(out, U).reshape(len(ids), 1))], names=["doc_id", "f"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "doc_id long, f array<long>")


def _lists(f: np.ndarray):
    import pyarrow as pa

    n, w = f.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w, pa.int32()), pa.array(np.ascontiguousarray(f).view(np.int64).ravel()))


def wide_prints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, own: XXH64 of the text, digest of the set of shingles, f: ``words`` longs) of ``docs`` (doc_id, own, text).
    Each different shingle counts once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, owns, digests, out = [], [], [], []
            for doc, own, text in rows_of(batch, "doc_id", "own"):
                h = np.unique(shingle_hashes(text, shingle))
                ids.append(doc)
                owns.append(own)
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                out.append(majority(h, words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(owns, pa.int64()), pa.array(digests, pa.binary()), _lists(np.array(out, U).reshape(len(ids), words))], names=["doc_id", "own", "digest", "f"])

    return docs.mapInArrow(giving_back(run), "doc_id long, own long, digest binary, f array<long>")


def exact_keys(f: np.ndarray, radius: int) -> list[np.ndarray]:
    """Bucket keys such that any two fingerprints within ``radius`` bits share one."""
    cuts = np.linspace(0, 64, radius + 3).astype(int)
    masks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [mix((f & U(x | y)) + U(t * 0x632BE59BD9B4E019 % 2**64)) for t, (x, y) in enumerate(combinations(masks, 2))]


def band_keys(f: np.ndarray, bits: int) -> list[np.ndarray]:
    """Keys of the ``bits``-bit bands of wide fingerprints (rows x words)."""
    per, mask = 64 // bits, (1 << bits) - 1
    return [((f[:, t // per] >> U(t % per * bits)) & U(mask)) | U(t << 40) for t in range(f.shape[1] * per)]


class Planes:
    """Rows as vertical bit planes."""

    def __init__(self, f: np.ndarray):
        self.n = len(f)
        bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little")
        self.planes = np.zeros((bits.shape[1], (self.n + 7) // _BYTE + 1), np.uint8)
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        self.planes[:, : packed.shape[1]] = packed

    def within(self, shift: int, radius: int, among: np.ndarray) -> np.ndarray:
        """Rows i of ``among`` (a mask over rows) of which row i + shift is within ``radius`` bits."""
        wide = self.planes.shape[1]
        q, r = divmod(shift, _BYTE)
        live = np.zeros(wide, np.uint8)
        live[: (self.n + 7) // _BYTE] = np.packbits(among, bitorder="little")
        cols = np.flatnonzero(live)
        counter = [np.zeros(len(cols), np.uint8) for _ in range(radius.bit_length())]
        dead = ~live[cols]
        for k in range(len(self.planes)):
            if k and k % 8 == 0:
                over = dead | _above(counter, radius)
                alive = over != 0xFF
                if not alive.all():
                    if not alive.any():
                        return np.zeros(0, np.int64)
                    if alive.sum() < 0.7 * len(alive):
                        cols, dead, counter = cols[alive], dead[alive], [c[alive] for c in counter]
            p = self.planes[k]
            at = np.minimum(cols + q, wide - 1)
            other = p[at] if not r else (p[at] >> r) | (p[np.minimum(at + 1, wide - 1)] << (8 - r))
            carry = p[cols] ^ other
            for c in counter:
                c ^= carry
                carry &= ~c
            dead |= carry
        good = ~(dead | _above(counter, radius))
        where = (cols[:, None] * _BYTE + np.arange(_BYTE))[np.unpackbits(good, bitorder="little").reshape(-1, _BYTE).astype(bool)]
        return where[where + shift < self.n]


def _above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bitwise: where the counter is over the radius."""
    over, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            over = over | (same & counter[k])
            same = same & ~counter[k]
    return over


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (index of the least row reachable) after adding links a-b."""
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), low)
        while (label[label] != label).any():
            label = label[label]


def link_rows(bucket: np.ndarray, f: np.ndarray, radius: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by bucket -> (row, root) forest of the rows within ``radius`` of each other in a bucket.

    ``part``: 0 or 1 for each row; where given, only rows of different parts are compared (pairs of tiles).
    """
    n = len(bucket)
    label = np.arange(n)
    for s, among, planes in _shifts(bucket, f, part):
        hit = planes.within(s, radius, among)
        if len(hit):
            label = _roots(n, hit, hit + s, label)
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A full adder: the sum and the carry of three planes."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within_all(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """(queries, rows) true where within ``radius`` bits. ``planes``: (bits, words) vertical planes of the rows, 64 a
    word; ``queries``: (bits, queries), 0 or all ones. Eight planes a time go through a tree of full adders; words of
    which all rows are over the radius for all queries are abandoned."""
    bits, wide = planes.shape
    q = queries.shape[1]
    cols = np.arange(wide)
    counter = [np.zeros((q, wide), U) for _ in range(max(3, radius.bit_length()))]
    dead = np.zeros((q, wide), U)
    for k in range(0, bits, 8):
        d = [planes[k + i].take(cols)[None, :] ^ queries[k + i][:, None] for i in range(8)]
        ones, twos, fours, *upper = counter
        ones, t1 = _full(ones, d[0], d[1])
        ones, t2 = _full(ones, d[2], d[3])
        twos, f1 = _full(twos, t1, t2)
        ones, t1 = _full(ones, d[4], d[5])
        ones, t2 = _full(ones, d[6], d[7])
        twos, f2 = _full(twos, t1, t2)
        fours, carry = _full(fours, f1, f2)
        for i, c in enumerate(upper):
            upper[i], carry = c ^ carry, c & carry
        dead |= carry
        counter = [ones, twos, fours, *upper]
        if k % 64 == 56 or k + 8 >= bits:
            dead |= _above(counter, radius)
            alive = (dead != ~U(0)).any(0)
            if not alive.any():
                return np.zeros((q, wide * 64), bool)
            if alive.sum() < 0.8 * len(cols):
                cols, dead, counter = cols[alive], dead[:, alive], [c[:, alive] for c in counter]
    out = np.zeros((q, wide), U)
    out[:, cols] = ~dead
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little").view(bool)


def nearest(bucket: np.ndarray, f: np.ndarray, radius: int, part: np.ndarray, known: np.ndarray, block: int = 128) -> Iterator[tuple[np.ndarray, ...]]:
    """``hit_rows`` of one large bucket or a few: all rows against all, ``block`` of them at a time."""
    n = len(f)
    bits = np.zeros((f.shape[1] * 64, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(n, -1), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(U)
    for s in range(0, n, block):
        rows = np.arange(s, min(s + block, n))
        hit = within_all(planes, (-bits[:, rows].astype(np.int64)).view(U), radius)[:, :n]
        hit &= (bucket[rows][:, None] == bucket[None, :]) & (known[rows][:, None] != known[None, :]) & ((part[None, :] > 1) | (part[rows][:, None] != part[None, :]))
        times = hit.sum(1)
        some = np.flatnonzero(times)
        if not len(some):
            continue
        hit, rows, times = hit[some], rows[some], times[some]
        i, j = np.nonzero(hit)
        far = np.full(hit.shape, 0xFFFF, np.uint16)
        far[i, j] = np.bitwise_count(f[rows[i]] ^ f[j]).sum(1)
        close = far.argmin(1)
        picks = [close, hit.argmax(1), n - 1 - hit[:, ::-1].argmax(1)]
        use = [np.ones(len(rows), bool), picks[1] != close, (times == 2) & (picks[2] != close) & (picks[2] != picks[1])]
        for other, ok in zip(picks, use, strict=True):
            yield rows[ok], other[ok], far[np.arange(len(rows)), other][ok].astype(np.int64), times[ok] > 2


def hit_rows(bucket: np.ndarray, f: np.ndarray, radius: int, part: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, other row, bits apart, whether the row has more) of rows within ``radius`` of each other in a bucket that
    are not ``known`` to be of one group: of a row's hits the nearest and the first, or both if it has two."""
    n = len(bucket)
    rows, others = [], []
    for s, among, planes in _shifts(bucket, f, part):
        among[:-s] &= known[:-s] != known[s:]
        hit = planes.within(s, radius, among) if among.any() else ()
        if len(hit):
            rows += [hit, hit + s]
            others += [hit + s, hit]
    if not rows:
        return
    row, other = np.concatenate(rows), np.concatenate(others)
    far = np.bitwise_count(f[row] ^ f[other]).sum(1).astype(np.int64)
    times = np.bincount(row, minlength=n)[row]
    order = np.lexsort((other, row))
    row, other, far, times = row[order], other[order], far[order], times[order]
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    close = np.lexsort((other, far, row))
    closest = np.zeros(len(row), bool)
    closest[close[first]] = True  # both orders are by row first
    ok = first | closest | (times == 2)
    yield row[ok], other[ok], far[ok], times[ok] > 2


def _shifts(bucket: np.ndarray, f: np.ndarray, part: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, Planes]]:
    """(s, mask of the rows i that are to be compared with row i + s, planes)."""
    n = len(bucket)
    if n < 2:
        return
    new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), n))
    left = np.repeat(np.append(np.flatnonzero(new)[1:], n), size) - np.arange(n) - 1  # rows after this one in its bucket
    planes = Planes(f)
    for s in range(1, int(size.max())):
        among = left >= s
        if part is not None:
            among[:-s] &= (part[:-s] != part[s:]) | (part[:-s] > 1)
        if among.any():
            yield s, among, planes


def _link_partition(radius: int, proven: bool, rows: int = 1 << 16, large: int = 32):
    def run(batches: Iterator) -> Iterator:
        """Compares the rows of each bucket of a partition that is sorted by (bucket, node); whole buckets are taken
        as they come, so what is held is a bucket, not the partition. ``proven``: the links are all there is to say;
        else gives ``hit_rows``."""
        import pyarrow as pa

        names = ["bucket", "node", "part"] + ["known"] * (not proven)

        def compare(bucket: np.ndarray, node: np.ndarray, part: np.ndarray, f: np.ndarray, known: np.ndarray | None = None) -> Iterator:
            ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
            sizes = np.diff(ends, prepend=0)
            big = np.flatnonzero(sizes >= large)
            groups, k = [np.flatnonzero(np.repeat(sizes < large, sizes))], 0  # small buckets together
            while k < len(big):  # large ones by themselves, or a few, to some 128 rows
                stop = max(k + 1, int(np.searchsorted(np.cumsum(sizes[big[k:]]), 128)) + k)
                groups.append(np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in big[k:stop]]))
                k = stop
            for alone, at in enumerate(groups):
                own = node[at]
                if proven:
                    u, v = link_rows(bucket[at], f[at], radius, part[at])
                    yield pa.RecordBatch.from_arrays([pa.array(own[u]), pa.array(own[v])], names=["u", "v"])
                    continue
                for u, v, d, more in (nearest if alone else hit_rows)(bucket[at], f[at], radius, part[at], known[at]):
                    yield pa.RecordBatch.from_arrays([pa.array(own[u]), pa.array(own[v]), pa.array(d), pa.array(more)], names=["u", "v", "d", "more"])

        held: list = []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(c).to_numpy() for c in names]
            got = [*cols[:3], batch.column("f").flatten().to_numpy().reshape(n, -1).view(U), *cols[3:]]
            held.append(got)
            if sum(len(h[0]) for h in held) < rows:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last bucket may go on
            if cut:
                yield from compare(*(x[:cut] for x in whole))
            held = [[x[cut:] for x in whole]]
        if held:
            yield from compare(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _keyed(keys, carry: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            f = batch.column("f").flatten().to_numpy().reshape(n, -1).view(U)
            kept = np.ascontiguousarray(f[:, :carry]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * kept.shape[1], pa.int32()), pa.array(kept.ravel()))
            for k in keys(f):
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), batch.column("node"), lists], names=["bucket", "node", "f"])

    return run


def link(nodes: DataFrame, keys, radius: int, carry: int = 1, tile: int = 4096) -> DataFrame:
    """Edges (u, v) between nodes (node, f) that share a bucket and lie within ``radius`` bits of the first
    ``carry`` words."""
    return _by_bucket(_dealt(nodes, keys, carry, tile)).mapInArrow(_link_partition(radius, True), "u long, v long")


def _by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "node")


def _dealt(nodes: DataFrame, keys, carry: int, tile: int) -> DataFrame:
    """(bucket, node, part, f). A bucket of more than ``tile`` nodes is split in tiles of about that many, by a hash of
    the node; each pair of tiles is a group of its own."""
    keyed = nodes.mapInArrow(_keyed(keys, carry), "bucket long, node long, f array<long>")
    large = materialize(keyed.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > tile), "large-buckets")
    whole = lambda df: df.select("bucket", "node", F.lit(2).cast("byte").alias("part"), "f")
    if large.isEmpty():
        grouped = whole(keyed)
    else:
        tiles = large.select("bucket", F.ceil(F.col("rows") / tile).cast("int").alias("tiles"))
        mine = keyed.join(tiles, "bucket", "left")
        own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        dealt = mine.filter("tiles is not null").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.select(pair.alias("bucket"), "node", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte").alias("part"), "f")
        grouped = whole(mine.filter("tiles is null")).union(dealt)
    return grouped


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at ``radius`` or fewer differing bits, exactly."""
    prints = materialize(fingerprints(docs, shingle).select("doc_id", F.col("f")[0].alias("print")), "simhash-prints")
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "simhash-distinct")
    # nodes are fingerprints themselves, so that null ids do no harm
    edges = link(nodes.select(F.col("print").alias("node"), F.array("print").alias("f")), lambda f: exact_keys(f[:, 0], radius), radius, 1, tile)
    edges = materialize(edges.distinct(), "simhash-links")
    found = components(edges)
    linked = nodes.join(found, F.col("print") == F.col("node"))
    ids = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = linked.join(ids, "component").select(F.col("print").alias("__print"), "least")
    classes = materialize(nodes.join(named, F.col("print") == F.col("__print"), "left").select("print", F.coalesce("least", "first").alias("component_id"), "rows"), "simhash-classes")
    return join_hot(prints, classes, "print", "rows").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_sets(shingle: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, out = [], []
            for doc, text in rows_of(batch, "node"):
                ids.append(doc)
                out.append(np.unique(shingle_hashes(text, shingle)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["node", "set"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, U), np.frombuffer(b, U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    return run


def _tokens(shingle: int):
    def run(batches: Iterator) -> Iterator:
        """(node, known, n, s): each different shingle of a text."""
        import pyarrow as pa

        for batch in batches:
            for node, known, text in rows_of(batch, "node", "known"):
                s = np.unique(shingle_hashes(text, shingle))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(np.full(len(s), known)), pa.array(np.full(len(s), len(s), np.int32)), pa.array(s.view(np.int64))], names=["node", "known", "n", "s"])

    return run


#: Words of 64 parities that a text carries to the join of rare shingles.
_PARITY = 16
_CARRIED = ("node", "known", "n", "p", "bits")


def exact_pairs(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) that hold all pairs of ``texts`` (node, known, text) at ``similarity`` or more of different ``known``
    groups: a join by the rarest shingles. Two such sets share one of the first shingles in order of rarity, of the
    larger set one of its first n - ceil(t n) + 1, of the smaller one of its first n - ceil(2t n / (1 + t)) + 1, and at
    places that leave enough shingles for the overlap. What many texts share, a template, stands last in that order, and
    a shingle of a single group joins nothing.

    Texts that share rare shingles and are not alike never leave the join: each carries ``64 * _PARITY`` parities of its
    shingles by hash, and two sets differ in at least as many shingles as their parities do in bits. That bound
    weakens as sets outgrow the parities; pairs that it then lets through are verified like all others."""
    t = similarity
    up = lambda c: F.ceil(c - F.lit(1e-9))
    rows = materialize(texts.select("node", "known", "text").mapInArrow(giving_back(_tokens(shingle)), "node long, known long, n int, s long"), "wide-shingles")
    seen = rows.groupBy("s").agg(F.count("*").alias("df"), F.min("known").alias("low"), F.max("known").alias("high"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "s")) - 1
    first = rows.join(seen, "s").withColumn("p", place).filter(F.col("p") <= F.col("n") - up(F.col("n") * t)).filter("low <> high")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftrightunsigned(s, 8), 64) as int))")
    words = F.array(*(F.bit_xor(F.when(F.pmod("s", F.lit(_PARITY)) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range(_PARITY)))
    first = materialize(first.join(rows.groupBy("node").agg(words.alias("bits")), "node").select("s", *_CARRIED), "wide-first")
    a = first.select("s", *(F.col(c).alias(f"{c}_a") for c in _CARRIED))
    b = first.filter(F.col("p") <= F.col("n") - up(F.col("n") * (2 * t / (1 + t)))).select("s", *(F.col(c).alias(f"{c}_b") for c in _CARRIED))
    order = (F.col("n_b") < F.col("n_a")) | ((F.col("n_b") == F.col("n_a")) & (F.col("node_b") < F.col("node_a")))
    overlap = up((F.col("n_a") + F.col("n_b")) * (t / (1 + t)))
    room = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= overlap
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda d, x: d + x)
    alike = F.col("n_a") + F.col("n_b") - differ >= 2 * overlap
    met = a.join(b, "s").filter(order & (F.col("known_a") != F.col("known_b")) & (F.col("n_b") >= up(F.col("n_a") * t)) & room & alike)
    return met.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).distinct()


def _proven(pairs: DataFrame, texts, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose whole shingle sets are alike enough. ``texts(nodes)``: (node, text) of nodes."""
    ends = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "wide-ends")
    sets = materialize(texts(ends).select("node", "text").mapInArrow(giving_back(_shingle_sets(shingle)), "node long, set binary"), "wide-sets")
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return materialize(both.select("u", "v", "a", "b").mapInArrow(giving_back(_verify(similarity)), "u long, v long"), "wide-proven")


def proven_links(texts, nodes: DataFrame, keys, radius: int, carry: int, tile: int, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) that are proven on whole shingle sets and connect all that the hits within ``radius`` can connect.

    In a round each row of a bucket names the nearest and the first of its hits that isn't of its own group; of what it
    names in all buckets the nearest and the first are verified, and proven links make groups. Rows with more hits than
    that are crowded: they come again, and their hits outside their groups only. A hit that is never named has two
    crowded ends, so once a round leaves over half of them crowded, as texts of one template do, the crowded rows are
    joined by ``exact_pairs``, which finds all of their links, and no hit stays untested.
    """
    now, links, before = _dealt(nodes, keys, carry, tile).withColumn("known", F.col("node")), None, None
    while True:
        hits = _by_bucket(now).mapInArrow(_link_partition(radius, False), "u long, v long, d long, more boolean")
        named = hits.groupBy("u").agg(F.collect_set("v").alias("vs"), F.min(F.struct("d", "v")).alias("near"), F.min("v").alias("first"), F.max("more").alias("more"))
        named = materialize(named.select("u", F.when(F.size("vs") > 2, F.array_distinct(F.array("near.v", "first"))).otherwise(F.col("vs")).alias("vs"), (F.col("more") | (F.size("vs") > 2)).alias("crowded")), "wide-candidates")
        pairs = named.select("u", F.explode("vs").alias("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        proven = _proven(materialize(pairs, "wide-pairs"), texts, shingle, similarity)
        links = proven if links is None else links.union(proven)
        crowded = named.filter("crowded").select(F.col("u").alias("node"))
        count = crowded.count()
        if not count:
            return links
        groups = materialize(components(links), "wide-groups")
        left = materialize(crowded.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("known")), "wide-crowded")
        if before is not None and 2 * count > before:
            pairs = exact_pairs(texts(left), shingle, similarity)
            return links.union(_proven(materialize(pairs, "wide-pairs"), texts, shingle, similarity))
        before = count
        now = _dealt(nodes.join(left.select("node"), "node", "left_semi"), keys, carry, tile).join(left, "node")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 16, band: int = 16, carry: int = 4, tile: int = 4096, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the least doc_id.

    Two texts are near duplicates if the Jaccard similarity of their shingle sets is ``similarity`` or more.
    Candidates share a band of a wide SimHash (64 * ``words`` bits, bands of ``band`` bits) and differ in few
    of its first 64 * ``carry`` bits; each candidate is then verified on whole shingle sets. Two texts at
    similarity J differ in a bit with probability p = acos(2J / (1 + J)) / pi, so a pair at 0.8 shares one of
    64 bands of 16 bits with probability 0.99, at 0.9 with 0.99999. Texts of one shingle set are one node, and texts
    without a word are one group.

    All columns stay. Rows with a null doc_id stay. A row is known by its doc_id and its text: rows that repeat both
    stay or go together; of rows of one doc_id with different texts each is judged by its own (ties by XXH64 of the
    text). An empty table gives an empty result; null text has no words.
    """
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * carry
    radius = int(np.ceil(bits * p + 3.2 * np.sqrt(bits * p * (1 - p))))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    prints = materialize(wide_prints(rows, shingle, words), "wide-prints")
    heads = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "own")).alias("head"), F.first("f").alias("f"), F.count("*").alias("rows"))
    nodes = materialize(heads.select(F.monotonically_increasing_id().alias("node"), "digest", "head", "f", "rows"), "wide-distinct")

    def texts(wanted: DataFrame) -> DataFrame:
        """``wanted`` (node, ...) with the text of each node's head."""
        ends = nodes.select("node", F.col("head.doc_id").alias("doc_id"), F.col("head.own").alias("own")).join(wanted, "node")
        return rows.join(small_side(ends, broadcast_rows), ["doc_id", "own"]).dropDuplicates(["node"])

    proven = proven_links(texts, nodes.select("node", "f"), lambda f: band_keys(f, band), radius, carry, tile, shingle, similarity)
    groups = materialize(components(proven), "wide-groups")
    best = nodes.join(groups, "node").select("node", "component", "head")
    least = best.groupBy("component").agg(F.min(F.struct("head", "node")).alias("least"))
    lost = materialize(best.join(least, "component").filter(F.col("node") != F.col("least.node")).select("node"), "wide-lost")
    # rows that go: all of a lost node, and of a node that stays all but its head
    fate = nodes.join(lost.withColumn("lost", F.lit(True)), "node", "left").filter("lost or rows > 1").select("digest", "head", F.coalesce("lost", F.lit(False)).alias("lost"), "rows")
    gone = join_hot(prints.select("doc_id", "own", "digest"), materialize(fate, "wide-fate"), "digest", "rows")
    gone = gone.filter(F.col("lost") | (F.struct("doc_id", "own") != F.col("head"))).select(F.col("doc_id").alias("__doc"), F.col("own").alias("__own")).distinct()
    same = (docs["doc_id"].cast("long") == F.col("__doc")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__own"))
    return docs.join(small_side(materialize(gone, "wide-gone"), broadcast_rows), same, "left_anti")
