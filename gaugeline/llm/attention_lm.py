"""LM scoring with a small causal self-attention model, trained and applied in numpy on subword ids.

The text. A-Z are lowered; a text is its words (separated by white space), each spelled as the subwords it has after
a space, then an end. So a subword either starts a word (it begins with the space) or goes on inside one.

The model. Subword id -> hashed embedding of ``dim`` numbers; one layer of causal self-attention over a window
of ``2 * hop`` inputs with a learned weight for each distance; a linear map to ``classes`` token classes, some of
subwords that start words and some of others, a softmax in each of the two; and a token's share of its class, from
the counts of *all* training text. Frequent word starts are classes of their own; others are grouped by the
frequent word starts they stand near (k-means over co-occurrence in all training text).

The spelling. Whether a word ends, and how it goes on, depends most on its first subwords: ``Lexicon`` is the tree of
all training words' subwords with their counts, no node left out. At each node a word ends with its counted probability;
a further subword has its counted probability, backed off (Witten-Bell) to what follows the subword before it anywhere in
the tree, and that to the attention model's. What starts the next word is the attention model's alone. All of it is one
probability of the text. ``Spelling`` is the same tree in parts: words that share their first two subwords meet in a task,
which has all nodes from there on, so neither a task nor the driver holds the tree, and no node is ever a row. Words of
held-out texts alone come along, with a count of 0.

Training. Every subword and every end of every training text is a target, in the window that scoring sees it in.
Texts are cut in stretches of some hops, each with the hop before it, and these are dealt to trainers that stream them
in small batches (Adam) from common parameters. Training is one pass over all of the text in ``rounds`` parts, after
each of which the results are averaged, weighted by stretches.

Scoring. Texts are cut in hops; a window is a hop and the hop before it, so windows overlap by half and each
token is scored once, with between ``hop`` and ``2 * hop`` inputs in sight (fewer at a text's start, where the
mask hides them). Blocks of windows of many texts are one batched masked product.

Base score. Word counts of the training texts are partial sums. The most frequent words (at most ``top``,
counted first) are broadcast with their spelling; every other word is looked up by a join, so each token's count is
exact. What the model gives that word's subwords goes along and meets the counted part of their probability there.

Null text is empty: one end token. No training text: counts are zero, the model keeps its first parameters.
Repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import binascii
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordstream import LOWER, SPACED, U, giving_back, mix, rows_of

MOST_BYTES = 64 << 20

#: Cuts words in pieces before merging. It looks nowhere ahead, so the pattern runs as a plain automaton, and no piece
#: goes on past a space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+| ?[^\S ]+| """


class Subwords:
    """Ids of a vocabulary of ranks; one more id, the last, begins and ends a text."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        merges = {binascii.a2b_base64(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.end = max(merges.values()) + 1
        self.size = self.end + 1
        #: How ids are written.
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<i4")
        #: Which ids start a word; the end does too.
        self.starts = np.zeros(self.size, bool)
        self.starts[[i for token, i in merges.items() if token[:1] == b" "] + [self.end]] = True

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each as after a space, and where each word's begin (one more entry at the end)."""
        got = self._spell_all(" " + " ".join(words), len(words))
        if got is not None:
            return got
        each = [self.encoding.encode_ordinary(" " + w) for w in words]  # the pattern has a piece go on past a space
        return np.array([i for e in each for i in e], np.int64), np.cumsum([0, *map(len, each)])

    def spell_names(self, names) -> tuple[np.ndarray, np.ndarray]:
        """The same of an Arrow array of words as bytes; no word has a space."""
        off = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
        text = np.full(off[-1] - off[0] + len(names), 0x20, np.uint8)  # a space before each
        if len(names):
            text[np.arange(off[-1] - off[0]) + np.repeat(np.arange(1, len(names) + 1), np.diff(off))] = np.frombuffer(names.buffers()[2], np.uint8)[off[0] : off[-1]]
        text = text.tobytes().decode("utf-8", "replace")
        got = self._spell_all(text, len(names))
        return self.spell(text[1:].split(" ")) if got is None else got

    def _spell_all(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray] | None:
        """``n`` words, each after a space; None if some piece goes on past one."""
        ids = self.encoding.encode_to_numpy(text).astype(np.int64) if n else np.zeros(0, np.int64)
        first = np.flatnonzero(self.starts.take(ids))
        return (ids, np.append(first, len(ids))) if len(first) == n else None


@lru_cache(maxsize=1)
def subwords(ranks: bytes, pattern: str) -> Subwords:
    """One for all tasks of a worker."""
    return Subwords(ranks, pattern)


_NODE = {"key": np.int64, "parent": np.int64, "id": np.int64, "before": np.int64, "depth": np.int64, "through": np.int64, "stops": np.int64}


def tree_nodes(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of the tree of spelled words (``ids`` of the words one after another, each from ``first``, met ``n`` times):
    key (64-bit hash of the subwords so far; the root's is 0), parent's key, last subword and the one before (-1: none),
    depth, how many words go through and how many stop there."""
    size, depth = np.diff(first), 0
    live, at = np.flatnonzero(size > 0), np.zeros(len(size), np.int64)
    before, out = np.full(len(size), -1), {c: [np.zeros(0, t)] for c, t in _NODE.items()}
    while len(live):
        own = ids[first[live] + depth]
        key = mix((at[live].view(U) + own.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)).view(np.int64)
        uniq, some, inv = np.unique(key, return_index=True, return_inverse=True)
        last = size[live] == depth + 1
        through, stops = (np.bincount(inv, w, len(uniq)).astype(np.int64) for w in (n[live], n[live] * last))
        for c, v in zip(_NODE, (uniq, at[live][some], own[some], before[live][some], np.full(len(uniq), depth), through, stops), strict=True):
            out[c].append(v)
        at[live], before[live] = key, own
        depth += 1
        live = live[~last]
    return {c: np.concatenate(v) for c, v in out.items()}


def _search(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """``searchsorted``, with the keys in order, which costs half on large arrays."""
    by, out = np.argsort(keys), np.empty(len(keys), np.int64)
    out[by] = np.searchsorted(known, keys.take(by))
    return out


class Lexicon:
    """The tree of the subwords of words at hand: at a node, how often a word ends or goes on, and how; the plain form of
    ``Spelling``.

    ``nodes``: ``tree_nodes`` and for each its number of children (``kinds``). ``pairs``: (subword, the one after it, at
    how many nodes). ``on``, ``several``, ``last``: for each subword at how many nodes something follows,
    how many different ones, at how many nodes a word ends. ``count``: of all nodes.
    """

    def __init__(self, size: int, nodes: dict[str, np.ndarray], pairs: tuple, on: np.ndarray, several: np.ndarray, last: np.ndarray, count: int):
        self.size = size
        numbers, order, parents = {0: 0}, [], []
        for d in range(int(nodes["depth"].max(initial=-1)) + 1):
            row = np.flatnonzero(nodes["depth"] == d)
            parent = np.array([numbers[k] for k in nodes["parent"][row].tolist()], np.int64)
            by = np.lexsort((nodes["id"][row], parent))
            for k in nodes["key"][row[by]].tolist():
                numbers[k] = len(numbers)
            order.append(row[by])
            parents.append(parent[by])
        none = np.zeros(0, np.int64)
        row, parent = np.concatenate([none, *order]), np.concatenate([none, *parents])
        own = nodes["id"][row]
        self.keys = parent * size + own  # in order of the nodes
        self.roots = np.full(size, -1)
        self.roots[own[parent == 0]] = np.flatnonzero(parent == 0)
        self.rate = (last + (last.sum() + 0.5) / (count + 1)) / (last + on + 1)  # of ends after a subword
        through, stops, kinds = (nodes[c][row].astype(np.float64) for c in ("through", "stops", "kinds"))
        self.ends = np.append(0.5, (stops + self.rate[own]) / (through + 1))
        lot = np.append(0, through - stops + kinds)
        share = np.divide(through, lot[parent], out=np.zeros(len(row)), where=parent > 0)
        self.direct = np.append(0, (1 - self.ends[parent]) * share)
        self.miss = (1 - self.ends) * np.maximum(0, 1 - np.bincount(parent, share, len(row) + 1))
        self.back = np.append(1, np.where(parent > 0, self.miss[parent], 1))
        before, after, times = pairs
        by = np.lexsort((after, before))
        before, after, times = before[by], after[by], times[by]
        self.pairs = before * size + after
        self.pair_direct = times / (on + several)[before]
        self.pair_back = np.maximum(0, 1 - np.bincount(before, self.pair_direct, size))

    @classmethod
    def of_words(cls, words: list[str], counts: np.ndarray, sub: Subwords) -> Lexicon:
        """Of words that are at hand."""
        nodes = tree_nodes(*sub.spell(words), np.asarray(counts, np.int64))
        kinds = dict(zip(*np.unique(nodes["parent"], return_counts=True), strict=True))
        nodes["kinds"] = np.array([kinds.get(k, 0) for k in nodes["key"]], np.int64)
        deep, size = nodes["before"] >= 0, sub.size
        pairs, times = np.unique(nodes["before"][deep] * size + nodes["id"][deep], return_counts=True)
        on, several = np.bincount(nodes["before"][deep], minlength=size), np.bincount(pairs // size, minlength=size)
        return cls(size, nodes, (pairs // size, pairs % size, times), on, several, np.bincount(nodes["id"][nodes["stops"] > 0], minlength=size), len(deep))

    def walk(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each subword the counted part of its probability and the weight of the model's, and for each word the
        log-probability of its end."""
        node, depth = np.zeros(len(first) - 1, np.int64), 0
        direct, back = np.zeros(len(ids)), np.ones(len(ids))
        back[1:] = 1 - self.rate[ids[:-1]]
        back[first[:-1]] = 1
        live = np.arange(len(node))
        while len(live):
            place, from_ = first[live] + depth, node[live]
            if depth:
                key = from_ * self.size + ids[place]
                to = _search(self.keys, key)
                hit = self.keys[np.minimum(to, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
                back[place] = self.miss[from_]
            else:
                to = self.roots.take(ids[place])
                hit = to >= 0
            back[place[hit]], direct[place[hit]] = self.back[to[hit] + 1], self.direct[to[hit] + 1]
            node[live] = np.where(hit, to + 1, -1)
            depth += 1
            live = live[hit & (first[live + 1] - first[live] > depth)]
        inside = np.ones(len(ids), bool)
        inside[first[:-1]] = False
        inside = np.flatnonzero(inside)
        pair = ids[inside - 1] * self.size + ids[inside]
        to = np.minimum(_search(self.pairs, pair), max(0, len(self.pairs) - 1))
        hit = self.pairs[to] == pair if len(self.pairs) else np.zeros(len(pair), bool)
        direct[inside[hit]] += back[inside[hit]] * self.pair_direct[to[hit]]
        back[inside] *= self.pair_back[ids[inside - 1]]
        return direct, back, np.log(np.where(node > 0, self.ends[node], self.rate[ids[first[1:] - 1]]))


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    dim: int = 8
    buckets: int = 2048
    hop: int = 16

    @property
    def inside(self) -> int:
        """How many classes, the first, are of subwords inside words."""
        return max(1, self.classes // 8)

    def parts(self) -> dict[str, tuple[int, ...]]:
        d = self.dim
        return {"embed": (self.buckets, d), "query": (d, d), "key": (d, d), "value": (d, d), "near": (2 * self.hop,), "out": (d, self.classes), "bias": (self.classes,)}

    def sides(self, goal: np.ndarray, counted: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """The classes inside words and those at word starts, and which of the counted places have their class there."""
        starts = goal >= self.inside
        yield slice(0, self.inside), np.flatnonzero((counted > 0) & ~starts)
        yield slice(self.inside, self.classes), np.flatnonzero((counted > 0) & starts)

    def unpack(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, dims in self.parts().items():
            n = math.prod(dims)
            out[name] = flat[at : at + n].reshape(dims)
            at += n
        return out

    def start(self, seed: int = 7) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scale = {"embed": 0.5, "query": 0.3, "key": 0.3, "value": 0.3, "near": 0.0, "out": 0.2, "bias": 0.0}
        return np.concatenate([rng.normal(0, 1, math.prod(dims)) * scale[name] for name, dims in self.parts().items()]).astype(np.float32)


def _mask(hop: int) -> np.ndarray:
    """(queries, 2 * hop): a query of the second hop sees itself and what is before it."""
    i, j = np.arange(hop)[:, None] + hop, np.arange(2 * hop)[None, :]
    return (j <= i).astype(np.float32)


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids * 2654435761 & 0xFFFFFFFF) * buckets >> 32


@cache
def _distance(hop: int) -> np.ndarray:
    """(queries, 2 * hop): how far before a query of the second hop each input is; 0 for what is after it."""
    return np.maximum(np.arange(hop)[:, None] + hop - np.arange(2 * hop)[None, :], 0)


@cache
def _hidden(hop: int) -> np.ndarray:
    """(queries, 2 * hop): -inf where a query may not look, else 0."""
    return np.where(_mask(hop) > 0, 0, -np.inf).astype(np.float32)


@cache
def _cells(rows: int, columns: int) -> np.ndarray:
    return np.arange(rows * columns).reshape(rows, columns)


def _near(near: np.ndarray, hop: int) -> np.ndarray:
    """The weight of each distance as (queries, 2 * hop), -inf where a query may not look."""
    return near.take(_distance(hop)) + _hidden(hop)


def _windows(x: np.ndarray, hop: int) -> np.ndarray:
    """Places (n * hop, d) as the n - 1 overlapping windows (2 * hop, d) of neighbouring hops, without a copy."""
    return np.ndarray((len(x) // hop - 1, 2 * hop, x.shape[1]), x.dtype, x, 0, (hop * x.strides[0], *x.strides))


def _windows_across(x: np.ndarray, hop: int) -> np.ndarray:
    """Places (d, n * hop) as the n - 1 overlapping windows (d, 2 * hop), without a copy."""
    return np.ndarray((x.shape[1] // hop - 1, len(x), 2 * hop), x.dtype, x, 0, (hop * x.strides[1], *x.strides))


def forward(shape: Shape, p: dict, inputs: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, dict]:
    """inputs: (n, 2 * hop) ids; seen: (n, 2 * hop) 1 where there is one. Scores of classes for the second
    hop's places, and what the backward pass needs."""
    hop, d = shape.hop, shape.dim
    where = _bucket(inputs, shape.buckets)
    x = p["embed"][where]
    flat = x.reshape(-1, d)
    q = (x[:, hop:].reshape(-1, d) @ p["query"]).reshape(-1, hop, d)
    k = (flat @ p["key"]).reshape(-1, 2 * hop, d)
    v = (flat @ p["value"]).reshape(-1, 2 * hop, d)
    i, j = np.arange(hop)[:, None] + hop, np.arange(2 * hop)[None, :]
    distance = np.clip(i - j, 0, 2 * hop - 1)
    s = np.matmul(q, k.transpose(0, 2, 1))
    s *= np.float32(1 / math.sqrt(d))
    s += p["near"][distance]
    np.clip(s, -20, 20, out=s)
    np.exp(s, out=s)
    s *= _mask(hop)
    s *= seen[:, None, :]
    s /= s.sum(-1, keepdims=True)
    h = x[:, hop:] + np.matmul(s, v)
    z = h.reshape(-1, d) @ p["out"]
    z += p["bias"]
    np.clip(z, -30, 30, out=z)
    return z.reshape(-1, hop, shape.classes), {"where": where, "x": x, "q": q, "k": k, "v": v, "a": s, "h": h, "distance": distance}


def gradient(shape: Shape, p: dict, inputs: np.ndarray, seen: np.ndarray, goal: np.ndarray, counted: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean loss over the counted places, and its gradient as one vector; the plain form of ``hop_gradient``."""
    hop, d = shape.hop, shape.dim
    z, c = forward(shape, p, inputs, seen)
    z = np.where((np.arange(shape.classes) >= shape.inside) == (goal >= shape.inside)[:, :, None], z, -1e4)
    z -= np.log(np.exp(z).sum(-1, keepdims=True))
    n = max(1.0, float(counted.sum()))
    rows, cols = np.indices(goal.shape)
    loss = -float((z[rows, cols, goal] * counted).sum()) / n
    dz = np.exp(z)
    dz[rows, cols, goal] -= 1
    dz *= (counted / n)[:, :, None]
    flat = dz.reshape(-1, shape.classes)
    g = {"out": c["h"].reshape(-1, d).T @ flat, "bias": flat.sum(0)}
    dh = (flat @ p["out"].T).reshape(-1, hop, d)
    da = np.matmul(dh, c["v"].transpose(0, 2, 1))
    dv = np.matmul(c["a"].transpose(0, 2, 1), dh)
    ds = c["a"] * (da - (da * c["a"]).sum(-1, keepdims=True))
    g["near"] = np.bincount(c["distance"].ravel(), ds.sum(0).ravel(), 2 * hop)
    ds = ds * np.float32(1 / math.sqrt(d))
    dq, dk = np.matmul(ds, c["k"]), np.matmul(ds.transpose(0, 2, 1), c["q"])
    x, last = c["x"], c["x"][:, hop:]
    g["query"] = last.reshape(-1, d).T @ dq.reshape(-1, d)
    g["key"] = x.reshape(-1, d).T @ dk.reshape(-1, d)
    g["value"] = x.reshape(-1, d).T @ dv.reshape(-1, d)
    dx = (dk.reshape(-1, d) @ p["key"].T + dv.reshape(-1, d) @ p["value"].T).reshape(x.shape)
    dx[:, hop:] += dh + (dq.reshape(-1, d) @ p["query"].T).reshape(dq.shape)
    embed = np.zeros((shape.buckets, d), np.float32)
    np.add.at(embed, c["where"].ravel(), dx.reshape(-1, d))
    g["embed"] = embed
    return loss, np.concatenate([np.asarray(g[name], np.float32).ravel() for name in shape.parts()])


def hop_gradient(shape: Shape, p: dict, inputs: np.ndarray, fresh: np.ndarray, goal: np.ndarray, counted: np.ndarray) -> tuple[float, np.ndarray]:
    """What ``gradient`` gives for windows that overlap: rows (n, hop) one after another, each seen with the row before
    it unless it is ``fresh``. What depends on one input is computed once, not in both windows that have it."""
    hop, d, rows, n = shape.hop, shape.dim, len(inputs), inputs.size
    none = np.zeros((d, 1), np.float32)
    to_query, to_key, to_value = p["query"] * np.float32(1 / math.sqrt(d)), p["key"], np.concatenate((p["value"], none), 1)
    where = _bucket(inputs.ravel(), shape.buckets)
    padded = np.concatenate((p["embed"], np.zeros((shape.buckets, 1), np.float32)), 1).take(where, 0)
    x = padded[:, :d]
    # keys and values begin with a row of none, before all others; their transposes have windows along the rows
    q, (k, v), (kt, vt) = x @ to_query, (np.empty((n + hop, c), np.float32) for c in (d, d + 1)), (np.empty((c, n + hop), np.float32) for c in (d, d + 1))
    k[:hop], kt[:, :hop], v[:hop], vt[:, :hop] = 0, 0, 0, 0
    for weights, along, across in ((to_key, k, kt), (to_value, v, vt)):
        np.matmul(x, weights, out=along[hop:])
        np.matmul(weights.T, x.T, out=across[:, hop:])
    v[:, d] = vt[d] = 1  # its product sums the weights
    q, k, kt, v, vt = q.reshape(rows, hop, d), _windows(k, hop), _windows_across(kt, hop), _windows(v, hop), _windows_across(vt, hop)
    a = np.matmul(q, kt)
    a += _near(p["near"], hop)
    np.minimum(a, 20, out=a)
    np.exp(a, out=a)
    a[fresh, :, :hop] = 0
    a[:1, :, :hop] = 0
    h = np.matmul(a, v).reshape(n, d + 1)
    one = 1 / h[:, d:]
    h *= one  # its last column is ones now, for the bias
    mean = h.copy()
    h += padded
    out = np.concatenate((p["out"], p["bias"][None]))
    goal, counted = goal.ravel(), counted.ravel()
    m = np.float32(max(1.0, float(counted.sum())))
    loss, dout, dh = 0.0, np.empty_like(out), np.zeros((n, d + 1), np.float32)
    for part, some in shape.sides(goal, counted):
        mine, weight, own = h.take(some, 0), counted.take(some) / m, np.ascontiguousarray(out[:, part])
        z = mine @ own
        np.clip(z, -30, 30, out=z)
        np.exp(z, out=z)
        at = np.arange(len(some)) * z.shape[1] + goal.take(some) - part.start
        total = z @ np.ones(z.shape[1], np.float32)
        loss -= float((np.log(z.take(at) / total) * weight).sum())
        z *= (weight / total)[:, None]
        z.ravel()[at] -= weight
        dout[:, part] = mine.T @ z
        own[d] = 0
        dh[some] = z @ own.T
    back = dh * one
    back[:, d] = -np.einsum("ij,ij->i", back, mean)
    back = back.reshape(rows, hop, d + 1)

    def gathered(of: np.ndarray) -> np.ndarray:
        """What the places of a row get as its own window's and as the next one's."""
        got = np.matmul(a[:, :, hop:].transpose(0, 2, 1), of)
        got[:-1] += np.matmul(a[1:, :, :hop].transpose(0, 2, 1), of[1:])
        return got.reshape(n, -1)

    dv = gathered(back)
    a *= np.matmul(back, vt)
    dq, dk = np.matmul(a, k).reshape(n, d), gathered(q)
    dh = dh[:, :d] + dq @ to_query.T
    dh += dk @ to_key.T
    dh += dv @ to_value.T
    g = {"query": (x.T @ dq) * np.float32(1 / math.sqrt(d)), "key": x.T @ dk, "value": (x.T @ dv)[:, :d], "out": dout[:d], "bias": dout[d]}
    g["embed"] = np.bincount(_cells(shape.buckets, d).take(where, 0).ravel(), dh.ravel(), shape.buckets * d)
    g["near"] = np.bincount(_distance(hop).ravel(), np.ones(rows, np.float32) @ a.reshape(rows, -1), 2 * hop)
    return loss, np.concatenate([np.asarray(g[name], np.float32).ravel() for name in shape.parts()])


@dataclass
class Model:
    shape: Shape
    flat: np.ndarray
    class_of: np.ndarray
    share: np.ndarray  # log-probability of a token within its class

    def _tables(self) -> tuple:
        """For each bucket: query (scaled); key, as columns; value and a one (so that the product with the weights also
        sums them); embedding and a zero. The weight of each distance; the maps to classes inside words and at word
        starts, the bias last. Whether weights and scores can leave the bounds ``forward`` holds them in."""
        p = self.shape.unpack(self.flat)
        e, out = p["embed"], np.concatenate((p["out"], p["bias"][None]))
        one = np.ones((len(e), 1), np.float32)
        each = e @ p["query"] / np.float32(math.sqrt(self.shape.dim)), np.ascontiguousarray((e @ p["key"]).T), np.concatenate((e @ p["value"], one), 1), np.concatenate((e, 0 * one), 1)
        longest = lambda x: float(np.sqrt((x**2).sum(1)).max())
        wide = longest(each[0]) * longest(each[1].T) + float(p["near"].max()) > 20
        high = (longest(each[2][:, :-1]) + longest(e)) * longest(p["out"].T) + float(np.abs(p["bias"]).max()) > 30
        return each, _near(p["near"], self.shape.hop), [np.ascontiguousarray(out[:, c]) for c in (slice(0, self.shape.inside), slice(self.shape.inside, None))], wide, high

    def log_prob(self, ids: np.ndarray, n: np.ndarray, end: int, rows: int = 128) -> np.ndarray:
        """Natural log-probability of each text's ids. Texts lie one after another in ``ids``, ``n`` ids each, at least
        one."""
        return np.add.reduceat(self.each(ids, n, end, rows).astype(np.float64), np.cumsum(n) - n) if len(n) else np.zeros(0)

    def each(self, ids: np.ndarray, n: np.ndarray, end: int, rows: int = 128) -> np.ndarray:
        """The same of each id (as ``forward`` has it, with what depends on one id alone looked up)."""
        hop, d = self.shape.hop, self.shape.dim
        if not hasattr(self, "_kept"):
            self._kept = self._tables()
        (queries, keys, values, embed), near, out, wide, high = self._kept
        hops = (n + hop - 1) // hop
        first, begin = np.concatenate(([0], np.cumsum(hops))), np.concatenate(([0], np.cumsum(n)))
        place = np.arange(len(ids)) + np.repeat(first[:-1] * hop - begin[:-1], n)
        goal = np.full(int(first[-1]) * hop, end, np.int64)
        goal[place] = ids
        inputs = np.full(len(goal) + 1, end, np.int64)  # the end also begins a text
        inputs[place + 1] = ids
        inputs[first[:-1] * hop] = end
        inputs = inputs[:-1]
        where = np.concatenate((np.zeros(hop, np.int64), _bucket(inputs, self.shape.buckets)))  # a row before the first
        classes, share = self.class_of.take(goal), self.share.take(goal)
        fresh = np.zeros(len(hops) and int(first[-1]), bool)
        fresh[first[:-1]] = True
        got = np.empty(len(goal), np.float32)
        for s in range(0, len(fresh), rows):
            part = slice(s * hop, min(s + rows, len(fresh)) * hop)
            own = classes[part]
            seen = where[part.start : part.stop + hop]  # and the row before them
            here = seen[hop:]
            a = np.matmul(queries.take(here, 0).reshape(-1, hop, d), _windows_across(keys.take(seen, 1), hop))
            a += near
            if wide:
                np.minimum(a, 20, out=a)
            np.exp(a, out=a)
            a[fresh[s : s + rows], :, :hop] = 0
            h = np.matmul(a, _windows(values.take(seen, 0), hop)).reshape(-1, d + 1)
            h *= 1 / h[:, d:]
            h += embed.take(here, 0)
            found = got[part]
            for (side, some), weights in zip(self.shape.sides(own, np.ones(len(own), np.int8)), out, strict=True):
                z = h.take(some, 0) @ weights
                if high:
                    np.clip(z, -30, 30, out=z)
                chosen = z.take(np.arange(len(some)) * z.shape[1] + own.take(some) - side.start)
                found[some] = chosen - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], np.float32))
        return (got + share)[place]


def _bands(n: np.ndarray, k: int) -> np.ndarray:
    """k bands of about equal mass in order of frequency."""
    order = np.argsort(-n, kind="stable")
    mass = np.cumsum(n[order])
    out = np.empty(len(n), np.int64)
    out[order] = np.minimum((mass / mass[-1] * k).astype(np.int64), k - 1) if len(n) else 0
    return out


def _groups(near: np.ndarray, n: np.ndarray, k: int, steps: int = 20) -> np.ndarray:
    """k groups of tokens alike in what they stand near (k-means over roots of shares, weighted by roots of counts)."""
    mean = (near.sum(0) + 1) / (near.sum() + near.shape[1])
    x = near + 3 * mean
    x = np.sqrt(x / x.sum(1, keepdims=True)).astype(np.float32)
    weight = np.sqrt(n)
    centres = [np.sqrt(mean)]
    far = np.full(len(x), np.inf)
    for _ in range(k - 1):  # the next centre: what is far from all so far and frequent
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
        centres.append(x[np.argmax(far * weight)])
    centres = np.array(centres, np.float32)
    for _ in range(steps):
        mine = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), 1)
        mass = np.bincount(mine, weight, k)
        for f in range(x.shape[1]):
            centres[:, f] = np.where(mass > 0, np.bincount(mine, weight * x[:, f], k) / np.maximum(mass, 1e-9), centres[:, f])
    return mine


def token_classes(counts: np.ndarray, starts: np.ndarray, shape: Shape, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and the log of its share. Tokens inside words: bands of frequency. Those that start words:
    the most frequent are a quarter of the classes, the rest are grouped by ``near`` (None: by frequency)."""
    n = counts + 0.5
    class_of = np.empty(len(n), np.int64)
    class_of[~starts] = _bands(n[~starts], shape.inside)
    order = np.flatnonzero(starts)
    order = order[np.argsort(-n[order], kind="stable")]
    own = (shape.classes - shape.inside) // 4
    class_of[order[:own]] = shape.inside + np.arange(own)
    rest, k = order[own:], shape.classes - shape.inside - own
    class_of[rest] = shape.inside + own + (_bands(n[rest], k) if near is None or not len(rest) else _groups(near[rest], n[rest], k))
    return class_of, np.log(n / np.bincount(class_of, n, shape.classes)[class_of])


def _beside(features, starts, kind: np.dtype, hop: int, block: int = 256):
    """Rows (id, v): how often each frequent word start stands in the same four hops as the id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        chosen, may = features.value, starts.value
        column = np.full(len(may), -1)
        column[chosen] = np.arange(len(chosen))
        total = np.zeros((len(may), len(chosen)), np.float32)
        lanes, most = -(-len(chosen) // 4) * 4, 65535 // (4 * hop)  # four counts are added as one integer; so many cells can't overflow one
        for batch in batches:
            for s in range(0, len(batch), block):
                part = batch.slice(s, block)
                before = np.where(part.column("kind").to_numpy() == GOES_ON, hop + 1, 1)  # these are another row's
                windows = [w[k * kind.itemsize :] for w, k in zip(part.column("ids").to_pylist(), before.tolist(), strict=True)]
                n = np.array([len(w) // kind.itemsize for w in windows])
                ids = np.frombuffer(b"".join(windows), kind)
                cells = -(-n // (4 * hop))
                row = np.repeat(np.cumsum(cells) - cells, n) + (np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)) // (4 * hop)
                word = np.flatnonzero(may.take(ids))
                if not len(word):
                    continue
                row, ids = row.take(word), ids.take(word)
                mine = column.take(ids)
                tally = np.bincount(row[mine >= 0] * lanes + mine[mine >= 0], minlength=cells.sum() * lanes).astype("<u2").reshape(-1, lanes).view("<u8")
                order = np.argsort(ids, kind="stable")
                ids = ids.take(order)
                new = np.append(True, ids[1:] != ids[:-1])
                first = np.flatnonzero(new)
                short = np.flatnonzero(new | ((np.arange(len(ids)) - np.repeat(first, np.diff(first, append=len(ids)))) % most == 0))
                runs = np.add.reduceat(tally.take(row.take(order), 0), short, axis=0).view("<u2")[:, : len(chosen)]
                alone = new.take(short)
                total[ids[first]] += runs[alone]
                np.add.at(total, ids[short[~alone]], runs[~alone])
                own = np.bincount(mine[mine >= 0], minlength=len(chosen))
                total[chosen, np.arange(len(chosen))] -= own  # not itself
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(list(total[some]), pa.list_(pa.float32()))], names=["id", "v"])

    return run


def beside(stretches: DataFrame, tokens: np.ndarray, starts: np.ndarray, kind: np.dtype, hop: int, width: int = 32) -> np.ndarray:
    """For each id (at most the vocabulary) its co-occurrences with the ``width`` most frequent word starts, over all
    training text."""
    sc = stretches.sparkSession.sparkContext
    chosen = np.flatnonzero(starts)
    chosen = chosen[np.argsort(-tokens[chosen], kind="stable")][:width]
    rows = stretches.mapInArrow(giving_back(_beside(sc.broadcast(chosen), sc.broadcast(starts), kind, hop)), "id long, v array<float>")
    out = np.zeros((len(tokens), len(chosen)), np.float32)
    for r in rows.groupBy("id").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(len(chosen)))).alias("v")).collect():
        out[r["id"]] = r["v"]
    return out


class Vocabulary:
    """Numbers of words, from 0 in the order they are put. Words of at most 16 bytes are compared as two integers and a
    length in an open table of arrays, so that a block of text is looked up at once; longer ones are in a dict."""

    def __init__(self):
        self.slots, self.keys, self.n, self.long = np.full(1 << 12, -1, np.int32), np.zeros((1 << 11, 3), U), 0, {}

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + keys[:, 2])) & U(len(self.slots) - 1)).astype(np.int64)

    def find(self, words: Spread) -> np.ndarray:
        """The number of each word, -1 without one."""
        out, keys = np.full(len(words.size), -1), words.keys
        at, live = self._at(keys), np.arange(len(out))
        while len(live):
            number = self.slots.take(at)
            own = self.keys.take(number, 0, mode="clip")
            same = (own[:, 0] == keys[:, 0]) & (own[:, 1] == keys[:, 1]) & (own[:, 2] == keys[:, 2])
            same &= number >= 0
            out[live[same]] = number[same]
            rest = np.flatnonzero((number >= 0) & ~same)
            live, keys, at = live[rest], keys[rest], (at[rest] + 1) & (len(self.slots) - 1)
        for i in np.flatnonzero(words.size > 16).tolist():
            out[i] = self.long.get(words.word(i), -1)
        return out

    def put(self, words: Spread) -> None:
        """Numbers for words that have none, each given once."""
        n = self.n + len(words.size)
        if n > len(self.keys):
            more = np.zeros((max(n, 2 * len(self.keys)), 3), U)
            more[: self.n] = self.keys[: self.n]
            self.keys = more
        self.keys[self.n : n] = words.keys
        numbers = np.arange(self.n, n)
        for i in np.flatnonzero(words.size > 16).tolist():
            self.long[words.word(i)] = self.n + i
        if 4 * n > len(self.slots):
            self.slots, numbers = np.full(1 << (4 * n).bit_length(), -1, np.int32), np.arange(n)
        self.n = n
        numbers = numbers[self.keys[numbers, 2] <= 16]
        at = self._at(self.keys[numbers])
        while len(numbers):
            free = self.slots.take(at) < 0
            self.slots[at[free]] = numbers[free]
            rest = np.flatnonzero(self.slots.take(at) != numbers)
            numbers, at = numbers[rest], (at[rest] + 1) & (len(self.slots) - 1)


class Spread:
    """Words of texts (bytes, lowered) in arrays: ``start`` and ``size`` in ``raw``, how many each text has (``n``), and
    ``keys``: the first 16 bytes as two integers, and the length."""

    _keep = np.array([[(1 << 8 * min(8, max(0, k - 8 * i))) - 1 for i in (0, 1)] for k in range(17)], U)

    def __init__(self, texts: list[bytes]):
        data = (b"\n".join(texts) + b"\n").translate(LOWER) + bytes(16)
        self.raw = np.frombuffer(data, np.uint8)
        inside = SPACED.take(self.raw[:-16])
        edge = np.flatnonzero(np.append(inside[:1], inside[1:] != inside[:-1]))
        self.start, self.size = edge[::2], edge[1::2] - edge[::2]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.n = np.diff(np.searchsorted(self.start, bounds))
        self.keys = np.empty((len(self.size), 3), U)
        self.keys[:, :2] = np.ndarray(len(self.raw) - 15, "V16", data, strides=(1,))[self.start].view("<u8").reshape(-1, 2) & self._keep.take(np.minimum(self.size, 16), 0)
        self.keys[:, 2] = self.size

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def names(self, some: np.ndarray):
        """Some of the words as an Arrow array."""
        import pyarrow as pa

        size = self.size.take(some)
        off = np.append(0, np.cumsum(size))
        place = np.arange(off[-1]) + np.repeat(self.start.take(some) - off[:-1], size)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(off), pa.py_buffer(self.raw.take(place))])

    def pick(self, some: np.ndarray) -> Spread:
        """Some of the words, of no text."""
        out = object.__new__(Spread)
        out.raw, out.start, out.size, out.keys, out.n = self.raw, self.start[some], self.size[some], self.keys[some], None
        return out


def stretches_of(n: np.ndarray, hop: int, hops: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that have ``n`` ids each, an end in front not counted: for each stretch its text, its number there, and
    the places of its first and after its last id, where the end in front has place 0. A stretch has ``hops`` hops of
    targets, after one input more and, unless it is a text's first, the hop before it."""
    many = -(-n // (hop * hops))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, k, np.maximum(0, k * hops - 1) * hop, np.minimum((k + 1) * hops * hop, n[text]) + 1


#: Kinds of gathered rows.
WORD, BEGINS, GOES_ON, TEXTS = range(4)


def _binary(ids: np.ndarray, first: np.ndarray, kind: np.dtype):  # noqa: ANN202
    """Ids of words as an Arrow array of bytes."""
    import pyarrow as pa

    ids = np.ascontiguousarray(ids[first[0] : first[-1]].astype(kind))
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(((first - first[0]) * kind.itemsize).astype(np.int32)), pa.py_buffer(ids)])


def _from_binary(paths, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Ids of words and where each word's begin, of an Arrow array of bytes."""
    off = np.frombuffer(paths.buffers()[1], np.int32)[paths.offset : paths.offset + len(paths) + 1].astype(np.int64) if len(paths) else np.zeros(1, np.int64)
    data = np.frombuffer(paths.buffers()[2], np.uint8)[off[0] : off[-1]].tobytes() if len(paths) else b""
    return np.frombuffer(data, kind).astype(np.int64), (off - off[0]) // kind.itemsize


def _gather(sent, hop: int, hops: int = 32, block: int = 1 << 16, most_words: int = 400_000, paths: bool = False):
    def run(batches: Iterator) -> Iterator:
        """Rows (kind, word, n, ids): word counts, stretches that begin a text and that go on in it, number of texts. All
        ids of all texts are in stretches. With ``paths`` also the words' ids, as ``path``; of texts that are ``held_out``
        the words alone are wanted, which counts them as 0."""
        import pyarrow as pa

        sub = subwords(*sent.value)
        known, names_of = Vocabulary(), []  # a word's number is one more; 0: the end
        counts, spelled, first = np.zeros(1, np.int64), np.array([sub.end], sub.kind), np.array([0, 1])
        docs = 0
        names = ["kind", "word", "n", "ids", *(["path"] if paths else [])]
        none = lambda n: [pa.nulls(n, pa.binary())] if paths else []

        def numbers(spread: Spread) -> np.ndarray:
            nonlocal spelled, first
            found = known.find(spread)
            new = np.flatnonzero(found < 0)
            if len(new):
                coded = spread.names(new).dictionary_encode()
                mine = coded.indices.to_numpy()
                found[new] = known.n + mine
                at = np.empty(len(coded.dictionary), np.int64)
                at[mine] = new
                known.put(spread.pick(at))
                names_of.append(coded.dictionary)
                ids, at = sub.spell_names(coded.dictionary)
                spelled, first = np.append(spelled, ids.astype(sub.kind)), np.append(first, at[1:] + first[-1])
            return found

        def cut(texts: list) -> pa.RecordBatch:
            nonlocal counts
            spread = Spread([t for _, t in texts])
            found = numbers(spread)
            n = spread.n + 2  # an end in front, and one at the end
            words = np.zeros(len(found) + 2 * len(n), np.int64)
            words[np.arange(len(found)) + np.repeat(2 * np.arange(len(n)) + 1, spread.n)] = found + 1
            new = np.bincount(words, minlength=len(first) - 1)
            new[: len(counts)] += counts
            counts = new
            size = np.diff(first).take(words)
            place = np.repeat(first.take(words) - (np.cumsum(size) - size), size)
            place += np.arange(len(place))
            ids = spelled.take(place)
            n = np.add.reduceat(size, np.cumsum(n) - n)
            begin = np.cumsum(n) - n
            text, k, from_, to = stretches_of(n - 1, hop, hops)
            salt = [crc32(f"{texts[t][0]}/{i}".encode()) for t, i in zip(text.tolist(), k.tolist(), strict=True)]
            cuts = [ids[a:b].tobytes() for a, b in zip((begin[text] + from_).tolist(), (begin[text] + to).tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.where(k > 0, GOES_ON, BEGINS).astype(np.int32)), pa.nulls(len(k), pa.string()), pa.array(salt, pa.int64()), pa.array(cuts, pa.binary()), *none(len(k))], names=names)

        def flush() -> Iterator:
            nonlocal counts, spelled, first, known
            counts, at = np.append(counts, np.zeros(len(first) - 1 - len(counts), np.int64)), 1
            for some in names_of:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), WORD, np.int32)), some.cast(pa.binary()).cast(pa.string(), safe=False), pa.array(counts[at : at + len(some)]), pa.nulls(len(some), pa.binary()), *([_binary(spelled, first[at : at + len(some) + 1], sub.kind)] if paths else [])], names=names)
                at += len(some)
            names_of.clear()
            known = Vocabulary()
            counts, spelled, first = counts[:1] * 0, spelled[:1], first[:2]

        for batch in batches:
            texts, much, asked, more = [], 0, [], 0
            for doc, *out, text in rows_of(batch, "doc_id", *(["held_out"] if paths else [])):
                if paths and out[0]:
                    asked.append(text)
                    more += len(text) + 6
                else:
                    docs += 1
                    texts.append((doc, text))
                    much += len(text) + 6
                if more >= 6 * block:
                    numbers(Spread(asked))
                    asked, more = [], 0
                if much >= 6 * block:
                    yield cut(texts)
                    texts, much = [], 0
                if known.n > most_words:
                    yield from flush()
            if asked:
                numbers(Spread(asked))
            if texts:
                yield cut(texts)
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([TEXTS], pa.int32()), pa.nulls(1, pa.string()), pa.array([docs], pa.int64()), pa.nulls(1, pa.binary()), *none(1)], names=names)

    return run


def _spell(sent, block: int = 1 << 15):
    def run(batches: Iterator) -> Iterator:
        """Adds ``path``, the word's ids."""
        import pyarrow as pa

        sub = subwords(*sent.value)
        for batch in batches:
            for s in range(0, len(batch), block):
                part = batch.slice(s, block)
                path = _binary(*sub.spell(part.column("word").to_pylist()), sub.kind)
                yield pa.RecordBatch.from_arrays([*part.columns, path], names=[*part.schema.names, "path"])

    return run


def _least(counts: DataFrame, column: str, most: int) -> int | None:
    """The least value of ``column`` such that at most ``most`` rows have it or more; None if there is none."""
    least, seen = None, 0
    for r in counts.groupBy(column).count().orderBy(F.col(column).desc()).limit(most).collect():
        seen += r["count"]
        if seen > most:
            break
        least = r[column]
    return least


def _paths(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each subword its word, its place in it, the subword before (-1: none) and the key of ``tree_nodes``."""
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(ids)) - np.repeat(first[:-1], size)
    before = np.where(at > 0, np.append(-1, ids[:-1])[: len(ids)], -1)
    keys = np.zeros(len(ids), np.int64)
    for d in range(int(size.max(initial=0))):
        here = first[:-1][size > d] + d
        up = keys[here - 1] if d else np.zeros(len(here), np.int64)
        keys[here] = mix((up.view(U) + ids[here].astype(U) + U(1)) * U(0x9E3779B97F4A7C15)).view(np.int64)
    return row, at, before, keys


def _weights(first: np.ndarray, ids: np.ndarray, before: np.ndarray, direct: np.ndarray, miss: np.ndarray, ends: np.ndarray, pair: np.ndarray, rate: np.ndarray, pair_back: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``Lexicon.walk`` gives, of words whose nodes (nan: there is none) and pairs (nan: none) were looked up."""
    inside = np.ones(len(ids), bool)
    inside[first[:-1]] = False
    hit, back = ~np.isnan(direct), np.ones(len(ids))
    prior = np.flatnonzero(inside) - 1
    back[inside] = np.where(hit[prior], miss[prior], 1 - rate[before[inside]])
    direct = np.where(hit, direct, 0)
    direct[inside] += back[inside] * np.nan_to_num(pair[inside])
    back[inside] *= pair_back[before[inside]]
    last = first[1:] - 1
    return direct, back, np.log(np.where(hit[last], ends[last], rate[ids[last]]))


def _key(kind: np.dtype) -> Column:
    """The first two subwords of ``path``: words that share them have all nodes after the first in common or alone."""
    return F.substring("path", 1, 2 * kind.itemsize)


def _whole(batches: Iterator, block: int) -> Iterator:
    """Batches of rows in order of ``key`` as tables of whole keys, of ``block`` rows or more (but the last)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, much = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        much += len(batch)
        if much <= block or batch.column("key")[0] == batch.column("key")[-1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column("key").chunk(0)
        new = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        cut = int(new[-1]) + 1  # the last key may go on
        yield table.slice(0, cut).combine_chunks()
        held, much = table.slice(cut).combine_chunks().to_batches(), len(table) - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(table, column: str):  # noqa: ANN001, ANN202
    """A column of a table of one chunk."""
    import pyarrow as pa

    found = table.column(column)
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


_LEARNED = "word string, n long, path binary, before int, id int, times long, tokens long, last long, first_through long, first_stops long, first_kinds long"


def _learned(size: int, kind: np.dtype, block: int):
    def run(batches: Iterator) -> Iterator:
        """The words (before: null), how many nodes each pair of subwords has (times), and for each subword (before: -1)
        what is met: of nodes after a word's first subword how many words go through (tokens) and at how many one ends
        (last); of first subwords how many words go through, stop there, and how many different subwords follow."""
        import pyarrow as pa

        total = np.zeros((5, size), np.int64)
        names = [c.split(" ")[0] for c in _LEARNED.split(", ")]

        def rows(many: int, **given) -> pa.RecordBatch:  # noqa: ANN003
            types = {"word": pa.string(), "path": pa.binary(), "before": pa.int32(), "id": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(given[c], types.get(c, pa.int64())) if c in given else pa.nulls(many, types.get(c, pa.int64())) for c in names], names=names)

        for table in _whole(batches, block):
            n, path = _one(table, "n"), _one(table, "path")
            for s in range(0, len(table), 10000):
                part = table.slice(s, 10000).combine_chunks()
                yield rows(len(part), word=_one(part, "word"), n=_one(part, "n"), path=_one(part, "path"))
            ids, first = _from_binary(path, kind)
            met = np.flatnonzero(n.to_numpy() > 0)
            nodes = tree_nodes(*_picked(ids, first, met), n.to_numpy()[met])
            top, deep = nodes["depth"] == 0, nodes["depth"] > 0
            own, after = nodes["id"][top], nodes["id"][deep]
            for i, (of, what) in enumerate(((after, nodes["through"][deep]), (after, nodes["stops"][deep] > 0), (own, nodes["through"][top]), (own, nodes["stops"][top]), (nodes["before"][nodes["depth"] == 1], 1))):
                np.add.at(total[i], of, what)
            pairs, times = np.unique(nodes["before"][deep] * size + after, return_counts=True)
            for s in range(0, len(pairs), 10000):
                some = pairs[s : s + 10000]
                yield rows(len(some), before=some // size, id=some % size, times=times[s : s + 10000])
        some = np.flatnonzero(total.any(0))
        yield rows(len(some), before=np.full(len(some), -1), id=some, **dict(zip(names[-5:], total[:, some], strict=True)))

    return run


def _picked(ids: np.ndarray, first: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some of the words, and where each word's begin."""
    n = np.diff(first)[some]
    begin = np.append(0, np.cumsum(n))
    return ids.take(np.arange(begin[-1]) + np.repeat(first[:-1][some] - begin[:-1], n)), begin


def _pairs_in(size: int, kind: np.dtype):
    def run(batches: Iterator) -> Iterator:
        """Rows (key, pair): pairs of subwords in words of a key, at least once each."""
        import pyarrow as pa

        for batch in batches:
            ids, first = _from_binary(batch.column("path"), kind)
            keys = batch.column("key").dictionary_encode()
            row, _, before, _ = _paths(ids, first)
            deep = np.flatnonzero(before >= 0)
            met = np.unique(np.stack((keys.indices.to_numpy().astype(np.int64)[row[deep]], before[deep] * size + ids[deep])), axis=1)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(met[0])), pa.array(met[1])], names=["key", "pair"])

    return run


def _walked(size: int, kind: np.dtype, sent, block: int, every: bool):
    def run(batches: Iterator) -> Iterator:
        """Rows (word, n, direct, back, stop) of words that come with all training words (n > 0) of their key."""
        import pyarrow as pa
        import pyarrow.compute as pc

        have = sent.value
        rate, (top, top_miss, top_ends), pair_back = have["rate"], have["top"], have["pair_back"]
        for table in _whole(batches, block):
            known, values = have["pairs"], have["times"]
            if known is None:  # they come along
                some = table.filter(pc.is_null(table.column("path"))).combine_chunks()
                known, at = np.unique(_one(some, "pair").to_numpy(zero_copy_only=False).astype(np.int64), return_index=True)
                values = _one(some, "share").to_numpy(zero_copy_only=False)[at]
                table = table.filter(pc.is_valid(table.column("path"))).combine_chunks()
            ids, first = _from_binary(_one(table, "path"), kind)
            n = pc.fill_null(_one(table, "n"), 0).to_numpy()
            met = np.flatnonzero(n > 0)
            nodes = tree_nodes(*_picked(ids, first, met), n[met])
            by = np.argsort(nodes["key"])
            keys, parent, own = nodes["key"][by], nodes["parent"][by], nodes["id"][by]
            through, stops = (nodes[c][by].astype(np.float64) for c in ("through", "stops"))
            deep = nodes["depth"][by] > 0
            up = np.searchsorted(keys, parent).clip(max=max(0, len(keys) - 1))
            kinds = np.bincount(up[deep], minlength=len(keys))
            ends, lot = (stops + rate[own]) / (through + 1), through - stops + kinds
            miss = np.where(lot > 0, (1 - ends) * kinds / np.maximum(lot, 1), 1 - ends)
            ends[~deep], miss[~deep] = top_ends[own[~deep]], top_miss[own[~deep]]
            lot[~deep] = top[own[~deep]]
            direct = np.where(deep, through * (1 - ends[up]) / np.maximum(lot[up], 1), 0)

            asked = np.arange(len(n)) if every else np.flatnonzero(pc.is_null(_one(table, "n")).to_numpy(zero_copy_only=False))
            ids, first = _picked(ids, first, asked)
            _, place, before, path = _paths(ids, first)
            at = _search(keys, path).clip(max=max(0, len(keys) - 1))
            hit = keys[at] == path if len(keys) else np.zeros(len(path), bool)
            nan = lambda x: np.where(hit, x[at], np.nan) if len(keys) else np.full(len(path), np.nan)
            direct, miss, ends = nan(direct), nan(miss), nan(ends)
            start = place == 0  # a first subword has words of other keys too
            there = top_ends[ids[start]] >= 0
            direct[start], miss[start], ends[start] = (np.where(there, x, np.nan) for x in (0.0, top_miss[ids[start]], top_ends[ids[start]]))
            pair = before * size + ids
            at = _search(known, pair).clip(max=max(0, len(known) - 1))
            share = np.where((known[at] == pair) & (before >= 0), values[at], np.nan) if len(known) else np.full(len(pair), np.nan)
            direct, back, stop = _weights(first, ids, before, direct, miss, ends, share, rate, pair_back)
            word = _one(table, "word")
            for s in range(0, len(asked), 10000):
                part = asked[s : s + 10000]
                bounds = first[s : s + len(part) + 1]
                lists = [pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), pa.array(x[bounds[0] : bounds[-1]].astype(np.float32))) for x in (direct, back)]
                yield pa.RecordBatch.from_arrays([word.take(pa.array(part)), pa.array(n[part]), *lists, pa.array(stop[s : s + len(part)])], names=["word", "n", "direct", "back", "stop"])

    return run


@dataclass
class Spelling:
    """The tree of all words' subwords. ``words``: (word, n, path), those with a count of 0 not being in the tree; ``sent``:
    what is known of each subword, and the pairs if they are sent; ``pairs``: else (pair, share)."""

    words: DataFrame
    pairs: DataFrame | None
    sent: object
    ranks: object
    size: int
    kind: np.dtype
    block: int

    def every(self) -> DataFrame:
        """(word, n, direct, back, stop) of all words of the table: what ``Lexicon.walk`` gives."""
        return self._met(self.words, True)

    def of(self, words: DataFrame) -> DataFrame:
        """(word, direct, back, stop) of different ``words``."""
        return self._asked(words.select("word").mapInArrow(_spell(self.ranks), "word string, path binary"))

    def _asked(self, paths: DataFrame) -> DataFrame:
        asked = paths.select("word", F.lit(None).cast("long").alias("n"), "path")
        return self._met(self.words.filter("n > 0").union(asked), False).drop("n")

    def _met(self, rows: DataFrame, every: bool) -> DataFrame:
        rows = rows.select(_key(self.kind).alias("key"), "word", "n", "path")
        if self.pairs is not None:
            met = rows.select("key", "path").mapInArrow(_pairs_in(self.size, self.kind), "key binary, pair long").distinct().join(self.pairs, "pair")
            rows = rows.unionByName(met.select("key", "pair", "share"), allowMissingColumns=True)
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(giving_back(_walked(self.size, self.kind, self.sent, self.block, every)), "word string, n long, direct array<float>, back array<float>, stop double")

    def walk(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of a few words that are at hand, as arrays of ids."""
        import pyarrow as pa
        import pyarrow.compute as pc

        names = pa.array([str(i) for i in range(len(first) - 1)])
        asked = self.words.sparkSession.createDataFrame(pa.table({"word": names, "path": _binary(ids, np.asarray(first), self.kind)}))
        got = self._asked(asked).toArrow().combine_chunks()
        got = got.take(pc.index_in(names, got.column("word").combine_chunks()))
        direct, back = (pc.list_flatten(got.column(c)).to_numpy().astype(np.float64) for c in ("direct", "back"))
        return direct, back, got.column("stop").to_numpy()


def learn_words(words: DataFrame, sent, size: int, block: int = 1 << 16, sent_pairs: int = 1 << 20) -> tuple[Spelling, np.ndarray]:
    """The tree of all ``words`` (word, n and, if at hand, path; in any number of rows each), and how often each subword is
    in them. What comes to the driver is of the vocabulary's size, and at most ``sent_pairs`` pairs of subwords, which are
    sent to all tasks; more are joined by a shuffle. A task takes at least ``block`` words at a time, as whole keys."""
    if "path" not in words.columns:
        words = words.select("word", "n").mapInArrow(_spell(sent), "word string, n long, path binary")
    kind = subwords(*sent.value).kind
    rows = words.withColumn("key", _key(kind)).repartition("key").groupBy("key", "word", "path").agg(F.sum("n").alias("n"))
    learned = materialize(rows.sortWithinPartitions("key").mapInArrow(giving_back(_learned(size, kind, block)), _LEARNED), "lm-words", "zstd")
    tokens, last, through, stops, kinds = (np.zeros(size, np.int64) for _ in range(5))
    for r in learned.filter("before < 0").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("tokens", "last", "first_through", "first_stops", "first_kinds"))).collect():
        tokens[r["id"]], last[r["id"]], through[r["id"]], stops[r["id"]], kinds[r["id"]] = r[1], r[2], r[3], r[4], r[5]
    pairs = materialize(learned.filter("before >= 0").groupBy("before", "id").agg(F.sum("times").alias("times")), "lm-pairs")
    on, several = np.zeros((2, size), np.int64)
    for r in pairs.groupBy("before").agg(F.sum("times").alias("on"), F.count("*").alias("several")).collect():
        on[r["before"]], several[r["before"]] = r["on"], r["several"]
    tokens += through
    last += stops > 0
    count = on.sum() + (through > 0).sum()
    rate = (last + (last.sum() + 0.5) / (count + 1)) / (last + on + 1)  # of ends after a subword
    pair_back = np.divide(several, on + several, out=np.ones(size), where=on + several > 0)
    lot = through - stops + kinds
    ends = np.where(through > 0, (stops + rate) / (through + 1), -1)  # -1: no word begins so
    miss = np.where(lot > 0, (1 - ends) * kinds / np.maximum(lot, 1), 1 - ends)
    known = {"rate": rate, "pair_back": pair_back, "top": (lot, miss, ends), "pairs": None, "times": None}
    if few := several.sum() <= sent_pairs:
        at_hand = pairs.toArrow()
        before, after, times = (at_hand.column(c).to_numpy().astype(np.int64) for c in ("before", "id", "times"))
        by = np.argsort(before * size + after)
        known |= {"pairs": (before * size + after)[by], "times": (times / (on + several)[before])[by]}
    else:
        spark = words.sparkSession
        lots = F.broadcast(spark.createDataFrame(_table(before=np.arange(size), lot=on + several)))
        pairs = pairs.join(lots, "before").select((F.col("before").cast("long") * size + F.col("id")).alias("pair"), (F.col("times") / F.col("lot")).alias("share"))
    whole = learned.filter("before is null").select("word", "n", "path")
    return Spelling(whole, None if few else pairs, words.sparkSession.sparkContext.broadcast(known), sent, size, kind, block), tokens


def _table(**columns: np.ndarray):  # noqa: ANN202
    import pyarrow as pa

    return pa.table(columns)


def lay(shape: Shape, ids: np.ndarray, n: np.ndarray, goes_on: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches, ``n`` ids each, in rows of a hop: inputs, which rows are fresh, what follows each input, and 1 where
    that is a target. The first hop of a stretch that goes on is only seen."""
    hop = shape.hop
    hops, begin = (n + hop - 2) // hop, np.cumsum(n) - n
    first = np.cumsum(hops) - hops
    place = np.arange(len(ids)) + np.repeat(first * hop - begin, n)
    into = np.ones(len(ids), bool)
    into[begin + n - 1] = False
    into = np.flatnonzero(into)  # all but the last are inputs, and what follows each is its target
    inputs, goal = np.full((2, int(hops.sum()) * hop), end, np.int64)
    counted, fresh = np.zeros(len(inputs), np.float32), np.zeros(int(hops.sum()), bool)
    place = place.take(into)
    inputs[place] = ids.take(into)
    goal[place] = ids.take(into + 1)
    counted[place] = 1
    counted.reshape(-1, hop)[first[goes_on]] = 0
    fresh[first] = True
    return inputs.reshape(-1, hop), fresh, goal.reshape(-1, hop), counted.reshape(-1, hop)


def _train(shape: Shape, flat, class_of, end: int, kind: np.dtype, rate: float, batch_rows: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = flat.value.copy()
        m, v, step, seen = np.zeros_like(own), np.zeros_like(own), 0, 0
        classes = class_of.value
        for batch in batches:
            windows, on = batch.column("ids").to_pylist(), batch.column("kind").to_numpy() == GOES_ON
            n = np.array([len(w) // kind.itemsize for w in windows])
            part = np.cumsum((n + shape.hop - 2) // shape.hop) // batch_rows
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if s == e:
                    continue
                ids = np.frombuffer(b"".join(windows[s:e]), kind)
                inputs, fresh, goal, counted = lay(shape, ids, n[s:e], on[s:e], end)
                _, g = hop_gradient(shape, shape.unpack(own), inputs, fresh, classes.take(goal), counted)
                step += 1
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                own -= np.float32(rate / math.sqrt(1 + step / 200) / (1 - 0.9**step)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**step))) + np.float32(1e-8))
            seen += len(n)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([own.astype("<f4").tobytes()])], names=["n", "flat"])

    return run


def _average(batches: Iterator) -> Iterator:
    """One row of a partition's results: their mean, weighted by windows."""
    import pyarrow as pa

    n, total = 0, None
    for batch in batches:
        for k, flat in zip(batch.column("n").to_pylist(), batch.column("flat").to_pylist(), strict=True):
            n, total = n + k, k * np.frombuffer(flat, "<f4").astype(np.float64) + (0 if total is None else total)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(total / n).astype("<f4").tobytes()])], names=["n", "flat"])


def train(stretches: DataFrame, shape: Shape, class_of: np.ndarray, end: int, kind: np.dtype, rounds: int = 3, share: int = 1 << 12, rate: float = 0.02, batch_rows: int = 256) -> np.ndarray:
    """Averaged parameters, each stretch having been in one of the rounds. A round has a trainer for each ``share``
    stretches of its own, so none has more to do as the corpus grows; a trainer's result is under 100 kB, and results are
    averaged 64 at a time on the executors, until no more than 64 are left for the driver. Stretches are dealt by text
    and place, so copies of a text go to different trainers."""
    sc = stretches.sparkSession.sparkContext
    flat, classes = shape.start(), sc.broadcast(class_of)
    if not rounds:
        return flat
    trainers = max(1, stretches.count() // (share * rounds))
    keyed = stretches.select(F.xxhash64("n", "ids").alias("key"), "kind", "ids")
    for k in range(rounds):
        mine = keyed.filter(F.pmod("key", F.lit(rounds)) == k).withColumn("key", F.pmod(F.shiftrightunsigned("key", 20), F.lit(1 << 20)))
        dealt = mine.repartition(trainers, "key").sortWithinPartitions("key", "ids", "kind").select("kind", "ids")
        found, many = dealt.mapInArrow(_train(shape, sc.broadcast(flat), classes, end, kind, rate, batch_rows), "n long, flat binary"), trainers
        while many > 64:
            many = -(-many // 64)
            found = found.repartition(many, F.xxhash64("flat")).mapInArrow(_average, "n long, flat binary")
        got = found.collect()
        if got:
            weight = np.array([r["n"] for r in got], np.float64)
            flat = (np.stack([np.frombuffer(r["flat"], "<f4") for r in got]) * (weight / weight.sum())[:, None]).sum(0).astype(np.float32)
    return flat


def _score(sent, model, top, block: int = 1 << 14):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sub, known, have = subwords(*sent.value), model.value, top.value
        common, scale = have["common"], have["log_scale"]
        end = common.n  # the number of the end, after those of all words
        logs = np.append(have["logs"], math.log10(have["end"] + 1))
        ids, first, direct, back, stop = have["spelled"]
        length = np.diff(first)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

        def done(rows: list) -> pa.RecordBatch:
            spread = Spread([r[-1] for r in rows])
            n = spread.n + 1
            begin = np.cumsum(n) - n
            text = np.repeat(np.arange(len(n)), spread.n)
            w, own = np.full(len(text) + len(n), end), np.arange(len(text)) + text  # each text's end comes after its words
            w[own] = found = common.find(spread)
            rare = np.flatnonzero(found < 0)
            coded, text, rare = spread.names(rare).dictionary_encode(), text[rare], own[rare]
            x, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            their_ids, their_first = sub.spell_names(names)
            w[rare] = end
            at, size, ending, base = first.take(w), length.take(w), stop.take(w), logs.take(w)
            at[rare], size[rare], ending[rare], base[rare] = their_first[x], np.diff(their_first)[x], 0, 0
            place = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
            # places of rare words' subwords, in order of text and word
            by = np.argsort(text * max(1, len(names)) + x, kind="stable")
            of = rare[by]
            other = np.arange(size[of].sum()) + np.repeat((np.cumsum(size) - size)[of] - (np.cumsum(size[of]) - size[of]), size[of])
            mine = place[other]
            place[other] = 0
            own, counted, rest = (c.take(place) for c in (ids, direct, back))
            own[other], counted[other], rest[other] = their_ids[mine], 1, 0  # these are scored where they are looked up
            n_ids = np.add.reduceat(size, begin)
            model_log = known.each(own, n_ids, sub.end)
            each = np.log(counted + rest * np.exp(model_log.astype(np.float64)))
            scores = np.add.reduceat(each, np.cumsum(n_ids) - n_ids) + np.add.reduceat(ending, begin)
            sure = n - np.bincount(text, minlength=len(n))
            base = np.add.reduceat(base, begin) - scale * sure
            pairs, times = np.unique(text * max(1, len(names)) + x, return_counts=True)
            which, whose = pairs % max(1, len(names)), pairs // max(1, len(names))
            model_of = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(times * np.diff(their_first)[which])), pa.int32()), pa.array(model_log.take(other)))
            names = names.cast(pa.binary()).cast(pa.string(), safe=False).take(pa.array(which))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(len(rows) + 1)), pa.int32()), pa.StructArray.from_arrays([names, pa.array(times, pa.int64()), model_of], ["word", "tf", "model"]))
            cols = [*zip(*(r[:3] for r in rows), strict=True), n, sure - (have["end"] == 0), base, scores / math.log(10)]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), lists], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

        for batch in batches:
            rows, much = [], 0
            for row, doc, out, text in rows_of(batch, "row", "doc_id", "held_out"):
                rows.append((row, doc, out, text))
                much += len(text) + 6
                if much >= 6 * block:
                    yield done(rows)
                    rows, much = [], 0
            if rows:
                yield done(rows)

    return run


def score(docs: DataFrame, held_out: Column, ranks: str, pattern: str = PATTERN, shape: Shape = Shape(), top: int = 1 << 18, rounds: int = 3) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. See the module."""
    import pyarrow.compute as pc

    spark = docs.sparkSession
    sc = spark.sparkContext
    with open(ranks, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{ranks} is over {MOST_BYTES} bytes")
    sent = sc.broadcast((data, pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    gathered = rows.select("doc_id", "held_out", "text").mapInArrow(giving_back(_gather(sent, shape.hop, paths=True)), "kind int, word string, n long, ids binary, path binary")
    gathered = materialize(gathered, "lm-gathered", "zstd")
    words = gathered.filter(F.col("kind") == WORD).select("word", "n", "path")
    sub = Subwords(data, pattern)
    spelling, tokens = learn_words(words, sent, sub.size)
    train_docs = gathered.filter(F.col("kind") == TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    tokens[sub.end] = train_docs
    seen = spelling.words.filter("n > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    total, distinct = seen["n"] + train_docs, seen["v"] + (train_docs > 0)
    scale = math.log10(total + distinct + 1)

    starts, stretches = sub.starts, gathered.filter(F.col("kind").isin(BEGINS, GOES_ON)).select("kind", "n", "ids")
    class_of, share = token_classes(tokens, starts, shape, beside(stretches, tokens, starts, sub.kind, shape.hop))
    flat = train(stretches, shape, class_of, sub.end, sub.kind, rounds)
    # words that tasks know the counts and the spelling of beforehand; all others are looked up
    words = materialize(spelling.every(), "lm-spelled", "zstd")
    least = _least(words.filter("n > 0"), "n", top)
    common = words.filter(F.col("n") >= least if least is not None else F.lit(False)).withColumn("word", F.col("word").cast("binary")).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    known, times = Vocabulary(), common.column("n").to_numpy().astype(np.float64)
    names = common.column("word").to_pylist()
    known.put(Spread(names))
    spelled = sub.spell([w.decode("utf-8", "replace") for w in names])
    weights = [pc.list_flatten(common.column(c)).to_numpy() for c in ("direct", "back")]
    spelled = [*(np.append(t, x) for t, x in zip((*spelled, *weights, common.column("stop").to_numpy()), (sub.end, len(spelled[0]) + 1, 0.0, 1.0, 0.0), strict=True))]  # the end is last
    shared = sc.broadcast({"spelled": spelled, "common": known, "logs": np.log10(times + 1), "log_scale": scale, "end": train_docs})
    model = sc.broadcast(Model(shape, flat, class_of, share.astype(np.float32)))
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(giving_back(_score(sent, model, shared)), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word:string,tf:long,model:array<float>>>")
    scored = materialize(scored, "lm-scored", "zstd")
    others = words if least is None else words.filter(F.col("n") < least)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    # a word's model values are those of its occurrences one after another
    each = F.transform("model", lambda m, i: F.log(F.col("direct")[i % F.size("direct")] + F.col("back")[i % F.size("direct")] * F.exp(m.cast("double"))))
    spelled = F.aggregate(each, F.lit(0.0), lambda a, b: a + b) + F.col("tf") * F.col("stop")
    rare = rare.join(others, "word").select("row", "tf", "n", spelled.alias("spelled"))
    rare = rare.groupBy(F.col("row").alias("__row")).agg(F.sum(F.col("tf") * (F.log10(F.col("n") + F.lit(1.0)) - scale)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("found"), (F.sum("spelled") / math.log(10)).alias("spelled"))
    out = scored.drop("rare").join(rare, F.col("row") == F.col("__row"), "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("spelled", F.lit(0.0))).alias("score"))
