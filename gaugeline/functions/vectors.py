"""Small numpy kernels behind the vectorised UDFs: substrings, MinHash, resampling."""

from __future__ import annotations

import hashlib

import numpy as np

MERSENNE = (1 << 61) - 1


def longest_common_substring(a: str, b: str) -> int:
    """Length of the longest common substring; one vector update for each character of the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    x, y = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (a, b))
    run, best = np.zeros(len(y) + 1, np.int32), 0
    for c in x:
        run[1:] = np.where(y == c, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def lcs_ratio(query: str, passage: str) -> float:
    """Longest common substring of the lowered texts over the length of the query as given."""
    return longest_common_substring(query.lower(), passage.lower()) / len(query) if query else 0.0


def char_grams(text: str, n: int = 5) -> set[str]:
    """Distinct n-character strings of the lowered text; all of it if it has no more than n; none if empty."""
    t = text.lower()
    return {t[i : i + n] for i in range(max(1, len(t) - n + 1))} if t else set()


def char_jaccard(a: str, b: str, n: int = 5) -> float:
    """Jaccard similarity of the texts' n-character strings; 0 if either is empty."""
    x, y = char_grams(a, n), char_grams(b, n)
    return len(x & y) / len(x | y) if x and y else 0.0


def shingle_hash(s: str) -> int:
    """The first four bytes of BLAKE2b, big-endian."""
    return int.from_bytes(hashlib.blake2b(s.encode(), digest_size=4).digest(), "big")


class MinHash:
    """``size`` permutations (x * a + b, wrapping at 64 bits) mod (2**61 - 1); an empty set is all 2**32 - 1."""

    def __init__(self, size: int = 128, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, MERSENNE, size=size, dtype=np.uint64)
        self.b = rng.integers(0, MERSENNE, size=size, dtype=np.uint64)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.full(len(self.a), (1 << 32) - 1, np.uint64)
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(hashes), 4096):
            x = hashes[s : s + 4096].astype(np.uint64)
            out = np.minimum(out, ((np.outer(x, self.a) + self.b) % np.uint64(MERSENNE)).min(0))
        return out


def bands_for(size: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) with bands * rows = size whose threshold (1/bands)**(1/rows) is nearest; first wins."""
    fits = [(b, size // b) for b in range(1, size + 1) if size % b == 0]
    return min(fits, key=lambda f: abs((1 / f[0]) ** (1 / f[1]) - threshold))


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1; ties share their average."""
    _, which, times = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(times)
    return ((last - times + 1 + last) / 2)[which]


def _interval(draws: np.ndarray, confidence: float) -> tuple[float, float]:
    tail = (1 - confidence) / 2
    lo, hi = np.quantile(draws, [tail, 1 - tail])
    return float(lo), float(hi)


def _resampled_means(rng: np.random.Generator, x: np.ndarray, times: int) -> np.ndarray:
    """One (times, n) draw, taken in slices of bounded size: the same numbers."""
    n = len(x)
    per = max(1, (1 << 22) // n)
    return np.concatenate([x[rng.integers(0, n, size=(min(per, times - s), n))].mean(1) for s in range(0, times, per)])


def bootstrap_mean(x: np.ndarray, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Mean and percentile interval; no values: zeros; one: that value."""
    if len(x) < 2:
        m = float(x[0]) if len(x) else 0.0
        return m, m, m
    return float(x.mean()), *_interval(_resampled_means(np.random.default_rng(seed), x, times), confidence)


def _p_value(draws: np.ndarray, observed: float) -> float:
    return float((np.count_nonzero(np.abs(draws - observed) >= abs(observed)) + 1) / (len(draws) + 1))


def bootstrap_paired(d: np.ndarray, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float, float]:
    """Mean difference, interval, p-value of paired differences; fewer than two: p = 1."""
    if len(d) < 2:
        m = float(d.mean()) if len(d) else 0.0
        return m, m, m, 1.0
    draws, m = _resampled_means(np.random.default_rng(seed), d, times), float(d.mean())
    return m, *_interval(draws, confidence), _p_value(draws, m)


def bootstrap_unpaired(a: np.ndarray, b: np.ndarray, times: int = 10_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float, float]:
    """mean(a) - mean(b) with independent resamples of one generator, a's first."""
    if not len(a) or not len(b):
        raise ValueError("both groups need values")
    rng = np.random.default_rng(seed)
    first = _resampled_means(rng, a, times)
    draws, m = first - _resampled_means(rng, b, times), float(a.mean() - b.mean())
    return m, *_interval(draws, confidence), _p_value(draws, m)


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    rx, ry = average_ranks(x), average_ranks(y)
    if len(x) < 3 or rx.std() == 0 or ry.std() == 0:
        return 0.0
    return float(np.corrcoef(rx, ry)[0, 1])


def spearman_interval(x: np.ndarray, y: np.ndarray, times: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """Rank correlation with a 95% interval; ranks are taken anew in each resample."""
    if len(x) < 3:
        return 0.0, 0.0, 0.0
    rng, n = np.random.default_rng(seed), len(x)
    draws = np.array([spearman(x[i], y[i]) for i in (rng.integers(0, n, size=n) for _ in range(times))])
    return spearman(x, y), *_interval(draws, 0.95)
