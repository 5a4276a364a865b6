"""Vectorised words: many texts in one byte buffer, words and word windows as 64-bit hashes.

A block of texts becomes one buffer in which separators are zero; word bounds come from a look-up table and
hashes from prefix sums of a polynomial modulo 2**64, so a window of any length costs one subtraction.
Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
#: Bytes of texts that most scans take at once: the temporary arrays are a hundred times that.
BLOCK = 1 << 18
_grown: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Byte -> 1 in a word. Separators are space and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Byte -> 1 in a word of ASCII digits, letters and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Byte -> byte with A-Z lowered.
LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept while n grows."""
    have = _grown.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _grown[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


class Words:
    """Words of a block of texts: ``starts``, ``ends`` (byte bounds), ``hashes``, ``doc`` (index in the block),
    ``first`` (index of each text's first word; one more entry at the end)."""

    def __init__(self, texts: list[bytes], wordy: np.ndarray = SPACED, lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        if lower:
            self.data = self.data.translate(LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[1:] = wordy[raw]
        edge = np.diff(inside)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        salted = mix(raw.astype(U) + U(1))
        self.hashes = mix(_spans(salted, self.starts, self.ends, _BASE) + (self.ends - self.starts).astype(U))
        self.bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index of the start, hash) of every run of k words within one text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, self.hash_at(at, k)

    def hash_at(self, at: np.ndarray, k: int) -> np.ndarray:
        return mix(_spans(self.hashes, at, at + k, _STEP) + U(k))

    def second_at(self, at: np.ndarray, k: int) -> np.ndarray:
        """As ``hash_at``, by hashes of other bases throughout: 128 bits with it."""
        if not hasattr(self, "_other"):
            salted = mix(np.frombuffer(self.data, np.uint8).astype(U) + U(0x51ED270B))
            self._other = mix(_spans(salted, self.starts, self.ends, _STEP) + (self.ends - self.starts).astype(U))
        return mix(_spans(self._other, at, at + k, _BASE) + U(k))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]]


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the runs [a, a + k)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return np.cumsum(step[:-1]) > 0


def blocks(rows: Iterable[tuple], size: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows whose last field is bytes, in lists of about ``size`` bytes; one long row is a list of its own."""
    held, much = [], 0
    for row in rows:
        held.append(row)
        much += len(row[-1])
        if much >= size:
            yield held
            held, much = [], 0
    if held:
        yield held


def rows_of(batch, *names: str, text: str = "text", step: int = 512) -> Iterator[tuple]:
    """Tuples of the named columns of an Arrow batch, the text last, as UTF-8 bytes (null: empty). ``step`` rows at a
    time become Python objects, so that the batch isn't held twice."""
    import pyarrow as pa

    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        cols = [part.column(n).to_pylist() for n in names]
        body = part.column(text).cast(pa.binary()).to_pylist()
        for *row, t in zip(*cols, body, strict=True):
            yield (*row, t or b"")


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, and what its allocators keep would
    be added to what the next operator needs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def giving_back(run):
    """An Arrow function that calls ``give_back`` when its task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped
