"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of the bytes before a word's leading space says so, hence at the same
places in every copy of a passage. Each distinct chunk is encoded once in a task and kept (a least-recently-used
store of bounded bytes); documents are put together from chunks. Every join is then proven: the last word
before and the first word after it are encoded as one text and compared with the tokens at hand; on
disagreement the span grows by words on both sides until the tokens agree or the span is the whole of both
chunks, whose re-encoding then stands.

Why that is exact: pre-tokens are found from left to right without looking back, and a space between two
characters that aren't white space always starts one; so text between two such spaces is encoded alike
wherever it stands.

Two engines read the same vocabulary: the fast one takes texts whose characters all versions of the
pre-token classes agree on (below U+0250, without special-token strings); everything else goes to the
``tokenizers`` library itself. Both files are given by path and sent to the executors (``MOST_BYTES`` bounds
them). Null text is empty; repeated rows are encoded from the store; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordstream import U, giving_back, rows_of

MOST_BYTES = 64 << 20
_SPECIAL = re.compile("<\\|")
_PLAIN = re.compile("[\x00-ɏ]*")
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Whole-text encoding of one vocabulary, and its tokens' bytes."""

    def __init__(self, definition: bytes, ranks: bytes | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(definition.decode())
        self.slow.no_truncation()
        self.slow.no_padding()
        spec = json.loads(definition)
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        size = self.slow.get_vocab_size(with_added_tokens=True)
        alphabet = _byte_of_char()
        self.pieces = [b""] * size
        for token, i in self.slow.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = added[i] if i in added else bytes(alphabet[c] for c in token)
        self.names = [str(i).encode() for i in range(size)]
        self.fast = None
        if ranks is not None:
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and _PLAIN.fullmatch(text) and not _SPECIAL.search(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def cut_points(text: bytes, bits: int, span: int = 8) -> np.ndarray:
    """Places of single spaces between characters that aren't white space, where the hash of the ``span``
    bytes before is zero in its low ``bits`` bits."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) < 2 * span:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at >= span) & (at < len(raw) - 1)]
    black = (raw > 0x20) & (raw < 0x7F)  # ASCII that shows; other characters' classes need no deciding
    at = at[black[at - 1] & black[at + 1]]
    h = np.zeros(len(at), U)
    for k in range(span, 0, -1):
        h = (h + raw[at - k]) * U(0x9E3779B97F4A7C15)
    return at[(h >> U(64 - bits)) == 0]


class Encoder:
    """Encodes texts chunk by chunk; keeps up to ``store`` bytes of chunks and their tokens."""

    def __init__(self, codec: Codec, bits: int = 8, store: int = 48 << 20):
        self.codec, self.bits, self.store = codec, bits, store
        self.kept: OrderedDict[bytes, array] = OrderedDict()  # four bytes a token; a list of ints would take nine times that
        self.held = self.encoded = self.reused = self.repaired = 0

    def chunk(self, text: bytes) -> array:
        key = hashlib.blake2b(text, digest_size=16).digest()
        ids = self.kept.get(key)
        if ids is not None:
            self.kept.move_to_end(key)
            self.reused += 1
            return ids
        ids = array("i", self.codec.encode(text.decode()))
        self.encoded += 1
        self.kept[key] = ids
        self.held += 200 + 8 * len(ids)
        while self.held > self.store and len(self.kept) > 1:
            self.held -= 200 + 8 * len(self.kept.popitem(last=False)[1])
        return ids

    def encode(self, text: bytes) -> list[int]:
        cuts = [0, *cut_points(text, self.bits).tolist(), len(text)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids = self.chunk(text[a:b])
            out = self._join(text, out, ids, a, b) if a else list(ids)
        return out

    def _join(self, text: bytes, left: list[int], right: array, at: int, end: int) -> list[int]:
        """``left`` encodes text[:at], ``right`` text[at:end]; the proven tokens of text[:end]."""
        pieces = self.codec.pieces
        a, b = at, at
        while True:
            a = self._back(text, a)
            b = self._ahead(text, b, end)
            n, i = at - a, len(left)
            while n > 0 and i:
                i -= 1
                n -= len(pieces[left[i]])
            m, j = b - at, 0
            while m > 0 and j < len(right):
                m -= len(pieces[right[j]])
                j += 1
            if n or m:  # the span doesn't fall between tokens: go on
                if a > 0 or b < end:
                    continue
            again = self.codec.encode(text[a:b].decode())
            if again == left[i:] + right[:j].tolist():
                left.extend(right)
                return left
            self.repaired += 1
            if a == 0 and b == end:
                return again

    @staticmethod
    def _back(text: bytes, a: int) -> int:
        while a > 0:
            a = text.rfind(b" ", 0, a)
            if a <= 0:
                return 0
            if 0x20 < text[a - 1] < 0x7F and 0x20 < text[a + 1] < 0x7F:
                return a
        return 0

    @staticmethod
    def _ahead(text: bytes, b: int, end: int) -> int:
        while b < end:
            b = text.find(b" ", b + 1, end)
            if b < 0 or b + 1 >= end:
                return end
            if 0x20 < text[b - 1] < 0x7F and 0x20 < text[b + 1] < 0x7F:
                return b
        return end


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    return data


def encode_decode(docs: DataFrame, definition: str, ranks: str | None = None, with_ids: bool = False, bits: int = 8, store: int = 48 << 20) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded.

    ``definition``: path of the tokenizer's JSON; ``ranks``: path of the same vocabulary as ranks, if any.
    """
    sent = docs.sparkSession.sparkContext.broadcast((_read(definition), _read(ranks) if ranks else None))
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = Encoder(Codec(*sent.value), bits, store)
        codec = encoder.codec
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_ids
        names = [k.split()[0] for k in kinds.split(", ")]
        for batch in batches:
            out, much = [], 0
            for doc, text in rows_of(batch, "doc_id"):
                ids = encoder.encode(text)
                decoded = codec.decode(ids)
                row = (doc, len(ids), hashlib.sha256(b",".join(map(codec.names.__getitem__, ids))).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*row, np.array(ids, np.int32), decoded) if with_ids else row)
                much += with_ids * len(ids)
                if much > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, much = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), kinds)
