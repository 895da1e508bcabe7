"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII
characters, after lower-casing. In SQL that is
``regexp_extract_all(lower(text), '([a-z0-9]|[^\\x00-\\x7F])+')``.

Nulls count as empty texts. All arrays of one batch are flat; ``doc_words``
holds the word range of each text. Nothing here loops over words in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BYTE_VALUE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of text that one pass of the kernel takes; bounds its memory (about 60 bytes of arrays for each).
PASS_BYTES = 1 << 20


def powers(base: U64, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i in [0, n)."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, base, dtype=np.uint64)
        step[0] = 1
        have = _POWERS[int(base)] = np.multiply.accumulate(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@dataclass
class Words:
    """Words of a batch of texts."""

    data: np.ndarray  # lower-cased UTF-8 bytes of all texts
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    hashes: np.ndarray  # 64-bit hash of each word
    doc_bytes: np.ndarray  # n + 1 byte offsets
    doc_words: np.ndarray  # n + 1 word offsets

    @property
    def n_docs(self) -> int:
        return len(self.doc_words) - 1

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.doc_words))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, valid) of the k-gram that starts at each word; invalid where it leaves its text."""
        h, n = self.hashes, len(self.hashes)
        valid = np.zeros(n, dtype=bool)
        out = np.zeros(n, dtype=np.uint64)
        if n < k:
            return out, valid
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * powers(_BASE, n), out=sums[1:])
        m = n - k + 1
        out[:m] = mix((sums[k:] - sums[:m]) * powers(_BASE_INV, m))
        end = np.repeat(self.doc_words[1:], np.diff(self.doc_words))
        valid[:] = np.arange(n) + k <= end
        return out, valid


def column(texts: pa.Array | pa.ChunkedArray | list) -> pa.Array:
    """One large-string array with empty strings for nulls."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a large-string array without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, off - off[0]


def passes(texts: pa.Array, limit: int = PASS_BYTES):
    """Cut an array into (first row, slice) runs of about ``limit`` bytes; a longer text stays whole."""
    _, off = raw_bytes(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def split(texts: pa.Array | list) -> Words:
    """Words of the texts, with their hashes."""
    lower = pc.utf8_lower(column(texts))
    data, off = raw_bytes(lower)
    n = len(data)
    is_word = _WORD_BYTE[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = is_word[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = is_word[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    # the byte before an empty text ends the text before it, which is already marked
    ends = np.flatnonzero(is_word & ~after) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers(_BASE_INV, n + 1)[starts])
    return Words(data, starts, ends, hashes, off, np.searchsorted(starts, off))


_ANY_WORD_BYTE = _WORD_BYTE.copy()
_ANY_WORD_BYTE[65:91] = True


def count(texts: pa.Array) -> np.ndarray:
    """Number of words of each text."""
    data, off = raw_bytes(column(texts))
    is_word = _ANY_WORD_BYTE[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    at = off[:-1]
    at = at[at < len(data)]
    first[at] = is_word[at]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(first, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]
