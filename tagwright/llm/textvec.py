"""Vectorised word and shingle hashing over the raw UTF-8 buffers of Arrow batches.

A word's hash is a polynomial over its bytes modulo 2**64, taken as a
difference of prefix sums, so that all words of a batch are hashed by a few
numpy passes and no Python object per word exists. Windows of consecutive words
are hashed in the same way over the word hashes. Two independent bases give 128
bits where a hash has to stand for its content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: A batch is cut into parts of about so many bytes of text, to bound memory.
PART_BYTES = 2 << 20
#: Bytes are hashed in slices of about this size, cut between words; tables of powers stay small.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) for b in _BASES)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            grown = []
            for b in (self.base, self.inverse):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                grown.append(np.multiply.accumulate(x))
            self.up, self.down = grown
        return self.up[:n], self.down[:n]


_POWERS = tuple(_Powers(b) for b in _BASES)


def _ranges_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Mixed polynomial hash of each codes[start:end]."""
    up, down = _POWERS[which].get(len(codes) + 1)
    total = np.empty(len(codes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(codes * up[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of consecutive documents.

    first: index of each document's first word, with one more entry for the end.
    hash: 64-bit word hashes; hash2: an independent second one, when asked for.
    """

    def __init__(self, first: np.ndarray, hash1: np.ndarray, hash2: np.ndarray | None):
        self.first, self.hash, self.hash2 = first, hash1, hash2
        self.n_words = np.diff(first)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word index) and documents of all windows of ``size`` words inside one document."""
        per = np.maximum(self.n_words - size + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        ordinal = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        return self.first[:-1][doc] + ordinal, doc

    def range_hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        return _ranges_hash(self.hash if which == 0 else self.hash2, starts, ends, which)


def word_bounds(buf: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[buf]
    before = np.empty(len(buf) + 1, bool)
    before[0], before[1:] = True, space
    after = np.empty(len(buf) + 1, bool)
    after[-1], after[:-1] = True, space
    inner = doc_starts[(doc_starts > 0) & (doc_starts < len(buf))]
    before[inner] = True
    starts = np.flatnonzero(~space & before[:-1])
    cut = after[1:]
    cut = cut.copy()
    cut[inner - 1] = True
    return starts, np.flatnonzero(~space & cut) + 1


def words_of_part(buf: np.ndarray, offsets: np.ndarray, double: bool = False) -> Words:
    """Words of documents buf[offsets[i]:offsets[i+1]], hashed in slices cut at white space."""
    return words_at(buf, *word_bounds(buf, offsets[:-1]), offsets, double)


def words_at(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, offsets: np.ndarray, double: bool = False) -> Words:
    hashes = [bytes_hash(buf, starts, ends, which) for which in range(1 + double)]
    return Words(np.searchsorted(starts, offsets), hashes[0], hashes[1] if double else None)


def bytes_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each buf[start:end]; ascending and disjoint ranges."""
    out, at = [], 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE_BYTES)))
        piece = buf[base : ends[to - 1]]
        out.append(_ranges_hash(_BYTE_CODES[which][piece], starts[at:to] - base, ends[at:to] - base, which))
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parts(texts: pa.Array, part_bytes: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about PART_BYTES of text; NULL is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets_buf, data = texts.buffers()
    offsets = np.frombuffer(offsets_buf, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (part_bytes or PART_BYTES), "right")) - 1)
        yield at, to, buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark longs."""
    return np.ascontiguousarray(x).view(np.int64)
