"""Vectorised word and shingle hashing over Arrow text columns.

Words are maximal runs outside bytes 0x20 and 0x09-0x0D after lower-casing A-Z;
a word is known by a 64-bit hash of its UTF-8 bytes. All functions take whole
texts: a chunk is a run of whole documents, never a part of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.cumprod(np.full(256, _BASE, dtype=np.uint64))]
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    h = h ^ np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, sorted, and where each value is among them, as ``np.unique`` has
    them: by hashing, so that only the distinct ones are sorted."""
    coded = pa.array(values).dictionary_encode()
    found = coded.dictionary.to_numpy()
    order = np.argsort(found)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return found[order], place[coded.indices.to_numpy()]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and their n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most ``most`` bytes, or hold one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _values(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """From the first start on, each byte's value times a power for its place in its span;
    spans reach to the next start, white space counts nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    width = np.diff(starts, append=len(data))
    longest = int(width.max())
    if longest > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, width)
    return _BYTE[data[starts[0] :]] * _POWERS[0][at]


def span_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each span from a start to the next or to white space."""
    return mix(np.add.reduceat(_values(data, starts), starts - starts[0])) if len(starts) else np.zeros(0, np.uint64)


class Words:
    """The words of a run of documents: ``starts`` and ``ends`` (byte positions),
    ``hashes``, ``doc`` (row of each word) and ``first`` (words before each row)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), between: np.ndarray = _SPACE):
        """``between``: by byte, whether it separates words. ``prefixes``: lengths in
        bytes; ``prefix_hashes`` then has, for each, a hash of the first so many bytes
        of each word (0 for shorter words)."""
        n, rows = len(data), len(offsets) - 1
        space = between[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        before[:1] = True
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[n - 1 : n] = True
        after[:-1] = space[1:]
        self.ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, offsets)
        self.rows = rows
        value = _values(data, self.starts)
        if between is not _SPACE and len(value):
            value[space[self.starts[0] :]] = 0
        begin = self.starts - self.starts[:1].sum()
        self.hashes = mix(np.add.reduceat(value, begin)) if len(begin) else np.zeros(0, np.uint64)
        self.prefix_hashes = []
        if prefixes:
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value, out=total[1:])
            wide = self.ends - self.starts
            for size in prefixes:
                part = total[np.minimum(begin + size, len(value))] - total[begin]
                self.prefix_hashes.append(np.where(wide >= size, mix(part, size), np.uint64(0)))

    def counts(self) -> np.ndarray:
        """Words of each row."""
        return np.diff(self.first)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of one document's ``k``-word shingles, in order, repeats kept; with
    fewer words the whole sequence is one shingle, without words there is none."""
    if not len(hashes):
        return hashes
    width = min(k, len(hashes))
    out = np.zeros(len(hashes) - width + 1, np.uint64)
    for j in range(width):
        out += hashes[j : len(hashes) - width + 1 + j] * _STEP[j]
    return mix(out, width)


def word_chunks(column: pa.Array, most: int = 1 << 19, **how) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    """(first row, end row, bytes, offsets, words) of each chunk of a text column."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets, most):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, part, at, Words(part, at, **how)


def word_hash(word: str, between: np.ndarray = _SPACE) -> int:
    """The hash that ``Words`` gives to ``word``."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)]), between=between).hashes[0])
