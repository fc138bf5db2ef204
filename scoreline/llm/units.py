"""Units of texts that tokenizers treat on their own, each distinct one worked out once.

A unit starts at the text's beginning, and before a space or line feed that follows
neither white space nor U+2581 (which pieces use for a space). A tokenizer whose tokens
never reach across such a place gives a text the tokens of its units, end to end.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .tokens import chunks, mix, text_buffers

_RNG = np.random.default_rng(20240911)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.cumprod(np.full(256, _BASE, dtype=np.uint64))]

# fixed values: the UTF-8 forms of white space beyond ASCII, and of U+2581
_WIDE_SPACES = ["\u0085", " ", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　", "▁"]
_TWO = {tuple(c.encode()) for c in _WIDE_SPACES if len(c.encode()) == 2}
_THREE = {tuple(c.encode()) for c in _WIDE_SPACES if len(c.encode()) == 3}
_LAST = np.zeros(256, bool)
_LAST[[t[-1] for t in _TWO | _THREE]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in texts that lie end to end; empty texts have none."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n:
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[at > 0]
        before = data[at - 1]
        at, before = at[before > 0x20], before[before > 0x20]
        wide = np.flatnonzero(_LAST[before])
        joined = np.zeros(len(at), bool)
        for i in wide.tolist():
            p = int(at[i])
            joined[i] = tuple(data[max(p - 2, 0) : p].tolist()) in _TWO or tuple(data[max(p - 3, 0) : p].tolist()) in _THREE
        cut[at[~joined]] = True
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def unit_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits that stand for the bytes of each unit (from its start to the next one's)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    width = np.diff(starts, append=len(data))
    longest = int(width.max())
    if longest > len(_POWERS[0]):
        _POWERS[0] = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, width)
    return mix(np.add.reduceat(_BYTE[data[starts[0] :]] * _POWERS[0][at], starts - starts[0]) ^ mix(width.astype(np.uint64), 7))


def spaced(column: pa.Array, most: int = 1 << 20):
    """(first row, end row, bytes, offsets) of each chunk of a text column, every text that
    is neither null nor empty with a space in front."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets, most):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        some = at[:-1] < at[1:]
        yield lo, hi, np.insert(part, at[:-1][some], 0x20), at + np.concatenate([[0], np.cumsum(some)])


class Units:
    """The units of a run of texts: ``slots`` (by unit, places in a memory) and ``first``
    (units before each row, n + 1)."""

    def __init__(self, memory: "Memory", data: np.ndarray, offsets: np.ndarray):
        starts = unit_starts(data, offsets)
        keys, one, place = np.unique(unit_hashes(data, starts), return_index=True, return_inverse=True)
        raw = data.tobytes()
        ends = np.append(starts[1:], len(data))
        self.slots = memory.slots(keys, lambda i: raw[starts[one[i]] : ends[one[i]]])[place]
        self.first = np.searchsorted(starts, offsets)

    def totals(self, values: np.ndarray) -> np.ndarray:
        """The sum by row of a value of each unit, given by slot."""
        return np.diff(np.concatenate([[0], np.cumsum(values[self.slots], dtype=np.int64)])[self.first])


class Memory:
    """Slots of distinct units: ``learn`` is given the bytes of new ones, in the order of
    their slots, after ``forget`` has emptied everything if more than ``most`` would be
    held. Slots count up from 0."""

    def __init__(self, learn: Callable[[list[bytes]], None], forget: Callable[[], None], most: int = 1 << 20):
        self.learn, self.forget, self.most = learn, forget, most
        self._empty()

    def _empty(self):
        self.forget()
        self.keys, self.places, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def slots(self, keys: np.ndarray, text_of: Callable[[int], bytes]) -> np.ndarray:
        """The slots of sorted distinct keys; ``text_of(i)`` are the bytes of keys[i]."""
        if len(self.keys) + len(keys) > self.most:
            self._empty()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
        if len(new):
            self.learn([text_of(i) for i in new.tolist()])
            fresh = np.arange(self.used, self.used + len(new))
            self.used += len(new)
            self.places, self.keys = np.insert(self.places, at[new], fresh), np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.places[at]


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.held[: self.n]
