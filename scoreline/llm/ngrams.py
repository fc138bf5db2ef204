"""Hashed byte n-grams of a run of whole texts."""

from __future__ import annotations

import numpy as np

_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)

#: Bytes with letters lower-cased and every other ASCII byte made a space.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = 0x20
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)

#: Bytes by kind: upper case, lower case and beyond ASCII, digit, white space, or the sign itself.
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[0x30:0x3A] = ord("0")
SHAPES[0x41:0x5B] = ord("A")
SHAPES[0x61:0x7B] = ord("a")
SHAPES[0x80:] = ord("a")
SHAPES[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20


def hashed(data: np.ndarray, n: int, bits: int, seed: int = 0) -> np.ndarray:
    """Feature number of the n-gram that starts at each byte (the last n - 1 have none)."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.int32)
    h = np.full(size, (seed * 0x165667B1 + n * 0x9E3779B9) & 0xFFFFFFFF, np.uint32)
    for j in range(n):
        h += data[j : j + size].astype(np.uint32) * _STEP[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h >> np.uint32(32 - bits)).astype(np.int32)
