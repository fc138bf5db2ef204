"""Subword ids with the tokenizers library, each distinct part of a word encoded once.

A word (a run without white space) takes the library's whole path only if it has to:
if the tokenizer lower-cases, splits by the pattern below and maps bytes to letters, then
a word of printable ASCII and plain Latin letters is split here, and its parts go
straight to the library's model. Parts repeat far more often than words.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np

from .tokens import Words, distinct, mix, span_hashes

# fixed values: the pre-tokenizer's pattern and the normalizers this shortcut stands for
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

_LATIN = [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", c.lower()) == c.lower() and c not in "İŉſ"]
_LETTERS = "a-z" + "".join(sorted({c.lower() for c in _LATIN if 0xC0 <= ord(c.lower()) < 0x180}))
_PLAIN = re.compile(rf"[!-~{''.join(_LATIN)}]+")
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")


# by byte: 1 letters (also of two bytes), 2 digits, 3 other signs, 0 what plain words lack
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1
_KIND[0x80:0xC0] = _KIND[0xC3:0xC6] = 1
_PAIRS = np.zeros((256, 256), bool)
for _c in _LATIN:
    _PAIRS[tuple(_c.encode())] = True


def part_spans(data: np.ndarray, words: Words, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word, whether a whole word) of the parts of all words. Words that the
    shortcut doesn't cover, and with ``split`` false all words, are one part each."""
    n = len(data)
    if not split or not len(words.starts):
        return words.starts, words.ends, np.arange(len(words.starts)), np.ones(len(words.starts), bool)
    kind = _KIND[data]
    high = data >= 0x80
    odd = kind == 0
    odd[:-1] |= (data[:-1] >= 0xC0) & ~_PAIRS[data[:-1], data[1:]]
    odd[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & ~_PAIRS[data[:-1], data[1:]]
    odd[n - 1 :] |= high[n - 1 :] & (data[n - 1 :] >= 0xC0)
    odd[:1] |= high[:1] & (data[:1] < 0xC0)
    odd |= data == 0x27
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    total = np.concatenate([[0], np.cumsum(odd)])
    whole = total[words.ends] > total[words.starts]
    begins = np.zeros(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begins &= kind > 0
    width = (words.ends - words.starts)[whole]
    begins[np.repeat(words.starts[whole] - np.cumsum(width) + width, width) + np.arange(int(width.sum()))] = False
    begins[words.starts] = True
    starts = np.flatnonzero(begins)
    word = np.searchsorted(words.starts, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], n), words.ends[word])
    return starts, ends, word, whole[word]


def _capitals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of where each span has A-Z, which other hashes fold; 0 without any."""
    width = ends - starts
    begin = np.cumsum(width) - width
    at = np.arange(int(width.sum())) - np.repeat(begin, width)
    byte = data[np.repeat(starts, width) + at]
    return np.add.reduceat(np.where((byte >= 0x41) & (byte <= 0x5A), mix(at.astype(np.uint64), 5), np.uint64(0)), begin)


class WordEncoder:
    """Ids of words for one tokenizer file; parts of words are remembered up to ``most``."""

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        kinds = [x.get("type") for x in (setup.get("normalizer") or {}).get("normalizers", [])]
        steps = (setup.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.short = (
            kinds == _NORMALIZERS and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _PATTERN and steps[0].get("invert") is True
            and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex", True)
            and not setup["model"].get("dropout") and all(t["content"].startswith("<|") for t in setup.get("added_tokens", []))
        )
        if self.short:
            level = self.tokenizer.pre_tokenizer
            self.bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in _LETTERS[3:]}

    def _part(self, part: str) -> tuple[int, ...]:
        ids = self.known.get(part)
        if ids is None:
            if len(self.known) >= self.most:
                self.known.clear()
            ids = self.known[part] = tuple([t.id for t in self.tokenizer.model.tokenize(part.translate(self.bytes))])
        return ids

    def encode(self, words: list[str]) -> list[list[int] | tuple[int, ...]]:
        """The ids of each word, as the tokenizer gives them for a text of that word alone."""
        out: list = [None] * len(words)
        rest, plain, split, part = [], _PLAIN.fullmatch, _PARTS.findall, self._part
        for i, w in enumerate(words):
            if self.short and "<|" not in w and plain(w):
                parts = split(w.lower())
                out[i] = part(parts[0]) if len(parts) == 1 else [t for p in parts for t in part(p)]
            else:
                rest.append(i)
        for lo in range(0, len(rest), 4096):
            some = rest[lo : lo + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out


class PartIds:
    """Ids of the parts of whole texts, kept by part hash in sorted arrays. Beyond ``most``
    parts the memory is emptied; parts are then encoded anew."""

    def __init__(self, path: str, most: int = 1 << 21):
        self.words, self.most = WordEncoder(path, most=1 << 12), most
        self.vocabulary = self.words.vocabulary
        self._empty()

    def _empty(self):
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.sizes, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 16, np.uint32), 0

    def _slots(self, keys: np.ndarray, text_of) -> np.ndarray:
        """Slots of sorted distinct hashes; ``text_of(i)`` is the text of keys[i]."""
        if len(self.keys) + len(keys) > self.most:
            self._empty()
        at = np.searchsorted(self.keys, keys)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys)) if len(self.keys) else np.arange(len(keys))
        if len(new):
            found = self.words.encode([text_of(i) for i in new.tolist()])
            sizes = np.array([len(x) for x in found], np.int32)
            flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            slots = np.arange(len(self.sizes), len(self.sizes) + len(new), dtype=np.int32)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.used += len(flat)
            self.slots, self.keys = np.insert(self.slots, at[new], slots), np.insert(self.keys, at[new], keys[new])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at]

    def ids_of(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, end to end, and their offsets by row (n + 1)."""
        starts, ends, word, whole = part_spans(data, words, self.words.short)
        keys = span_hashes(data, starts)
        if whole.any():
            # the library may tell cases apart in what it reads whole, such as special tokens
            capitals = _capitals(data, starts[whole], ends[whole])
            keys[whole] = np.where(capitals > 0, mix(keys[whole] ^ capitals, 9), keys[whole])
        keys, place = distinct(keys)
        one = np.empty(len(keys), np.int64)
        one[place] = np.arange(len(place))
        raw = data.tobytes()
        slots = self._slots(keys, lambda i: raw[starts[one[i]] : ends[one[i]]].decode())[place]
        sizes = self.sizes[slots].astype(np.int64)
        until = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[slots] - until[:-1], sizes) + np.arange(until[-1])]
        return ids, until[np.searchsorted(word, words.first)]


_KNOWN: dict[str, PartIds] = {}


def part_ids(path: str) -> PartIds:
    """One for each worker process, so that tasks share what it knows."""
    if path not in _KNOWN:
        _KNOWN[path] = PartIds(path)
    return _KNOWN[path]
