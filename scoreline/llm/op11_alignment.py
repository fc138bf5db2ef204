"""Cross-tokenizer alignment with an associative monoid of fragments.

Two tokenizers cut a text into tokens; byte offsets where tokens of both end cut it into
groups. A byte range of a text, wherever it is cut, knows a fragment: an open prefix (the
tokens up to its first common end), closed groups, and an open suffix (the tokens after
its last common end). Two neighbouring fragments compose: the left suffix and the right
prefix together are one closed group; a fragment without a common end is all prefix
and lengthens its neighbour. Composition is associative, so that fragments of a very long
text are made in any tasks and composed as a tree. Only the open ends travel up the tree;
closed groups stay where they were found and are put in order by their range.

A text of at most ``chunk_bytes`` is one range. Its groups are those of its units (see
``units``), as both tokenizers end a token wherever a unit ends; each distinct unit is
worked out once in a worker process.

The number of documents that hold a pair of ids linked is counted within tasks first. A
second pass looks the commonest pairs up in a table of bounded size and lists the others,
which are joined with all counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved
from .units import Growing, Memory, Units, spaced, unit_starts

#: Bits of the second id in a pair; a row number and a pair share 63 bits.
ID_BITS = 20
#: Pairs in the table that tasks hold (17 bytes each).
FREQUENT = 1 << 20
#: Bytes of a text that is one range, and of the ranges of longer ones.
CHUNK_BYTES = 1 << 16
#: Fragments that a task of the tree composes.
FAN_IN = 16
#: Partial counts that a task holds before it gives them out.
HELD = 1 << 21

_PLAIN = re.compile("[ \n!-~À-ɏ]*[!-~À-ɏ]")


class ByteLevel:
    """Ids of byte-level merges over units. Runs of plain units go to the library as one
    text of ranks, others one by one to the tokenizer itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        split = setup.get("pre_tokenizer") or {}
        if setup.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a byte-level tokenizer that leaves texts as they are")
        # the printable letter of each byte: printable Latin-1 stands for itself, the rest follows from 256 on
        same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        letters = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in same)}
        special = {t["content"] for t in setup.get("added_tokens", [])}
        vocabulary = setup["model"]["vocab"]
        self.bytes = {i: p.encode() if p in special else bytes(letters[c] for c in p) for p, i in vocabulary.items()}
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in setup["model"]["merges"]]
        self.ranks = None
        if [vocabulary.get(m) for m in joined] == list(range(256, 256 + len(joined))):
            # ids are ranks
            ranks = {self.bytes[i]: i for p, i in vocabulary.items() if p not in special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of consecutive runs of units, end to end."""
        plain = [bool(self.ranks and _PLAIN.fullmatch(u)) for u in units]
        out, lo = [], 0
        while lo < len(units):
            hi = lo
            while hi < len(units) and plain[hi] == plain[lo]:
                hi += 1
            if plain[lo]:
                out.append(self.ranks.encode_ordinary("".join(units[lo:hi])))
            else:
                out += [e.ids for e in self.tokenizer.encode_batch(units[lo:hi], add_special_tokens=False)]
            lo = hi
        return out


class Pieces:
    """Ids of a sentencepiece model over units that start with a space or a line feed."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("pieces reach across white space")
        self.space = self.model.piece_to_id("▁")
        self.bytes = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}

    def encode(self, units: list[str]) -> list[list[int]]:
        """The ids of each unit; the model adds the space that a unit starts with."""
        ids = self.model.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [[self.space] if u == " " else i if u[0] == " " else i[1:] for u, i in zip(units, ids, strict=True)]


class Tokens(NamedTuple):
    """Ids of some texts, end to end, with the byte offset of each one's end."""

    ids: np.ndarray
    ends: np.ndarray


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each size, end to end."""
    until = np.cumsum(sizes)
    return np.arange(int(until[-1]) if len(until) else 0) + np.repeat(starts - (until - sizes), sizes)


def _weighed(ids: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, how often) of the distinct ids of each group, by group."""
    keys, n = np.unique((group.astype(np.int64) << ID_BITS) | ids, return_counts=True)
    return keys >> ID_BITS, keys & ((1 << ID_BITS) - 1), n


def link_pairs(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links) of the distinct pairs of ids in each group: an id that a group
    holds several times multiplies its links, not the rows."""
    ga, ia, na = _weighed(a, a_group)
    gb, ib, nb = _weighed(b, b_group)
    many = np.bincount(gb, minlength=groups)
    first = np.cumsum(many) - many
    repeat = many[ga]
    right = _spread(first[ga], repeat)
    return np.repeat(ga, repeat), (np.repeat(ia, repeat) << ID_BITS) | ib[right], np.repeat(na, repeat) * nb[right]


def groups_text(a: list[int], a_sizes: list[int], b: list[int], b_sizes: list[int]) -> list[str]:
    """'a1,a2|b1' of each group."""
    a, b, out, i, j = list(map(str, a)), list(map(str, b)), [], 0, 0
    for n, m in zip(a_sizes, b_sizes, strict=True):
        out.append((a[i] if n == 1 else ",".join(a[i : i + n])) + "|" + (b[j] if m == 1 else ",".join(b[j : j + m])))
        i += n
        j += m
    return out


class Aligner:
    """Tokens, groups and links of distinct units, by slot. Groups never reach across units."""

    def __init__(self, a: str, b: str, most: int = 1 << 19):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.lengths = [np.zeros(max(x.bytes) + 1, np.int64) for x in (self.a, self.b)]
        for lengths, x in zip(self.lengths, (self.a, self.b), strict=True):
            lengths[list(x.bytes)] = [len(v) for v in x.bytes.values()]
        self.age, self.known = 0, None
        self.memory = Memory(self._learn, self._forget, most)

    def _forget(self):
        self.age += 1
        self.valid, self.text = Growing(bool), []
        self.n_a, self.n_b, self.n_groups, self.n_links = Growing(np.int64), Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.ids = Growing(np.int32), Growing(np.int32)
        self.n_pairs, self.pairs, self.links = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.before = [Growing(np.int64), Growing(np.int64), Growing(np.int64)]

    def _tokens(self, tokenizer, lengths: np.ndarray, units: list[bytes]) -> tuple[Tokens, np.ndarray]:
        """Ids of all units, with ends counted from the first unit on, and the units that they spell."""
        runs = tokenizer.encode([u.decode() for u in units])
        size = np.array([len(u) for u in units])
        until = np.cumsum(size)
        ids = np.fromiter((i for run in runs for i in run), np.int64, sum(map(len, runs)))
        spelt = b"".join(map(tokenizer.bytes.__getitem__, ids.tolist()))
        ends = np.cumsum(lengths[ids])
        if spelt == b"".join(units):
            return Tokens(ids, ends), np.ones(len(units), bool)
        # some units aren't what their tokens spell: they are known one by one, and left out
        kept, good = [], np.zeros(len(units), bool)
        for i, unit in enumerate(units):
            own = [x for run in tokenizer.encode([unit.decode()]) for x in run]
            good[i] = b"".join(map(tokenizer.bytes.__getitem__, own)) == unit
            own = np.array(own if good[i] else [], np.int64)
            kept.append(Tokens(own, until[i] - size[i] + np.cumsum(lengths[own])))
        return Tokens(np.concatenate([t.ids for t in kept]), np.concatenate([t.ends for t in kept])), good

    def _learn(self, units: list[bytes]):
        (a, valid_a), (b, valid_b) = (self._tokens(t, n, units) for t, n in zip((self.a, self.b), self.lengths, strict=True))
        valid = valid_a & valid_b
        until = np.cumsum([len(u) for u in units])
        if not valid.all():
            a, b = (Tokens(t.ids[k], t.ends[k]) for t in (a, b) for k in [valid[np.searchsorted(until, t.ends)]])
        common = np.intersect1d(a.ends, b.ends)
        groups = [np.searchsorted(common, t.ends) for t in (a, b)]
        sizes = [np.bincount(g, minlength=len(common)) for g in groups]
        unit = np.searchsorted(until, common)
        text = groups_text(a.ids.tolist(), sizes[0].tolist(), b.ids.tolist(), sizes[1].tolist())
        n_groups = np.bincount(unit, minlength=len(units))
        at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
        self.text += [";".join(text[lo:hi]).encode() for lo, hi in zip(at, at[1:])]
        group, pair, links = link_pairs(a.ids, groups[0], b.ids, groups[1], len(common))
        # a unit's links of one pair are added up
        keys = unit[group]
        order = np.lexsort((pair, keys))
        keys, pair, links = keys[order], pair[order], links[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1) | np.diff(pair, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        links = np.add.reduceat(links, new) if len(new) else links
        n_pairs = np.bincount(keys[new], minlength=len(units))
        counts = [np.bincount(np.searchsorted(until, t.ends), minlength=len(units)) for t in (a, b)]
        for held, values, n in zip(self.before, (*self.ids, self.pairs), (*counts, n_pairs), strict=True):
            held.add(values.n + np.cumsum(n) - n)
        for held, values in ((self.valid, valid), (self.n_a, counts[0]), (self.n_b, counts[1]), (self.n_groups, n_groups), (self.n_pairs, n_pairs), (self.pairs, pair[new]), (self.links, links), (self.ids[0], a.ids), (self.ids[1], b.ids)):
            held.add(values)
        total = np.concatenate([[0], np.cumsum(links)])
        last = np.cumsum(n_pairs)
        self.n_links.add(total[last] - total[last - n_pairs])

    def units(self, data: np.ndarray, offsets: np.ndarray) -> Units:
        return Units(self.memory, data, offsets)

    def tokens(self, units: Units) -> tuple[Tokens, Tokens]:
        """Both tokenizers' tokens of all rows of ``units``, valid or not."""
        out = []
        for which, n in enumerate((self.n_a, self.n_b)):
            ids = self.ids[which].values[_spread(self.before[which].values[units.slots], n.values[units.slots])].astype(np.int64)
            out.append(Tokens(ids, np.cumsum(self.lengths[which][ids])))
        return out[0], out[1]

    def valid_rows(self, units: Units) -> np.ndarray:
        """Rows that have units, all of them spelt by their tokens."""
        bad = np.concatenate([[0], np.cumsum(~self.valid.values[units.slots])])[units.first]
        return (np.diff(bad) == 0) & (np.diff(units.first) > 0)

    def row_pairs(self, units: Units, rows: np.ndarray, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, links) of the distinct pairs of each row that ``rows`` marks, of
        the units' pairs that ``pick`` marks."""
        row = np.repeat(np.arange(len(rows)), np.diff(units.first))
        keep = rows[row]
        keys, times = np.unique((row[keep].astype(np.int64) << 32) | units.slots[keep], return_counts=True)
        row, slot = keys >> 32, keys & 0xFFFFFFFF
        size = self.n_pairs.values[slot]
        at = _spread(self.before[2].values[slot], size)
        row, times = np.repeat(row, size), np.repeat(times, size)
        if pick is not None:
            some = pick[at]
            at, row, times = at[some], row[some], times[some]
        # rows of a chunk are few enough to share 63 bits with a pair
        keys = (row << (2 * ID_BITS)) | self.pairs.values[at]
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], (times * self.links.values[at])[order]
        new = np.flatnonzero(np.diff(keys, prepend=-1)) if len(keys) else np.zeros(0, np.int64)
        keys = keys[new]
        return keys >> (2 * ID_BITS), keys & ((1 << 2 * ID_BITS) - 1), np.add.reduceat(weight, new) if len(new) else weight

    def scored(self, table: dict[str, np.ndarray], name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By slot, the best links and the sum of counts over the pairs of ``table`` (sorted
        ``pair``, ``n``, ``best``); by unit's pair, whether the table lacks it."""
        if self.known is None or self.known[0] != (self.age, name):
            self.known = ((self.age, name), Growing(np.int64), Growing(np.int64), Growing(bool))
        _, best, total, rare = self.known
        if best.n < self.memory.used:
            lo = rare.n
            pair, links = self.pairs.values[lo:], self.links.values[lo:]
            at = np.minimum(np.searchsorted(table["pair"], pair), max(len(table["pair"]) - 1, 0))
            found = table["pair"][at] == pair if len(table["pair"]) else np.zeros(len(pair), bool)
            n = np.where(found, table["n"][at], 0) if len(found) and len(table["n"]) else np.zeros(len(pair), np.int64)
            top = np.where(found, table["best"][at], False) if len(found) and len(table["n"]) else np.zeros(len(pair), bool)
            last = np.cumsum(self.n_pairs.values[best.n :])
            first = last - self.n_pairs.values[best.n :]
            for held, value in ((best, links * top), (total, links * n)):
                sums = np.concatenate([[0], np.cumsum(value)])
                held.add(sums[last] - sums[first])
            rare.add(~found)
        return best.values, total.values, rare.values


_KNOWN: dict[tuple[str, str], Aligner] = {}


def _aligner(a: str, b: str) -> Aligner:
    return _KNOWN.get((a, b)) or _KNOWN.setdefault((a, b), Aligner(a, b))


class Counts:
    """Documents by pair, added up in a task."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, pairs: np.ndarray) -> None:
        pairs, n = np.unique(pairs, return_counts=True)
        self.parts.append((pairs, n))
        self.n += len(pairs)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        pairs, place = np.unique(pairs, return_inverse=True)
        n = np.bincount(place, n, len(pairs)).astype(np.int64)
        self.parts, self.n = [(pairs, n)], len(pairs)
        return pairs, n

    def taken(self, most: int):
        """What to give out once more than ``most`` pairs are held, even when added up."""
        if self.n > 2 * most and len(self.merged()[0]) > most:
            out = self.parts[0]
            self.parts, self.n = [], 0
            return out
        return None


def _pair_batch(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])


def _count_short(a: str, b: str, held: int):
    """mapInArrow: (pair, n), the documents of a task that hold a pair."""
    def run(batches):
        own, counts = _aligner(a, b), Counts()
        for batch in batches:
            for _, _, data, offsets in spaced(batch.column("text")):
                units = own.units(data, offsets)
                counts.add(own.row_pairs(units, own.valid_rows(units))[1])
                if (full := counts.taken(held)) is not None:
                    yield _pair_batch(*full)
        yield _pair_batch(*counts.merged())

    return run


_SCORED = pa.schema([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("rare", pa.list_(pa.int64())), ("rare_links", pa.list_(pa.int64()))])
_SCORED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, rare array<long>, rare_links array<long>"


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1))), pa.array(values)).cast(pa.list_(pa.int64()))


def _score_short(a: str, b: str, table, name: str, with_groups: bool):
    """mapInArrow: the result's columns of each text, and its pairs that ``table`` lacks."""
    def run(batches):
        own = _aligner(a, b)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in spaced(batch.column("text")):
                units = own.units(data, offsets)
                valid = own.valid_rows(units)
                best, total, rare = own.scored(table.value, name)
                columns = [np.where(valid, units.totals(x), 0) for x in (own.n_a.values, own.n_b.values, own.n_groups.values, own.n_links.values, best, total)]
                slots, texts = units.slots.tolist(), []
                for r, ok in enumerate(valid.tolist()):
                    texts.append(b";".join([own.text[s] for s in slots[units.first[r] : units.first[r + 1]]]) if ok else b"")
                sha = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
                row, pair, links = own.row_pairs(units, valid, rare)
                shown = pa.array([t.decode() for t in texts], pa.string()) if with_groups else pa.nulls(hi - lo, pa.string())
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *map(pa.array, columns), pa.array(sha, pa.string()), shown, _lists(row, pair, hi - lo), _lists(row, links, hi - lo)], schema=_SCORED)

    return run


def byte_ranges(data: np.ndarray, starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of ``most`` bytes, cut anywhere; a range that would end inside a unit of more
    than ``most`` bytes reaches to that unit's end, so that no range has half of a long one."""
    ends, out, lo = np.append(starts[1:], len(data)), [], 0
    while lo < len(data):
        hi = min(lo + most, len(data))
        unit = int(np.searchsorted(starts, hi - 1, "right")) - 1
        if ends[unit] - starts[unit] > most:
            hi = int(ends[unit])
        out.append((lo, hi))
        lo = hi
    return out


def _split_long(most: int):
    """mapInArrow: the byte ranges of each text: key, chunk, skip, size, window (the whole
    units that the range touches; ``skip`` bytes of it lie before the range)."""
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("skip", pa.int64()), ("size", pa.int64()), ("window", pa.string())])

    def run(batches):
        for batch in batches:
            for lo, _, data, offsets in spaced(batch.column("text"), 1):
                starts = unit_starts(data, offsets)
                ends, raw, key = np.append(starts[1:], len(data)), data.tobytes(), batch.column("key")[lo].as_py()
                for chunk, (x, y) in enumerate(byte_ranges(data, starts, most)):
                    first, last = starts[np.searchsorted(starts, x, "right") - 1], ends[np.searchsorted(starts, y - 1, "right") - 1]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, chunk, x - int(first), y - x, raw[first:last].decode()), schema.types, strict=True)], schema=schema)

    return run


_IDS = pa.list_(pa.int32())
_FRAGMENT = pa.schema([
    ("key", pa.int64()), ("chunk", pa.int64()), ("valid", pa.bool_()), ("closes", pa.int64()), ("head_a", _IDS), ("head_b", _IDS), ("tail_a", _IDS), ("tail_b", _IDS),
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("text", pa.string())])
_FRAGMENT_DDL = "key long, chunk long, valid boolean, closes long, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, n_a long, n_b long, n_groups long, pairs array<long>, links array<long>, text string"
_ENDS = ["key", "chunk", "closes", "head_a", "head_b", "tail_a", "tail_b"]


def closed_groups(a: Tokens, b: Tokens, common: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, str]:
    """(number, distinct pairs, their links, text) of the groups that end at ``common``."""
    groups = [np.searchsorted(common, t.ends) for t in (a, b)]
    sizes = [np.bincount(g, minlength=len(common)).tolist() for g in groups]
    _, pair, links = link_pairs(a.ids, groups[0], b.ids, groups[1], len(common))
    pair, place = np.unique(pair, return_inverse=True)
    return len(common), pair, np.bincount(place, links, len(pair)).astype(np.int64), ";".join(groups_text(a.ids.tolist(), sizes[0], b.ids.tolist(), sizes[1]))


def fragment(a: Tokens, b: Tokens, lo: int, hi: int) -> tuple:
    """The fragment of the byte range (lo, hi] of a window: a token belongs to the range that
    its end lies in. (open prefix, closed groups' tokens and ends, open suffix, whether
    there is a common end)."""
    a, b = (Tokens(t.ids[k], t.ends[k]) for t in (a, b) for k in [(t.ends > lo) & (t.ends <= hi)])
    common = np.intersect1d(a.ends, b.ends)
    if not len(common):
        return (a.ids, b.ids), (a, b, common), (a.ids[:0], b.ids[:0]), False
    head = tuple(t.ids[t.ends <= common[0]] for t in (a, b))
    tail = tuple(t.ids[t.ends > common[-1]] for t in (a, b))
    inner = [Tokens(t.ids[k], t.ends[k]) for t in (a, b) for k in [(t.ends > common[0]) & (t.ends <= common[-1])]]
    return head, (*inner, common[1:]), tail, True


def _fragments(a: str, b: str):
    """mapInArrow: the fragment of each byte range."""
    def run(batches):
        own = _aligner(a, b)
        for batch in batches:
            for key, chunk, skip, size, window in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                data = np.frombuffer(window.encode(), np.uint8)
                units = own.units(data, np.array([0, len(data)]))
                valid = bool(own.valid_rows(units)[0])
                left, right = own.tokens(units)
                none = Tokens(left.ids[:0], left.ends[:0])
                head, (in_a, in_b, common), tail, closed = fragment(left, right, skip, skip + size) if valid else fragment(none, none, 0, 0)
                n, pairs, links, text = closed_groups(in_a, in_b, common) if closed else (0, none.ids, none.ids, "")
                n_a, n_b = (int(((t.ends > skip) & (t.ends <= skip + size)).sum()) for t in (left, right))
                row = (key, chunk, valid, chunk if closed else None, *head, *tail, n_a, n_b, n, pairs, links, text)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _FRAGMENT.types, strict=True)], schema=_FRAGMENT)

    return run


class Ends(NamedTuple):
    """A fragment without its closed groups: ``closes`` is the range in which the prefix
    ends, None if there is no common end (then all tokens are prefix)."""

    closes: int | None
    head: tuple[list[int], list[int]]
    tail: tuple[list[int], list[int]]


def compose(x: Ends, y: Ends) -> tuple[Ends, tuple | None]:
    """The fragment of two neighbours, and the group that closes between them, if any:
    (range in which it ends, ids of either tokenizer)."""
    join = lambda p, q: (p[0] + q[0], p[1] + q[1])
    if x.closes is None:
        return Ends(y.closes, join(x.head, y.head), y.tail), None
    if y.closes is None:
        return Ends(x.closes, x.head, join(x.tail, y.head)), None
    return Ends(x.closes, x.head, y.tail), (y.closes, *join(x.tail, y.head))


def _compose_block(fan_in: int):
    """applyInPandas: composes the fragments of a block (rows without ``joint``) and gives
    the groups that closed (rows with it)."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("chunk")
        key, block, out, held = int(frame["key"].iloc[0]), int(frame["chunk"].iloc[0]) // fan_in, [], None
        for closes, head_a, head_b, tail_a, tail_b in zip(*[frame[c] for c in _ENDS[2:]], strict=True):
            one = Ends(None if pd.isna(closes) else int(closes), (list(head_a), list(head_b)), (list(tail_a), list(tail_b)))
            held, joint = compose(held, one) if held is not None else (one, None)
            if joint:
                out.append((key, joint[0], None, joint[1], joint[2], [], [], True))
        out.append((key, block, held.closes, *held.head, *held.tail, False))
        out = pd.DataFrame(out, columns=[*_ENDS, "joint"])
        out["closes"] = out["closes"].astype("Int64")
        return out

    return run


def _joint_rows():
    """mapInArrow: composed groups as rows of the layout of closed ones."""
    schema = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("n_groups", pa.int64()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64())), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for key, chunk, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                left, right = (Tokens(np.array(x, np.int64), np.ones(len(x), np.int64)) for x in (a, b))
                n, pairs, links, text = closed_groups(left, right, np.ones(1, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((key, chunk, n, pairs, links, text), schema.types, strict=True)], schema=schema)

    return run


def compose_tree(ends: DataFrame, chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """(key, chunk, a, b): the groups that close between ranges, of all texts, with the
    range that each ends in. ``ends`` has a row for each range, ``chunks`` is the largest
    number of ranges of a text; every level composes ``fan_in`` neighbours in a task."""
    ddl = "key long, chunk long, closes long, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, joint boolean"
    joints, level = [], ends
    while True:
        level = saved(level.withColumn("block", F.expr(f"chunk div {fan_in}")).groupBy("key", "block").applyInPandas(_drop_block(_compose_block(fan_in)), ddl), "composed")
        joints.append(level.where("joint").select("key", "chunk", F.col("head_a").alias("a"), F.col("head_b").alias("b")))
        level, chunks = level.where("NOT joint").select(*_ENDS), -(-chunks // fan_in)
        if chunks <= 1:
            break
    # nothing lies before a text's first group
    joints.append(level.where("closes IS NOT NULL").select("key", F.col("closes").alias("chunk"), F.col("head_a").alias("a"), F.col("head_b").alias("b")))
    return reduce(DataFrame.unionByName, joints)


def _drop_block(run):
    return lambda frame: run(frame.drop(columns="block"))


def _digest(with_groups: bool):
    """mapInArrow over rows in order of key, chunk and part: sha256 of each key's texts,
    joined by ';', as a stream."""
    schema = pa.schema([("key", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string())])

    def row(key, state, texts):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()]), pa.array([";".join(texts) if with_groups else None], pa.string())], schema=schema)

    def run(batches):
        now, state, texts = None, None, []
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != now:
                    if state:
                        yield row(now, state, texts)
                    now, state, texts = key, hashlib.sha256(text.encode()), [text]
                else:
                    state.update(b";" + text.encode())
                    texts += [text] if with_groups else []
        if state:
            yield row(now, state, texts)

    return run


def _long_texts(rows: DataFrame, a: str, b: str, chunk_bytes: int, fan_in: int, with_groups: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of texts of more than ``chunk_bytes``: (key, doc_id) of each row, (key, pair, links)
    of the distinct pairs of each text, and (key, n_a, n_b, n_groups, groups_sha256,
    groups) of each text that has tokens."""
    spark = rows.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = rows.where(F.octet_length("text") > chunk_bytes).select("doc_id", F.xxhash64("text").alias("key"), "text")
    ranges = long.select("key", "text").mapInArrow(_split_long(chunk_bytes), "key long, chunk long, skip long, size long, window string")
    # equal texts are worked out once
    ranges = ranges.groupBy("key", "chunk").agg(F.min(F.struct("skip", "size", "window")).alias("x")).select("key", "chunk", "x.*").repartition(spread, "key", "chunk")
    found = saved(ranges.mapInArrow(_fragments(a, b), _FRAGMENT_DDL), "fragments")
    good = found.groupBy("key").agg(F.bool_and("valid").alias("good"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.max("chunk").alias("last"))
    good = saved(good.where("good").drop("good"), "long")
    found = found.join(good.select("key"), "key", "left_semi")
    most = good.agg(F.max("last")).first()[0]
    joints = compose_tree(found.select(*_ENDS), (most or 0) + 1, fan_in)
    joints = saved(joints.mapInArrow(_joint_rows(), "key long, chunk long, n_groups long, pairs array<long>, links array<long>, text string"), "joints")
    # in a range, the group that began before it comes first
    closed = joints.select("*", F.lit(0).alias("part")).unionByName(found.where("n_groups > 0").select("key", "chunk", "n_groups", "pairs", "links", "text", F.lit(1).alias("part")))
    pairs = closed.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("x")).groupBy("key", F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("links"))
    digests = closed.select("key", "chunk", "part", "text").repartition(spread, "key").sortWithinPartitions("key", "chunk", "part").select("key", "text").mapInArrow(_digest(with_groups), "key long, groups_sha256 string, groups string")
    whole = good.drop("last").join(closed.groupBy("key").agg(F.sum("n_groups").alias("n_groups")), "key").join(digests, "key")
    return long.select("key", "doc_id"), saved(pairs, "longpairs"), saved(whole, "longtexts")


def _frequent(counts: DataFrame, most: int) -> dict[str, np.ndarray]:
    """The pairs that most documents hold, whole levels of counts down to where ``most``
    pairs would be passed, sorted by pair."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["level"], r["size"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("size")).collect()), reverse=True)
    total, least = 0, None
    for at, size in sizes:
        if total + size > most:
            break
        total, least = total + size, at
    if least is None:
        return {"pair": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "best": np.zeros(0, bool)}
    held = counts.where(level >= least).select("pair", "n", "best").toArrow()
    order = np.argsort(held["pair"].to_numpy(), kind="stable")
    return {c: held[c].to_numpy()[order] for c in ("pair", "n", "best")}


def align_tokenizers(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN, frequent: int = FREQUENT, held: int = HELD, with_groups: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256; ``groups`` ('a1,a2|b1;a3|b2,b3') is null unless ``with_groups``.

    ``a`` is a file of byte-level merges, ``b`` a sentencepiece model that all executors
    have. Texts are read with a space in front (``b`` adds its own). Links are all pairs
    of token occurrences of a group; a pair of ids counts the documents of the whole
    table that hold it linked. ``n_best`` are the links whose count is the highest of
    their first id (ties included), ``count_sum`` adds the counts of all links.

    Null and empty texts, and those that the tokens of ``a`` or ``b`` don't spell, have zeros, an
    empty groups_sha256, and count nowhere. Texts of more than ``chunk_bytes`` bytes are
    cut into ranges that different tasks work on. Repeated rows and null ids stay rows of
    their own, and repeated rows count as documents of their own. Other columns are not
    read. An empty table has no rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    short = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk_bytes)
    long, long_pairs, long_texts = _long_texts(rows, a, b, chunk_bytes, fan_in, with_groups)
    copies = long.groupBy("key").agg(F.count("*").alias("copies"))
    counts = short.mapInArrow(_count_short(a, b, held), "pair long, n long")
    counts = counts.unionByName(long_pairs.join(copies, "key").groupBy("pair").agg(F.sum("copies").alias("n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    # an id has at most as many partners as the other vocabulary has entries
    first = Window.partitionBy(F.shiftright("pair", ID_BITS))
    counts = saved(saved(counts, "counts").withColumn("best", F.col("n") == F.max("n").over(first)), "pairs")

    table = _frequent(counts, frequent)
    name = hashlib.sha256(table["pair"].tobytes() + table["n"].tobytes()).hexdigest()
    scored = short.mapInArrow(_score_short(a, b, spark.sparkContext.broadcast(table), name, with_groups), _SCORED_DDL)
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_links")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_links").alias("links"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum")]
    rest = rest.join(counts, "pair").groupBy("row").agg(*sums)
    done = scored.join(rest, "row", "left")
    done = done.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))

    linked = long_pairs.join(counts, "pair").groupBy("key").agg(*sums, F.sum("links").alias("n_links"))
    linked = long_texts.join(linked, "key").withColumnsRenamed({"more_best": "n_best", "more_sum": "count_sum"})
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    more = long.join(linked, "key", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), "groups")
    return done.select(more.columns).unionByName(more)
