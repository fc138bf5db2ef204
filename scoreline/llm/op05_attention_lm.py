"""Language-model scores from a causal self-attention model over subword ids.

The model reads a text's subword ids with one layer of masked self-attention and
predicts the class of the next id; ids share a class by the company they keep, frequent
ids and the end of a text have one of their own. Within a class, ids are told apart by
corpus counts of pairs of neighbouring ids, smoothed by the ids' own counts. Long texts are read in overlapping windows: each window scores its
last half and has the half before as context, so every id is scored once.

Nothing is learned from a sample: the classes and the first weights come from counts over
all training texts, then all tasks train the weights in rounds, each text in one of them.

Words are counted over all training texts for the base score. The most frequent words
(a table of bounded size) go to the tasks; the others are joined with the counts. Pairs of
ids are treated alike, so every pair of the training texts counts in the score.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PartIds, WordEncoder, part_ids
from .storage import saved
from .tokens import distinct, word_chunks

#: Positions that a window scores and that it sees before; width of the model; classes;
#: rows of the embedding.
SCORED, WIDTH, CLASSES, BUCKETS = 16, 16, 32, 4096
#: Passes of a fit on texts at hand; rounds that the training texts are dealt to and the
#: first one's rate; ids that a task holds at once while it trains.
EPOCHS = 4
ROUNDS, ROUND_RATE, HELD_IDS = 4, 0.02, 1_000_000
#: Ids that the tasks' table of pairs tells apart; pairs in it at most, the commonest (the
#: others are joined); weight of the ids' own counts in the shares after an id.
RANKS, FREQUENT_PAIRS, SMOOTH = 4096, 1 << 19, 5.0
#: Words whose counts are sent to the tasks at most.
FREQUENT_WORDS = 1 << 18
#: Blocks at a time, so that what is worked out for them stays in a core's own memory.
PART = 256
PAD = 0
_FAR = -1e4
_ROOT, _ONES = np.float32(1 / np.sqrt(WIDTH)), np.ones(CLASSES, np.float32)
_EIGHT = np.ones((1, 8), np.float32)


def _chunks(column: pa.Array, parts: PartIds):
    """(first row, end row, words, distinct hashes, their place for each word, ids, their
    offsets by row) of each chunk."""
    for lo, hi, data, _, words in word_chunks(column, 1 << 20):
        keys, place = distinct(words.hashes)
        yield lo, hi, words, keys, place, *parts.ids_of(data, words)


def _count(tokenizer: str):
    """mapInArrow over (text): counts of words (kind 0: key, n), of ids (kind 1), of texts
    (kind 2) and of pairs of neighbouring ids (kind 3; the end stands before and after), and
    the ids of each text (kind 4: ids)."""
    names = ["kind", "key", "n", "ids"]

    def rows(kind, keys, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.nulls(len(keys), pa.binary())], names=names)

    def run(batches):
        pieces = part_ids(tokenizer)
        ids, texts, held, size, pairs, n_pairs = np.zeros(pieces.vocabulary, np.int64), 0, [], 0, [], 0
        for batch in batches:
            texts += batch.num_rows
            for lo, hi, _, keys, place, own, first in _chunks(batch.column("text"), pieces):
                none = pa.nulls(hi - lo, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, 4, np.int32)), none, none, _packed(own, first, pieces.vocabulary)], names=names)
                if not len(keys):
                    continue
                n = np.bincount(place, minlength=len(keys))
                ids += np.bincount(own, minlength=len(ids))
                line = np.insert(own.astype(np.int64), np.append(0, first[1:]), pieces.vocabulary)
                found, often = np.unique(line[:-1] * (pieces.vocabulary + 1) + line[1:], return_counts=True)
                pairs.append((found, often))
                n_pairs += len(found)
                if n_pairs >= 1 << 21:
                    pairs = [_merged(pairs)]
                    n_pairs = len(pairs[0][0])
                    if n_pairs >= 1 << 20:
                        yield rows(3, *pairs[0])
                        pairs, n_pairs = [], 0
                held.append((keys, n))
                size += len(keys)
                if size >= 1 << 20:
                    keys, n = _merged(held)
                    held, size = [(keys, n)], len(keys)
                    if size >= 1 << 19:
                        yield rows(0, keys.view(np.int64), n)
                        held, size = [], 0
        if held:
            keys, n = _merged(held)
            yield rows(0, keys.view(np.int64), n)
        if pairs:
            yield rows(3, *_merged(pairs))
        seen = np.flatnonzero(ids)
        yield rows(1, seen, ids[seen])
        yield rows(2, np.zeros(1, np.int64), np.array([texts]))

    return run


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _packed(ids: np.ndarray, first: np.ndarray, vocabulary: int) -> pa.Array:
    """The ids of each text as bytes."""
    data = ids.astype(_id_type(vocabulary))
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer((first * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _encode(tokenizer: str):
    """mapInArrow over (text): the ids of each text."""
    def run(batches):
        parts = part_ids(tokenizer)
        for batch in batches:
            for *_, ids, first in _chunks(batch.column("text"), parts):
                yield pa.RecordBatch.from_arrays([_packed(ids, first, parts.vocabulary)], names=["ids"])

    return run


def _merged(held: list) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)


@dataclass
class AttentionModel:
    """``bucket``, ``group`` and ``rank`` of each id (the last id is the end), log10 shares
    within groups, and tables by bucket: queries, keys, values and direct class scores.
    ``pair`` has the log10 share of an id after an id, by rank, for the most frequent ids,
    ``listed`` whether it includes the count of the pair; ``back`` has what shares of ids of a
    group are lowered by after an id that others of the group were seen after."""

    bucket: np.ndarray
    group: np.ndarray
    share: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    direct: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    rank: np.ndarray
    pair: np.ndarray
    back: np.ndarray
    listed: np.ndarray
    weights: dict  # what the tables are made of, by name

    def with_pairs(self, counts: np.ndarray, keys: np.ndarray, n: np.ndarray, mass: np.ndarray | None = None) -> AttentionModel:
        """The model with shares within groups that depend on the id before: ``keys`` are
        before * number of ids + id, ``mass`` the counts of all pairs by id before and group;
        without it those given are all. Per id before and group the shares sum to 1, once
        ``unlisted`` pairs have got their ``gain``."""
        ids = len(self.bucket)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(ids, np.int32)
        rank[order] = np.arange(1, ids + 1)
        if mass is None:
            mass = np.zeros((ids, CLASSES))
            np.add.at(mass, (keys // ids, self.group[keys % ids]), n)
        back = np.zeros((ids + 1, CLASSES), np.float32)
        back[rank] = np.log10(SMOOTH / (mass + SMOOTH))
        size = min(RANKS, ids + 1)
        own, group = np.full(size, -30, np.float32), np.zeros(size, np.int64)
        own[1:], group[1:] = self.share[order[: size - 1]], self.group[order[: size - 1]]
        pair, listed = np.empty((size, size), np.float16), np.zeros((size, size), bool)
        for lo in range(0, size, 256):
            pair[lo : lo + 256] = back[lo : min(lo + 256, size), group] + own
        kept = (rank[keys // ids] < size) & (rank[keys % ids] < size)
        keys, n = keys[kept], n[kept]
        before, after = rank[keys // ids], rank[keys % ids]
        pair[before, after] = np.log10((n + SMOOTH * 10.0 ** own[after]) / (mass[keys // ids, group[after]] + SMOOTH))
        listed[before, after] = True
        return replace(self, rank=rank, pair=pair, back=back, listed=listed)

    def gain(self, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a pair's count ``n`` adds to the log10 share of its second id, which doesn't
        depend on other pairs."""
        return np.log10(1 + n / (SMOOTH * 10 ** self.share[after].astype(np.float64)))

    def _before(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first[:-1][np.diff(first) > 0]] = len(self.bucket) - 1
        return before

    def within(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 shares of the ids of each text within their groups, summed; without the
        gains of unlisted pairs."""
        a, b = self.rank[self._before(ids, first)], self.rank[ids]
        near = (a < len(self.pair)) & (b < len(self.pair))
        log = self.share[ids] + self.back[a, self.group[ids]]
        log[near] = self.pair[a[near], b[near]]
        return np.diff(np.concatenate([[0], np.cumsum(log, dtype=np.float64)])[first])

    def unlisted(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the pairs in the texts whose counts are not at hand, and their offsets by text."""
        before = self._before(ids, first)
        a, b = self.rank[before], self.rank[ids]
        known = (a < len(self.pair)) & (b < len(self.pair))
        known[known] = self.listed[a[known], b[known]]
        edge = np.concatenate([[0], np.cumsum(~known)])[first]
        return before[~known].astype(np.int64) * len(self.bucket) + ids[~known], edge

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each text: ``ids`` end to end, ``first`` their n + 1 offsets.
        The end of each text is scored, too."""
        read, want, begin = _laid(self.bucket, ids, first)
        total = len(read) // SCORED
        out = np.zeros(total * SCORED, np.float32)
        room = _Room()
        for lo in range(1, total, PART):
            hi = min(lo + PART, total)
            out[lo * SCORED : hi * SCORED] = self._blocks(read[(lo - 1) * SCORED : hi * SCORED], want[lo * SCORED : hi * SCORED], room)
        sums = np.add.reduceat(out.astype(np.float64), begin * SCORED) if len(begin) else np.zeros(0)
        return sums + self.within(ids, first)

    def _blocks(self, read: np.ndarray, want: np.ndarray, room: _Room) -> np.ndarray:
        """log10 probabilities of the groups of ``want`` by blocks; ``read`` has one block
        more, in front."""
        *_, z = _attend((self.query, self.key, self.value), self.bias, self.out, self.direct, read, room)
        own = z[np.arange(len(z)), self.group[want]]
        p = (own - np.log(np.exp(z, out=z) @ _ONES)) * np.float32(1 / np.log(10))
        return np.where(want >= 0, p, 0)


class _Room:
    """Float32 arrays by name that are used again at each step: fresh ones of this size cost
    more in page faults than what is computed in them."""

    def __init__(self):
        self.held, self.most = {}, np.zeros(0, np.float32)

    def limited(self, x: np.ndarray) -> np.ndarray:
        """``x``, at most 30, in place. An array of limits takes a third of the time of one number."""
        if self.most.size < x.size:
            self.most = np.full(x.size, 30, np.float32)
        return np.minimum(x, self.most[: x.size].reshape(x.shape), out=x)

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    def rows(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return table.take(at, axis=0, out=self(name, *at.shape, table.shape[1]), mode="clip")


def _windows(rows: np.ndarray) -> np.ndarray:
    """Each block of rows but the first, with the one before it; a view."""
    n, step = len(rows) // SCORED - 1, rows.strides[0]
    return np.lib.stride_tricks.as_strided(rows, (max(0, n), 2 * SCORED, rows.shape[1]), (SCORED * step, step, rows.strides[1]), writeable=False)


def _attend(tables, bias: np.ndarray, out: np.ndarray, direct: np.ndarray, read: np.ndarray, room: _Room) -> tuple:
    """(queries, keys, values, weights, weighted sums, those over the sum of weights, class
    scores) of the blocks but the first of ``read``; valid until the next call."""
    read = read.astype(np.intp, copy=False)
    n, own = len(read) // SCORED - 1, read[SCORED:]
    q = room.rows("q", tables[0], own).reshape(n, SCORED, -1)
    k, v = _windows(room.rows("k", tables[1], read)), _windows(room.rows("v", tables[2], read))
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", n, SCORED, 2 * SCORED))
    a += bias
    np.exp(room.limited(a), out=a)
    # the last column of the values is 1: it sums the weights
    c = np.matmul(a, v, out=room("c", n, SCORED, v.shape[2])).reshape(n * SCORED, -1)
    np.maximum(c[:, -1], np.float32(1e-30), out=c[:, -1])
    h = np.divide(c[:, :-1], c[:, -1:], out=room("h", len(c), WIDTH))
    z = np.matmul(h, out, out=room("z", len(c), CLASSES))
    z += room.rows("d", direct, own)
    return q, k, v, a, c, h, room.limited(z)


def _laid(bucket: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets read, ids wanted or -1, first block of each text) by position. Each text is a
    block of padding, then a start sign and its ids, filled up to whole blocks."""
    n, end = np.diff(first), len(bucket) - 1
    blocks = n // SCORED + 1
    begin = np.cumsum(blocks + 1) - blocks - 1
    total = int((blocks + 1).sum())
    read = np.full(total * SCORED, PAD, np.int64)
    want = np.full(total * SCORED, -1, np.int64)
    at = np.arange(len(ids)) - np.repeat(first[:-1], n) + np.repeat((begin + 1) * SCORED, n)
    want[at] = ids
    want[(begin + 1) * SCORED + n] = end
    read[at + 1] = bucket[ids]
    read[(begin + 1) * SCORED] = bucket[end]
    return read, want, begin


def _places(counts: np.ndarray) -> np.ndarray:
    """Where an id stands among the neighbours that classes are told apart by: the most
    frequent ids have a place each, the others share one."""
    alone = CLASSES // 2
    place = np.full(len(counts), alone, np.int64)
    place[np.argsort(-counts[:-1], kind="stable")[:alone]] = np.arange(min(alone, len(counts) - 1))
    return place


def _company(place: np.ndarray, keys: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
    """Add the counts of pairs to ``total``, by id and by what stands before or after it."""
    ids, wide = len(place), CLASSES // 2 + 1
    np.add.at(total, keys % ids * 2 * wide + place[keys // ids], n)
    np.add.at(total, keys // ids * 2 * wide + wide + place[keys % ids], n)


def _companies(place: np.ndarray):
    """mapInArrow over pairs (key, n): ``_company`` of a task, a row for each cell."""
    def run(batches):
        total = np.zeros(len(place) * (CLASSES + 2), np.int64)
        for batch in batches:
            _company(place, *(batch.column(c).to_numpy(zero_copy_only=False) for c in range(2)), total)
        seen = np.flatnonzero(total)
        for lo in range(0, len(seen), 1 << 16):
            some = seen[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    return run


def _groups(counts: np.ndarray, context: np.ndarray, rng) -> np.ndarray:
    """Class of each id: frequent ones their own, the others by k-means on what comes
    before and after them (``context``); the end (last) its own; unseen ids one class."""
    v, alone = len(counts) - 1, CLASSES // 2
    top = np.argsort(-counts[:v], kind="stable")[:alone]
    seen = np.setdiff1d(np.flatnonzero(context[:v].sum(axis=1)), top)
    group = np.full(v + 1, CLASSES - 2, np.int64)
    group[v] = CLASSES - 1
    group[top] = np.arange(len(top))
    k = CLASSES - 2 - alone
    if len(seen) > k:
        x = context[seen].astype(float)
        weight = counts[seen].astype(float) + 1
        x = np.sqrt((x + 0.1 * x.sum(axis=0) / max(1.0, x.sum())) / (x.sum(axis=1, keepdims=True) + 0.1))
        centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
        for _ in range(12):
            near = (np.sum(centre**2, axis=1) - 2 * x @ centre.T).argmin(axis=1)
            for g in range(k):
                if (near == g).any():
                    centre[g] = np.average(x[near == g], axis=0, weights=weight[near == g])
        group[seen] = alone + near
    elif len(seen):
        group[seen] = alone + np.arange(len(seen))
    return group


def start_attention(counts: np.ndarray, context: np.ndarray, seed: int = 0) -> AttentionModel:
    """The model before training, of the ``counts`` of all ids (the end's last) and of the
    counts of what comes before and after each."""
    rng = np.random.default_rng(seed)
    group = _groups(counts, context, rng)
    # buckets: 0 is padding, frequent ids have one each, the others share by their number
    bucket = 1 + (np.arange(len(counts)) * 2654435761 % (BUCKETS // 4 - 1))
    order = np.argsort(-counts, kind="stable")[: BUCKETS - BUCKETS // 4]
    bucket[order] = BUCKETS // 4 + np.arange(len(order))
    smooth = counts + 0.5
    share = np.log10(smooth / np.bincount(group, smooth, CLASSES)[group]).astype(np.float32)
    scale = 0.3
    w = {"e": rng.normal(0, scale, (BUCKETS, WIDTH)), "q": rng.normal(0, scale, (WIDTH, WIDTH)), "k": rng.normal(0, scale, (WIDTH, WIDTH)), "v": rng.normal(0, scale, (WIDTH, WIDTH)), "o": rng.normal(0, scale, (WIDTH, CLASSES)), "r": np.zeros(2 * SCORED), "d": np.zeros((BUCKETS, CLASSES))}
    w["d"][:] = _class_logs(counts, group)
    return _tables(w, bucket, group, share)


def _class_logs(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    mass = np.bincount(group, counts + 0.5, CLASSES)
    return np.log(np.maximum(mass / mass.sum(), 1e-9))


def follow_counts(model: AttentionModel, counts: np.ndarray, mass: np.ndarray) -> AttentionModel:
    """The model with direct class scores from ``mass``, the counts of pairs by id before and
    group of the id after."""
    follow = np.zeros((BUCKETS, CLASSES))
    np.add.at(follow, model.bucket, mass)
    start = _class_logs(counts, model.group)
    direct = np.log((follow + 5 * np.exp(start)) / (follow.sum(axis=1, keepdims=True) + 5))
    return _tables({**model.weights, "d": direct}, model.bucket, model.group, model.share)


def train_attention(sample: list[np.ndarray], counts: np.ndarray, texts: int, seed: int = 0) -> AttentionModel:
    """Fit the model on texts at hand by Adam; ``counts`` are of all ids in all training
    texts, ``texts`` their number. Works without texts, too."""
    counts = np.append(counts, texts).astype(np.int64)
    ids, context = len(counts), np.zeros(len(counts) * (CLASSES + 2), np.int64)
    flat = np.concatenate([[ids - 1], *(np.append(x, ids - 1) for x in sample)])
    keys, n = np.unique(flat[:-1] * ids + flat[1:], return_counts=True)
    _company(_places(counts), keys, n, context)
    model = start_attention(counts, context.reshape(ids, -1), seed)
    if not sample:
        return model
    mass = np.zeros((ids, CLASSES))
    np.add.at(mass, (keys // ids, model.group[keys % ids]), n)
    model = follow_counts(model, counts, mass)
    w = {n: x.copy() for n, x in model.weights.items()}
    _adam(w, model.bucket, model.group, sample, np.random.default_rng(seed), EPOCHS, 0.01, 0.0)
    return _tables(w, model.bucket, model.group, model.share)


def _tables(w: dict, bucket: np.ndarray, group: np.ndarray, share: np.ndarray) -> AttentionModel:
    """The model of weights ``w``, without pairs."""
    w = {n: x.astype(np.float32) for n, x in w.items()}
    return AttentionModel(bucket, group, share, *_projected(w), w["d"], w["o"], _bias(w), np.ones(len(bucket), np.int32), np.zeros((1, 1), np.float16), np.zeros((2, CLASSES), np.float32), np.zeros((1, 1), bool), w)


def _projected(w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys and values by bucket, the values with a column of 1 to sum the weights.
    Padding has no values, so that it counts in no sum."""
    v = np.hstack([w["e"] @ w["v"], np.ones((BUCKETS, 1), np.float32)])
    v[PAD] = 0
    return w["e"] @ (w["q"] * _ROOT), w["e"] @ w["k"], v


def _bias(w: dict) -> np.ndarray:
    lag, causal = _lags()
    return np.where(causal, w["r"][np.maximum(lag, 0)], _FAR).astype(np.float32)


def _lags() -> tuple[np.ndarray, np.ndarray]:
    """How far before each scored position each read one lies, and whether it does."""
    lag = np.arange(SCORED)[:, None] + SCORED - np.arange(2 * SCORED)[None]
    return lag, lag >= 0


def _gradients(w: dict, read: np.ndarray, group: np.ndarray, real: np.ndarray, room: _Room) -> dict:
    """Gradients of the mean cross entropy of the ``real`` positions of neighbouring blocks;
    ``read`` has one block more, in front. They are valid until the next call."""
    n, weight = len(group) // SCORED, (real / max(1, real.sum())).astype(np.float32)
    tables, bias = _projected(w), _bias(w)
    total = room("total", BUCKETS, 3 * WIDTH + CLASSES)
    total[:] = 0
    do, dr = np.zeros_like(w["o"]), np.zeros((SCORED, 2 * SCORED), np.float32)
    for lo in range(0, n, PART):
        hi = min(lo + PART, n)
        at = slice(lo * SCORED, hi * SCORED)
        q, k, v, a, c, h, z = _attend(tables, bias, w["o"], w["d"], read[lo * SCORED : (hi + 1) * SCORED], room)
        np.exp(z, out=z)
        z *= (weight[at] / (z @ _ONES))[:, None]
        z[np.arange(len(z)), group[at]] -= weight[at]
        do += h.T @ z
        # the last column brings in what weights lose to each other, as that of the values is 1
        dc = room("dc", len(z), WIDTH + 1)
        np.divide(np.matmul(z, w["o"].T, out=room("dh", len(z), WIDTH)), c[:, -1:], out=dc[:, :-1])
        np.negative(np.einsum("ij,ij->i", dc[:, :-1], h), out=dc[:, -1])
        dc = dc.reshape(hi - lo, SCORED, -1)
        da = np.matmul(dc, v.transpose(0, 2, 1), out=room("da", *a.shape))
        da *= a
        dr += da.sum(axis=0)
        both = room("both", hi - lo, 2 * SCORED, 2 * WIDTH)
        np.matmul(da.transpose(0, 2, 1), q, out=both[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), dc[:, :, :-1], out=both[:, :, WIDTH:])
        # by position: keys, values, queries and classes; a block is read by itself and by the next
        # one, the last row stays empty
        rows = room("rows", (hi - lo + 1) * SCORED + 1, total.shape[1])
        rows[:SCORED] = rows[-1] = 0
        blocks = rows[:-1].reshape(hi - lo + 1, SCORED, -1)
        blocks[1:, :, : 2 * WIDTH] = both[:, SCORED:]
        blocks[:-1, :, : 2 * WIDTH] += both[:, :SCORED]
        np.matmul(da, k, out=blocks[1:, :, 2 * WIDTH : 3 * WIDTH])
        rows[SCORED:-1, 3 * WIDTH :] = z
        _add_rows(total, rows, read[lo * SCORED : (hi + 1) * SCORED], room)
    dk, dv, dq = total[:, :WIDTH], total[:, WIDTH : 2 * WIDTH], total[:, 2 * WIDTH : 3 * WIDTH] * _ROOT
    dv[PAD] = 0
    lag, causal = _lags()
    return {
        "e": dq @ w["q"].T + dk @ w["k"].T + dv @ w["v"].T, "q": w["e"].T @ dq, "k": w["e"].T @ dk, "v": w["e"].T @ dv, "o": do,
        "r": np.bincount(np.maximum(lag, 0).ravel(), (dr * causal).ravel(), 2 * SCORED).astype(np.float32), "d": total[:, 3 * WIDTH :],
    }


def _add_rows(total: np.ndarray, rows: np.ndarray, bucket: np.ndarray, room: _Room) -> None:
    """Add ``rows`` to ``total`` by bucket; the last row is empty. Rows of a bucket are added
    by eights, filled up with it, before ``reduceat``, which is slow on wide rows."""
    n = np.bincount(bucket, minlength=BUCKETS)
    seen = np.flatnonzero(n)
    n = n[seen]
    eights = -(-n // 8)
    first = np.cumsum(eights) - eights
    order = np.argsort(bucket, kind="stable")
    at = np.full(int(eights.sum()) * 8, len(bucket))
    at[np.arange(len(order)) + np.repeat(first * 8 - np.cumsum(n) + n, n)] = order
    some = room.rows("sorted", rows, at).reshape(-1, 8, rows.shape[1])
    sums = np.matmul(_EIGHT, some, out=room("eights", len(some), 1, rows.shape[1]))[:, 0]
    total[seen] += sums[first]
    more = eights > 1
    if more.any():
        # all eights but the first of a bucket
        rest = np.delete(sums, first, axis=0)
        total[seen[more]] += np.add.reduceat(rest, (first - np.arange(len(first)))[more], axis=0)


def _adam(w, bucket, groups, sample, rng, epochs: int, rate: float, last: float, held: dict | None = None) -> int:
    """Adam over the ``sample`` texts in random order; the rate goes from ``rate`` to ``last``.
    Updates ``w`` in place, and in ``held`` what the next call goes on from; the number of
    blocks."""
    held = {} if held is None else held
    if not held:
        held.update(m={n: np.zeros_like(x) for n, x in w.items()}, s={n: np.zeros_like(x) for n, x in w.items()}, step=0, room=_Room())
    m, s, room = held["m"], held["s"], held["room"]
    total = 0
    for epoch in range(epochs):
        texts = [sample[i] for i in rng.permutation(len(sample))]
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        read, want, _ = _laid(bucket, np.concatenate(texts), first)
        # the compact type sorts faster
        read, real, group = read.astype(np.int16), want >= 0, np.where(want >= 0, groups[want], 0)
        blocks = len(read) // SCORED
        batch = min(1024, max(32, blocks // 64))
        for lo in range(1, blocks, batch):
            hi = min(lo + batch, blocks)
            at = slice(lo * SCORED, hi * SCORED)
            g = _gradients(w, read[(lo - 1) * SCORED : hi * SCORED], group[at], real[at], room)
            held["step"] += 1
            step = held["step"]
            now = rate + (last - rate) * (epoch + lo / blocks) / epochs
            for n in w:
                every = [x.reshape(-1) for x in (w[n], m[n], s[n], g[n])]
                # by parts that stay in a core's own memory
                for part in range(0, w[n].size, 1 << 14):
                    own, mean, square, slope = (x[part : part + (1 << 14)] for x in every)
                    x = np.multiply(slope, np.float32(0.1), out=room("step", len(own)))
                    mean *= np.float32(0.9)
                    mean += x
                    np.multiply(slope, slope, out=x)
                    x *= np.float32(0.01)
                    square *= np.float32(0.99)
                    square += x
                    np.multiply(square, np.float32(1 / (1 - 0.99**step)), out=x)
                    np.sqrt(x, out=x)
                    x += np.float32(1e-8)
                    np.divide(mean, x, out=x)
                    x *= np.float32(now / (1 - 0.9**step))
                    own -= x
        total += blocks - len(sample)
    return total


def _round(held, rate: float, seed: int):
    """mapInArrow over (ids): the weights that a task reaches from those of the model by one
    pass over its texts, a row for each row of each, and the number of blocks."""
    def run(batches):
        model, sample, size, rng, state = held.value, [], 0, np.random.default_rng(seed), {}
        w, windows = {n: x.copy() for n, x in model.weights.items()}, 0
        kind = _id_type(len(model.bucket) - 1)
        learn = lambda: _adam(w, model.bucket, model.group, sample, rng, 1, rate, rate, state)
        for batch in batches:
            for x in batch.column("ids"):
                sample.append(np.frombuffer(x.as_buffer(), kind).astype(np.int64))
                size += len(sample[-1]) + SCORED
                if size >= HELD_IDS:
                    windows += learn()
                    sample, size = [], 0
        if sample:
            windows += learn()
        for name, x in w.items() if windows else ():
            x = x.reshape(len(x), -1)
            padded = np.zeros((len(x), CLASSES))
            padded[:, : x.shape[1]] = x
            columns = [pa.array([name] * len(x)), pa.array(np.arange(len(x))), pa.array(np.full(len(x), windows)), *(pa.array(padded[:, c]) for c in range(CLASSES))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "row", "n", *(f"c{c}" for c in range(CLASSES))])

    return run


def train_on(attention: AttentionModel, train: DataFrame, tokenizer: str, rounds: int = ROUNDS, share: int = 1) -> AttentionModel:
    """The model trained further on one of ``share`` of the texts of ``train``, see
    ``train_rounds``."""
    return train_rounds(attention, saved(train.select("text").mapInArrow(_encode(tokenizer), "ids binary"), "encoded"), rounds, share)


def train_rounds(attention: AttentionModel, encoded: DataFrame, rounds: int = ROUNDS, share: int = 1) -> AttentionModel:
    """The model trained by all tasks in ``rounds`` on different texts (``ids``, encoded), by
    default every text in one of them: in each round every task starts from the model, passes
    once over its part, and the weights that tasks reach are averaged by their blocks in Spark."""
    some = encoded.withColumn("round", F.pmod(F.xxhash64("ids", F.lit(23)), F.lit(share * rounds)))
    columns = [f"c{c}" for c in range(CLASSES)]
    schema = "name string, row long, n long, " + ", ".join(f"{c} double" for c in columns)
    for k in range(rounds):
        held = encoded.sparkSession.sparkContext.broadcast(attention)
        reached = some.where(F.col("round") == k).select("ids").mapInArrow(_round(held, ROUND_RATE * (1 - k / rounds), k), schema)
        mean = reached.groupBy("name", "row").agg(*(F.sum(F.col("n") * F.col(c)).alias(c) for c in columns), F.sum("n").alias("n")).toArrow()  # rows of the weights
        if not mean.num_rows:
            continue
        w = {n: x.copy() for n, x in attention.weights.items()}
        names, rows, n = np.array(mean.column("name").to_pylist()), mean.column("row").to_numpy(), mean.column("n").to_numpy()
        values = np.column_stack([mean.column(c).to_numpy() for c in columns]) / n[:, None]
        for name, x in w.items():
            mine = names == name
            x.reshape(len(x), -1)[rows[mine]] = values[mine, : x[0].size]
        attention = _tables(w, attention.bucket, attention.group, attention.share)
    return attention


@dataclass
class LanguageModel:
    """The attention model, the table of all word counts (key, n), its sums, and the
    frequent words' part of it; ``pairs`` has the gain (key, more) of every pair of ids."""

    attention: AttentionModel
    counts: DataFrame
    pairs: DataFrame
    tokenizer: str
    texts: int
    total: int
    distinct: int
    keys: np.ndarray
    logs: np.ndarray

    def log10(self, n):
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def _commonest(counts: DataFrame, most: int):
    """The rows (key, n) with the largest n, at most ``most``: whole steps of the logarithm
    of n, so that no sort is needed and ties stay together."""
    level = F.floor(F.log2("n") * 4).cast("int")
    cut, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        held += r["count"]
        if held > most:
            break
        cut = r["level"]
    return (counts.where(level >= cut) if cut is not None else counts.limit(0)).toPandas()


def _gains(held, room: int):
    """mapInArrow over pairs (key, n): also the cell of the id before and the group of the
    id after, the gain, and whether the tasks' table has room for the pair."""
    def run(batches):
        model = held.value
        ids, rank = len(model.bucket), model.rank
        for batch in batches:
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            before, after = key // ids, key % ids
            columns = (before * CLASSES + model.group[after], model.gain(after, n), np.maximum(rank[before], rank[after]) < room)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in columns)], names=["key", "n", "cell", "more", "near"])

    return run


def _dense(cells: pa.Table, rows: int, width: int) -> np.ndarray:
    out = np.zeros(rows * width)
    out[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    return out.reshape(rows, width)


def fit_language_model(train: DataFrame, tokenizer: str, text_col: str = "text") -> LanguageModel:
    """Count the words, ids and pairs of ids of all ``train`` texts and train the attention
    model on all of them. Null texts count as empty."""
    train = train.select(F.col(text_col).alias("text"))
    found = saved(train.mapInArrow(_count(tokenizer), "kind int, key long, n long, ids binary"), "counted")
    counts = saved(found.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "words")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = found.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()  # at most one row for each id of the vocabulary
    frequent = _commonest(counts, FREQUENT_WORDS)
    keys = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    by_id = np.zeros(WordEncoder(tokenizer).vocabulary, np.int64)
    by_id[[r["key"] for r in ids]] = [r["n"] for r in ids]
    every = np.append(by_id, texts)
    cells = found.where("kind = 3").select("key", "n").mapInArrow(_companies(_places(every)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each id and place
    attention = start_attention(every, _dense(cells, len(every), CLASSES + 2))
    rank = np.empty(len(every), np.int32)
    rank[np.argsort(-every, kind="stable")] = np.arange(1, len(every) + 1)
    held = train.sparkSession.sparkContext.broadcast(replace(attention, rank=rank))
    pairs = found.where("kind = 3").groupBy("key").agg(F.sum("n").alias("n"))
    pairs = saved(pairs.mapInArrow(_gains(held, RANKS), "key long, n long, cell long, more double, near boolean"), "pairs")
    cells = pairs.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each id and group
    mass = _dense(cells, len(every), CLASSES)
    attention = train_rounds(follow_counts(attention, every, mass), found.where("kind = 4").select("ids"))
    common = _commonest(pairs.where("near").select("key", "n"), FREQUENT_PAIRS)
    attention = attention.with_pairs(every, common["key"].to_numpy(np.int64), common["n"].to_numpy(np.int64), mass)
    model = LanguageModel(attention, counts, pairs.select("key", "more"), tokenizer, texts, sums[0] + texts, sums[1] + (texts > 0), keys[order], np.zeros(0))
    model.logs = model.log10(frequent["n"].to_numpy(float)[order])
    return model


def _score(held):
    """mapInArrow over (doc_id, text, ...): counts and scores by row, and the words and pairs
    of ids whose counts are not at hand."""
    def run(batches):
        model = held.value
        parts, end = part_ids(model["tokenizer"]), model["end"]
        for batch in batches:
            n_tokens, known, base, score, rare, pairs = (np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float, object, object))
            for lo, hi, words, keys, place, ids, first in _chunks(batch.column(1), parts):
                at = np.minimum(np.searchsorted(model["keys"], keys), max(0, len(model["keys"]) - 1))
                have = model["keys"][at] == keys if len(model["keys"]) else np.zeros(len(keys), bool)
                log = np.where(have, model["logs"][at], 0.0) if len(model["keys"]) else np.zeros(len(keys))
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[words.first])  # noqa: B023, E731
                rows = slice(lo, hi)
                n_tokens[rows] = words.counts() + 1
                known[rows] = sums(have[place].astype(np.int64)) + (model["texts"] > 0)
                base[rows] = sums(log[place]) + end
                seldom = keys.view(np.int64)[place[~have[place]]] if len(place) else np.zeros(0, np.int64)
                edge = np.concatenate([[0], np.cumsum(~have[place])])[words.first] if len(place) else np.zeros(hi - lo + 1, int)
                asked, until = model["attention"].unlisted(ids, first)
                for r in range(hi - lo):
                    rare[lo + r] = seldom[edge[r] : edge[r + 1]]
                    pairs[lo + r] = asked[until[r] : until[r + 1]]
                score[rows] = model["attention"].score(ids, first)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (n_tokens, known, base, score)), *(pa.array(list(x), pa.list_(pa.int64())) for x in (rare, pairs))], names=["doc_id", "n_tokens", "known", "base", "score", "rare", "pairs"])

    return run


def score_texts(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score,
    score. A null, empty or word-less text is its end alone. Rows with one id stay
    apart. Other columns are not read."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({"attention": replace(model.attention, weights={}), "keys": model.keys, "logs": model.logs, "tokenizer": model.tokenizer, "end": float(model.log10(model.texts)), "texts": model.texts})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(_score(held), "doc_id long, n_tokens long, known long, base double, score double, rare array<long>, pairs array<long>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    seldom = rows.select("row", F.explode("rare").alias("key")).join(model.counts, "key", "left")
    n = F.coalesce("n", F.lit(0))
    log = F.log10((n + 0.5) / F.lit(float(model.total + 0.5 * (model.distinct + 1))))
    more = seldom.groupBy("row").agg(F.sum(log).alias("more"), F.sum((n > 0).cast("long")).alias("more_known"))
    gained = rows.select("row", F.explode("pairs").alias("key")).join(model.pairs, "key").groupBy("row").agg(F.sum("more").alias("gained"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("rare", "pairs").join(more, "row", "left").join(gained, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"), (F.col("score") + zero("gained")).alias("score"))
