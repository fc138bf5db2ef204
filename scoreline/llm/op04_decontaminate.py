"""Benchmark decontamination by SimHash over item-sized windows and pieces of items.

Every window of an item's size (the largest of a fixed ladder that fits it) of every
document is fingerprinted (64 bits, words as features, kept up by running sums) and looked
up among the items' own. A multi-index finds all fingerprints within a Hamming radius r: the
64 bits are four blocks, and fingerprints within r agree up to r // 4 bits in one of them,
so a table of each block's neighbours misses none.

Edits and cuts move an item-sized window's bits far, but leave runs of words as they were: a
passage that keeps the share ``least`` of an item's five-word shingles, in their order, holds
some ``unchanged_run`` of the item's words. So items are also known by pieces, shorter
windows spread so densely that such a run holds a whole one, and these are looked up the same
way, within a small radius. Documents shorter than an item meet it by its pieces.

A candidate counts as a leak if the passage around it holds ``least`` or more of the weight of
the item's five-word shingles; a shingle weighs 1 + ln(items / items that have it), counted
over the whole benchmark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .storage import saved
from .tokens import Words, mix, shingles, text_buffers, word_chunks

SHINGLE = 5
_BLOCKS = 4
LEAK = StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("start_word", LongType()), StructField("end_word", LongType()), StructField("distance", LongType())])


#: Words of the largest window; byte counters hold no more. Of longer items the first and last
#: so many words are item-sized windows; their pieces cover all of them.
LARGEST = 255
#: Words of the largest piece, and the radius that pieces are looked up within.
PIECE = 9
PIECE_RADIUS = 3
#: Items and words of items that one pass over the texts looks for.
MOST_ITEMS, MOST_WORDS = 10_000, 500_000
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)


def window_size(words: int) -> int:
    """The largest step of 1, 2, 3, 4, 6, 9, 13, 19, 28, 42, ... that is at most ``words``."""
    step = 1
    while (after := max(step + 1, step * 3 // 2)) <= min(words, LARGEST):
        step = after
    return step


def unchanged_run(words: int, least: float) -> int:
    """Words in a row that any passage shares with an item of ``words`` words if it keeps the
    share ``least`` of the item's shingles: m cuts inside, each by inserted words, lose
    SHINGLE - 1 shingles, every word taken away one more, and leave m + 1 runs."""
    lost = int((1 - least) * max(1, words - SHINGLE + 1) + 1e-9)
    cut = SHINGLE - 1
    return min(-(-(words - (lost - cut * m)) // (m + 1)) for m in range(lost // cut + 1))


def piece_offsets(words: int, least: float) -> tuple[int, list[int]]:
    """(size, starts) of an item's pieces: every run of ``unchanged_run`` words holds one."""
    run = unchanged_run(words, least)
    size = window_size(min(PIECE, max(1, run * 3 // 4)))
    return size, sorted({*range(0, words - size + 1, run - size + 1), words - size})


def fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words: a bit is set if more than half of
    the window's word hashes have it."""
    return _fingerprints(_running(hashes), size)


def _running(hashes: np.ndarray) -> np.ndarray:
    """Running counts of set bits: lane j has, in its 8 bytes, those of bits j, j + 8,
    ... Sums carry from byte to byte, but differences over a window come out exact."""
    total = np.zeros((8, len(hashes) + 1), np.uint64)
    for j in range(8):
        np.cumsum((hashes >> np.uint64(j)) & _ONES, out=total[j, 1:])
    return total


def _fingerprints(total: np.ndarray, size: int) -> np.ndarray:
    n = total.shape[1] - size
    out = np.zeros(max(0, n), np.uint64)
    if n <= 0:
        return out
    above = np.uint64(127 - size // 2) * _ONES
    for j in range(8):
        ones = total[j, size:] - total[j, :n]
        ones += above
        ones &= _HIGH
        ones >>= np.uint64(7 - j)
        out |= ones
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


@dataclass
class Index:
    """Items and, by window size, their fingerprints with the multi-index."""

    items: list  # (item_id, words, sorted shingles, their weights)
    radius: int
    sizes: dict  # size -> (fingerprints, item number, offset in item, [(starts, members)] by block)
    pieces: dict = field(default_factory=dict)  # the same of pieces, within PIECE_RADIUS

    @classmethod
    def build(cls, rows: list[tuple[int, str]], radius: int, least: float = 0.8, total: int | None = None, common: dict | None = None) -> Index:
        """``total`` items hold a shingle of ``common`` so many times, others once; without
        them the rows are the whole benchmark."""
        items, prints, pieces = [], {}, {}
        data, offsets = text_buffers(pa.array([text for _, text in rows], pa.large_string()))
        words = Words(data, offsets)
        for r, (item_id, _) in enumerate(rows):
            own = item_hashes(words, r)
            if not len(own):
                continue
            running = _running(own)
            size = window_size(len(own))
            every = _fingerprints(running, size)
            for at in sorted({0, len(every) - 1}):
                prints.setdefault(size, []).append((int(every[at]), len(items), at))
            size, starts = piece_offsets(len(own), least)
            every = _fingerprints(running, size)
            pieces.setdefault(size, []).extend((int(every[at]), len(items), at) for at in starts)
            items.append((item_id, len(own), np.unique(shingles(own, SHINGLE))))
        if common is None:
            value, n = np.unique(np.concatenate([x[2] for x in items]), return_counts=True) if items else (np.zeros(0, np.uint64), np.zeros(0))
            common, total = dict(zip(value.tolist(), n.tolist(), strict=True)), len(items)
        weigh = lambda s: 1 + np.log(total / np.array([common.get(x, 1) for x in s.tolist()], float))
        items = [(i, n, s, weigh(s)) for i, n, s in items]
        return cls(items, radius, {k: cls._multi_index(x, radius) for k, x in prints.items()}, {k: cls._multi_index(x, PIECE_RADIUS) for k, x in pieces.items()})

    @staticmethod
    def _multi_index(prints: list, radius: int):
        value = np.array([p[0] for p in prints], np.uint64)
        spread = [0, *(sum(1 << b for b in c) for d in range(1, radius // _BLOCKS + 1) for c in combinations(range(16), d))]
        blocks = []
        for b in range(_BLOCKS):
            near = (((value >> np.uint64(16 * b)) & np.uint64(0xFFFF))[:, None] ^ np.array(spread, np.uint64)).astype(np.int64)
            order = np.argsort(near.ravel(), kind="stable")
            starts = np.searchsorted(near.ravel()[order], np.arange(65537))
            blocks.append((starts, (order // len(spread)).astype(np.int64)))
        return value, np.array([p[1] for p in prints]), np.array([p[2] for p in prints]), blocks

    def near(self, size: int, windows: np.ndarray, pieces: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, fingerprint number, distance) of all pairs within the radius."""
        value, _, _, blocks = (self.pieces if pieces else self.sizes)[size]
        radius = PIECE_RADIUS if pieces else self.radius
        found = []
        for b, (starts, members) in enumerate(blocks):
            block = ((windows >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            count = starts[block + 1] - starts[block]
            at = np.flatnonzero(count)
            n = count[at]
            which = members[np.repeat(starts[block[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            at = np.repeat(at, n)
            far = distance(windows[at], value[which])
            found.append(np.column_stack([at, which, far])[far <= radius])
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1], pairs[:, 2]

    def leaks(self, column: pa.Array, least: float) -> list[list[dict]]:
        """By row, the best passage of each item that it leaks."""
        out = [{} for _ in range(len(column))]
        for lo, _, _, _, words in word_chunks(column, 1 << 18):
            if not len(words.hashes):
                continue
            hashes = mix(words.hashes, 7)
            total, places = _running(hashes), {}
            for size in sorted({*self.sizes, *self.pieces}):
                if len(hashes) < size:
                    continue
                windows = _fingerprints(total, size)
                at = np.flatnonzero(words.doc[: len(windows)] == words.doc[size - 1 :])
                for pieces, held in ((False, self.sizes), (True, self.pieces)):
                    if size in held:
                        pos, which, far = self.near(size, windows[at], pieces)
                        begin = at[pos] - held[size][2][which]
                        for doc, b, i, d in zip(words.doc[at[pos]].tolist(), begin.tolist(), held[size][1][which].tolist(), far.tolist(), strict=True):
                            # one place of an item may be found by many windows
                            places[doc, i, b] = min(d, places.get((doc, i, b), 64))
            for (doc, item, begin), far in places.items():
                self._verify(hashes, words, lo, doc, begin, item, far, least, out)
        return [sorted(x.values(), key=lambda x: x["item_id"]) for x in out]

    def _verify(self, hashes, words, lo, doc, begin, item, far, least, out) -> None:
        item_id, n, own, weights = self.items[item]
        first, end = int(words.first[doc]), int(words.first[doc + 1])
        # room for as many inserted words as the item has
        held = shingles(hashes[max(first, begin - n) : min(end, begin + 2 * n)], min(SHINGLE, n))
        at = np.minimum(np.searchsorted(own, held), len(own) - 1)
        found = np.zeros(len(own), bool)
        found[at[own[at] == held]] = True
        share = float(weights[found].sum() / weights.sum())
        known = out[lo + doc].get(item_id)
        if share >= least - 1e-9 and (known is None or (share, -far) > (known["similarity"], -known["distance"])):
            out[lo + doc][item_id] = {"item_id": item_id, "similarity": share, "start_word": max(first, begin) - first, "end_word": min(end, begin + n) - first, "distance": far}


def item_hashes(words: Words, row: int) -> np.ndarray:
    return mix(words.hashes[words.first[row] : words.first[row + 1]], 7)


def _item_shingles(batches):
    """mapInArrow: (words, shingles) of each item that has words, the row kept."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        words = Words(data, offsets)
        own = [item_hashes(words, r) for r in range(batch.num_rows)]
        held = pa.array([np.unique(shingles(x, SHINGLE)).view(np.int64) for x in own], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(x) for x in own], pa.int64()), held], names=["item_id", "text", "words", "shingles"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", radius: int = 7, least: float = 0.8, most_items: int = MOST_ITEMS) -> DataFrame:
    """``docs`` with ``leaks``: for each benchmark item that a document holds, its best
    passage (item_id, similarity, start_word, end_word, distance), in order of item_id.

    Items are looked for in passes of about ``most_items`` or MOST_WORDS words, which
    bounds what is sent to the tasks; any number of items is searched, and neither the
    passages found nor their similarity depend on the passes. Null, empty and word-less
    texts and items match nothing; items with a null id are left out. Items with one id
    are one item for the result (the best passage stays). A document that holds a part
    of an item leaks it if that part has ``least`` of its shingles' weight. An existing
    column ``leaks`` is replaced."""
    docs = docs.drop("leaks")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = saved(items.mapInArrow(_item_shingles, "item_id long, text string, words long, shingles array<long>").where("words > 0"), "items")
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    passes = max(1, -(-size["items"] // most_items), -(-size["words"] // MOST_WORDS))
    # what is held by one item alone weighs most and needs no entry
    each = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)).alias("pass"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    shared = saved(each.distinct().join(shared, "shingle"), "weights")
    schema = StructType([*docs.schema.fields, StructField("leaks", ArrayType(LEAK))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("distance", pa.int64())]))
    out = docs.withColumn("leaks", F.array().cast(ArrayType(LEAK)))
    for k in range(passes):
        # at most MOST_WORDS words, and a shingle for each
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).select("item_id", "text").collect()
        held = shared.where(F.col("pass") == k).select("shingle", "n").toArrow()
        common = dict(zip(held["shingle"].to_numpy().view(np.uint64).tolist(), held["n"].to_pylist(), strict=True))
        index = Index.build([(r["item_id"], r["text"]) for r in rows], radius, least, size["items"], common)
        index = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, index=index):
            for batch in batches:
                text = batch.column(batch.schema.get_field_index(text_col))
                before = batch.column(batch.schema.get_field_index("leaks")).to_pylist()
                found = index.value.leaks(text, least)
                merged = [_merge(x or [], y) for x, y in zip(before, found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(batch.num_columns - 1)), pa.array(merged, kind)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def _merge(a: list[dict], b: list[dict]) -> list[dict]:
    if not a or not b:
        return a or b
    best: dict = {}
    for x in [*a, *b]:
        if x["item_id"] not in best or x["similarity"] > best[x["item_id"]]["similarity"]:
            best[x["item_id"]] = x
    return [best[i] for i in sorted(best)]
