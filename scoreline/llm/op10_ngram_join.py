"""N-gram Jaccard join by multiple-global-order filtering.

A document is its set of distinct k-word shingles. If two sets have Jaccard
similarity t or more, then under every total order of shingles their prefixes of
n - ceil(t n) + 1 first shingles share one. Candidates come from shared prefix
shingles under a first order and must also share one under each further order;
only pairs that pass all filters are verified exactly.

All orders put shingles that many documents repeat last (a fixed-size table of
levels from counts over all documents, see ``_levels``) and differ in the hash that orders the rest, so passages
and lines shared by many documents do not make candidates. Any such order is
right for any table of levels; it only changes how many candidates there are.

Work stays linear in a group of copies: equal sets are one class (known by 64
bits summed over the set); each bucket of a prefix shingle first links its
members to the member in which it comes earliest; only members left in different
components are then compared with each other in that bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, salted_join
from .sketch import dense
from .storage import release, saved
from .tokens import mix, shingles, word_chunks

#: Cells of the table of levels, and of the table of wanted documents.
LEVEL_CELLS = 1 << 22
WANTED_CELLS = 1 << 22
#: Bits of a shingle's hash that name the bin in which it is counted; shingles that a task
#: holds before it deals them to bins.
BIN_BITS = 12
HELD_SHINGLES = 1 << 20


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of each row of a batch that has words."""
    for lo, hi, _, _, words in word_chunks(batch.column("text")):
        for r in range(hi - lo):
            if words.first[r] < words.first[r + 1]:
                yield lo + r, np.unique(shingles(words.hashes[words.first[r] : words.first[r + 1]], k))


def _class_id(values: np.ndarray) -> int:
    return int(mix(values, 1).sum(dtype=np.uint64).view(np.int64))


def _binned(held: list[np.ndarray]) -> tuple[np.ndarray, pa.Array]:
    """The bins that the shingles of sets fall in, and for each the next 32 bits of their
    hashes, end to end."""
    values = np.concatenate(held)
    codes = np.sort(((values & np.uint64((1 << BIN_BITS) - 1)) << np.uint64(32)) | ((values >> np.uint64(BIN_BITS)) & np.uint64(0xFFFFFFFF)))
    bins = (codes >> np.uint64(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.append(True, bins[1:] != bins[:-1])), len(bins))
    data = codes.astype("<u4")
    return bins[edge[:-1]], pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(data)])


def _survey(k: int):
    """mapInArrow: a row for each document (kind 0: doc_id, key, n, cid; any bin) and rows with
    the shingles of every class (kind 1: bin, items), once for each task that meets the
    class."""
    schema = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("items", pa.binary())])

    def dealt(held):
        bins, items = _binned(held)
        none = pa.nulls(len(bins), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bins), pa.array(np.ones(len(bins), np.int32)), none, none, none, none, items], schema=schema)

    def run(batches):
        seen, held, size = set(), [], 0
        for batch in batches:
            n, cid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, values in _sets(batch, k):
                n[row], cid[row] = len(values), _class_id(values)
                if cid[row] not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(cid[row])
                    held.append(values)
                    size += len(values)
                    if size >= HELD_SHINGLES:
                        yield dealt(held)
                        held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(cid & ((1 << BIN_BITS) - 1) ^ np.arange(len(n)) % (1 << BIN_BITS)), pa.array(np.zeros(len(n), np.int32)), batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array(cid), pa.nulls(len(n), pa.binary())], schema=schema)
        if held:
            yield dealt(held)

    return run


def _counted(table: pa.Table) -> pa.Table:
    """applyInArrow over the rows of a bin: its documents' rows as they are, and a row (kind 1:
    key, n) for each cell of its shingles that two or more classes hold, with how many hold
    the cell's commonest one."""
    docs = table.filter(pc.equal(table.column("kind"), 0)).drop_columns(["bin", "items"])
    items = table.column("items").drop_null()
    if not len(items):
        return docs
    codes = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in items]))
    edge = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    often = np.diff(np.append(edge, len(codes)))
    cells = (codes[edge[often > 1]].astype(np.int64) << BIN_BITS | table.column("bin")[0].as_py()) & (LEVEL_CELLS - 1)
    cells, place = np.unique(cells, return_inverse=True)
    most = np.zeros(len(cells), np.int64)
    np.maximum.at(most, place, often[often > 1])
    none = pa.nulls(len(cells), pa.int64())
    return pa.concat_tables([docs, pa.Table.from_arrays([pa.array(np.ones(len(cells), np.int32)), none, pa.array(cells), pa.array(most), none], schema=docs.schema)])


def _surveyed(rows: DataFrame, k: int) -> DataFrame:
    """The rows of ``_counted``. Shingles go straight into the shuffle, packed by bin."""
    survey = rows.mapInArrow(_survey(k), "bin long, kind int, doc_id long, key long, n long, cid long, items binary")
    return survey.groupBy("bin").applyInArrow(_counted, "kind int, doc_id long, key long, n long, cid long")


def _levels(survey: DataFrame) -> np.ndarray:
    """By cell of a shingle's hash, 1 + the binary logarithm of how many classes hold the
    cell's commonest shingle, if two or more do; else 0. All shingles of all classes are
    counted, by ``32 + BIN_BITS`` bits of their hashes; a class that several tasks meet
    counts in each. Whether a shingle is found common depends on how many classes hold it,
    not on their share of the corpus; the table's size is fixed."""
    cells = survey.where("kind = 1")
    return dense(cells.select(F.col("key").alias("cell"), F.least(F.floor(F.log2("n")) + 1, F.lit(255)).alias("value")), LEVEL_CELLS)


def _ranked(values: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
    """Sorted ranks of a set's shingles under an order; a rank also names its shingle."""
    level = levels[(values & np.uint64(LEVEL_CELLS - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (mix(values, 16 + order) >> np.uint64(8)))


def _prefix(values: np.ndarray, levels: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """The ranks of a set that one of any similar enough set is among, under an order."""
    return _ranked(values, levels, order)[: len(values) - -(-num * len(values) // den) + 1]


def _prefixes(k: int, num: int, den: int, levels):
    """mapInArrow: the prefix of each class under the first order, a row for each token."""
    schema = pa.schema([("token", pa.int64()), ("cid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches):
        seen = set()
        for batch in batches:
            cids, sizes, tokens = [], [], []
            for _, values in _sets(batch, k):
                cid = _class_id(values)
                if cid in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                seen.add(cid)
                cids.append(cid)
                sizes.append(len(values))
                tokens.append(_prefix(values, levels.value, 0, num, den).view(np.int64))
            if not cids:
                continue
            lens = np.array([len(x) for x in tokens])
            at = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(cids), lens)), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(at.astype(np.int32))], schema=schema)

    return run


def _wanted_sets(k: int, num: int, den: int, orders: int, levels, wanted):
    """mapInArrow: of the documents whose key falls in a wanted cell, the class, its prefixes
    under the further orders (32 bits a token) and its set."""
    schema = pa.schema([("cid", pa.int64()), ("others", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.int64()))])

    def run(batches):
        seen = set()
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted.value[key & (WANTED_CELLS - 1)] > 0))
            for row, values in _sets(batch, k):
                cid = _class_id(values)
                if cid not in seen:
                    if len(seen) >= 1 << 18:
                        seen.clear()
                    seen.add(cid)
                    others = [_prefix(values, levels.value, o, num, den).astype(np.uint32).view(np.int32) for o in range(1, orders)]
                    yield pa.RecordBatch.from_arrays([pa.array([cid]), pa.array([others], schema.field("others").type), pa.array([values.view(np.int64)], schema.field("items").type)], schema=schema)

    return run


def _stages(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: Fraction, orders: int):
    """(survey, classes, shared, possible, links) that both results below are made of."""
    num, den = threshold.numerator, threshold.denominator
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long")).alias("key"), F.col(text_col).alias("text"))
    found = saved(_surveyed(rows, k), "survey")
    levels, survey = spark.sparkContext.broadcast(_levels(found)), found.where("kind = 0")
    classes = survey.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))

    # tokens go straight into the shuffle; those of one class alone are never written
    bucket = Window.partitionBy("token")
    shared = (
        rows.mapInArrow(_prefixes(k, num, den, levels), "token long, cid long, n int, pos int")
        .withColumn("centre", F.min(F.struct("pos", "cid", "n")).over(bucket)).withColumn("other", F.max("cid").over(bucket)).withColumn("one", F.min("cid").over(bucket))
        .where("one <> other").select("token", "cid", "n", "pos", "centre")
    )
    shared = saved(shared, "shared")

    def possible(a, i, b, j):
        """The sizes, and the places of a first common shingle, allow the similarity."""
        need = F.ceil((a + b) * F.lit(num) / F.lit(den + num) - F.lit(1e-9))
        return (F.least(a, b) * F.lit(den) >= F.greatest(a, b) * F.lit(num)) & (F.least(a - i, b - j) >= need)

    def links(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that all orders let through and that verify, written."""
        met = saved(pairs, "met")
        ends = met.select(F.col("x").alias("cid")).union(met.select(F.col("y").alias("cid"))).distinct()
        cells = ends.join(classes, "cid").select((F.pmod("key", F.lit(WANTED_CELLS))).alias("cell")).distinct().withColumn("value", F.lit(1))
        wanted = spark.sparkContext.broadcast(dense(cells, WANTED_CELLS))
        sets = saved(rows.select("key", "text").mapInArrow(_wanted_sets(k, num, den, orders, levels, wanted), "cid long, others array<array<int>>, items array<long>"), "sets")

        def with_column(pairs, column):
            for side in ("x", "y"):
                own = sets.select(F.col("cid").alias(side), F.col(column).alias(f"{side}_{column}"))
                # from the second one on both sides hold sets: neither goes whole to every executor
                pairs = pairs.join(own if side == "x" else own.hint("merge"), side)
            return pairs

        passed = F.lit(True)
        for o in range(orders - 1):
            passed = passed & F.arrays_overlap(F.col("x_others")[o], F.col("y_others")[o])
        # a set that several tasks found comes several times
        passing = saved(with_column(met, "others").where(passed).select("x", "y").distinct(), "pairs")
        both = with_column(passing, "items")
        common = F.size(F.array_intersect("x_items", "y_items"))
        size = F.size("x_items") + F.size("y_items")
        both = both.where(common * F.lit(den + num) >= size * F.lit(num))
        both = saved(both.select("x", "y", F.size("x_items").alias("x_shingles"), F.size("y_items").alias("y_shingles"), common.alias("common")).distinct(), "links")
        release(met, sets, passing)
        return both

    return survey, classes, shared, possible, links


def _met(left: DataFrame, right: DataFrame, possible, apart) -> DataFrame:
    """The distinct pairs (x, y) of classes that share a prefix shingle."""
    pairs = left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.cid") < F.col("r.cid")) & apart & possible(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos")))
    return pairs.select(F.col("l.cid").alias("x"), F.col("r.cid").alias("y")).distinct()


def ngram_jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: Fraction = Fraction(9, 10), orders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): every two classes of different sets that link, once (x, y,
    x_shingles, y_shingles, common; x < y), and for each row of ``docs`` its class
    (doc_id, n_shingles, class_id; a null class without shingles). Rows of one class
    are copies of similarity 1, which ``pairs`` doesn't list. No link is left out, so the
    result grows with the number of links, in a family of near copies with its square;
    ``ngram_jaccard_join`` has the components alone and avoids that."""
    survey, _, shared, possible, links = _stages(docs, id_col, text_col, k, threshold, orders)
    known = shared.select("token", "cid", "n", "pos").dropDuplicates(["token", "cid"])
    pairs = links(_met(known.alias("l"), known.alias("r"), possible, F.lit(True)))
    release(shared)
    return pairs, survey.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cid")).alias("class_id"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, threshold: Fraction = Fraction(9, 10), orders: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest
    doc_id that links reach; two documents link at Jaccard similarity ``threshold``
    or more).

    Null or word-less texts have no shingles, link with nothing and are their own
    component. Rows with one id and different texts stay separate rows. A null id
    takes part, but never names a component that has another id. Ties and repeated
    rows fall into one class; other columns of ``docs`` are not read. An empty
    table gives an empty result."""
    survey, classes, shared, possible, links = _stages(docs, id_col, text_col, k, threshold, orders)
    star = shared.where(F.col("cid") != F.col("centre.cid")).where(possible(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos")))
    star = star.select(F.least("cid", "centre.cid").alias("x"), F.greatest("cid", "centre.cid").alias("y")).distinct()
    first = links(star).select("x", "y")
    labels = components(first)
    known = shared.select("token", "cid", "n", "pos").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid")).dropDuplicates(["token", "cid"])
    rest = _met(known.alias("l"), known.alias("r"), possible, F.col("l.label") != F.col("r.label"))
    second = links(rest).select("x", "y")
    release(shared, labels)
    labels = components(first.unionByName(second))
    release(first, second)

    merged = classes.select("cid", "doc_id").join(labels.select(F.col("node").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = merged.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    # a component may hold any share of the classes: its rows meet copies of its name in many tasks
    named = salted_join(merged, smallest, "label").select("cid", "component_id")
    out = survey.drop("kind").join(named, "cid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
