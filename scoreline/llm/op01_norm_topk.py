"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length (geometric steps of the Euclidean norm; a crowded step is
split by a hash of the id, so that no group exceeds ``GROUP_ROWS`` by much). A first pass
over the longest vectors gives every query a score that its k-th result reaches. In each
group that score and the group's largest norm give the query a local cosine threshold:
above 1 the group is skipped, high ones prune by coordinates (the interval that a unit
vector's coordinate must fall into), the others by length. What is left is verified by
exact products.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked
from .storage import saved

#: Rows of a group of candidates and of a block of queries.
GROUP_ROWS, QUERY_ROWS = 8192, 2048
#: Ratio of the norms of neighbouring groups; cosine from which coordinates prune; how many do.
STEP, COORDINATES_FROM, FOCUS = 1.1, 0.8, 3
_EXACT = 2.0**52


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _interval(cosine: float, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each coordinate of a unit query, where a unit vector's may lie if their cosine
    is at least ``cosine``."""
    rest = math.sqrt(max(0.0, 1 - cosine * cosine)) * np.sqrt(np.maximum(0.0, 1 - q * q))
    low = np.where(q <= -cosine, -1.0, q * cosine - rest)
    high = np.where(q >= cosine, 1.0, q * cosine + rest)
    return low - 1e-9, high + 1e-9


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search_group(q_ids, q, floor, c_ids, c, k: int):
    """(query id, candidate id, score) of each query's best k in a group, as far as they
    reach ``floor``: the exact search by lengths, coordinates and products."""
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) >= 2**26 / math.sqrt(q.shape[1] + 1):
        q, c = q.astype(object), c.astype(object)
    norm = lambda m: np.sqrt((m.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norm(c), kind="stable")
    c_ids, c = c_ids[order], c[order]
    lengths, q_length = norm(c), norm(q)
    values = c if c.dtype == object else c.astype(float)
    unit = c.astype(float) / np.maximum(lengths, 1e-300)[:, None]
    # a query needs candidates of this length or more; queries of like need go together
    need = np.where(floor > 0, floor / np.maximum(q_length, 1e-300), -np.inf)
    out = []

    def take(row, at, scores):
        mine = (scores >= floor[row]) & (c_ids[at] != q_ids[row])
        at, scores = at[mine], scores[mine]
        best = _best(scores, c_ids[at], k)
        out.append((np.full(len(best), q_ids[row]), c_ids[at[best]], scores[best]))

    longest = lengths[0] if len(lengths) else 0.0
    cosine = need / longest if longest > 0 else np.where(need <= 0, -np.inf, np.inf)
    live = np.flatnonzero(cosine <= 1 + 1e-9)
    by_length = live[cosine[live] < COORDINATES_FROM]
    by_length = by_length[np.argsort(need[by_length], kind="stable")]
    for lo in range(0, len(by_length), 128):
        rows = by_length[lo : lo + 128]
        m = int(np.searchsorted(-lengths, -need[rows[0]] * (1 - 1e-9), "right")) if np.isfinite(need[rows[0]]) else len(lengths)
        products = (q[rows] if q.dtype == object else q[rows].astype(float)) @ values[:m].T
        for row, scores in zip(rows, products, strict=True):
            take(row, np.arange(m), scores)
    for row in live[cosine[live] >= COORDINATES_FROM]:
        m = int(np.searchsorted(-lengths, -need[row] * (1 - 1e-9), "right"))
        u = q[row].astype(float) / q_length[row]
        low, high = _interval(min(1.0, float(cosine[row]) * (1 - 1e-9)), u)
        fits = np.ones(m, bool)
        for f in np.argsort(-np.abs(u))[:FOCUS]:
            fits &= (unit[:m, f] >= low[f]) & (unit[:m, f] <= high[f])
        at = np.flatnonzero(fits)
        take(row, at, values[at] @ (q[row] if q.dtype == object else q[row].astype(float)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores = np.concatenate([x[2] for x in out])
    if scores.dtype == object:
        scores = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), scores.astype(np.int64)


def _search(k: int):
    names = ["query_id", "vec_id", "score"]

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            found = [np.zeros(0, np.int64)] * 3
        else:
            found = search_group(queries["vec_id"].to_numpy(), _matrix(queries["v"]), queries["floor"].to_numpy(), candidates["vec_id"].to_numpy(), _matrix(candidates["v"]), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], names=names)

    return run


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), norm, size. Vectors that are null or
    have null or non-finite components, and rows with a null id, are left out; rows with
    one id are one vector, the least of them."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    rows = vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("long")).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return rows.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("size"))


def norm_topk(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """For each vector of ``integer_vectors`` output that ``is_query`` picks, the k largest
    inner products with other vectors of its size: query_id, rank (from 1), vec_id,
    score; ties to smaller vec_id; all, if there are fewer. Empty input gives no rows;
    scores beyond 64 bits are cut to their range."""
    step = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(STEP)).cast("int")).otherwise(-20000)
    rows = saved(vectors.withColumn("step", step), "vectors")
    # a row for each step of the norm, of which doubles have a bounded number
    steps = [r.asDict() for r in rows.groupBy("size", "step").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()]
    sizes = {r["size"]: r["n"] for r in rows.where(is_query).groupBy("size").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    spark = rows.sparkSession
    groups = spark.createDataFrame([(r["size"], r["step"], -(-r["n"] // GROUP_ROWS), float(r["top"])) for r in steps], "size int, step int, parts long, top double")
    blocks = spark.createDataFrame([(s, -(-n // QUERY_ROWS)) for s, n in sizes.items()], "size int, blocks long")
    grouped = rows.join(F.broadcast(groups), ["size", "step"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    queries = rows.where(is_query).join(F.broadcast(blocks), "size").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), "blocks")).select("vec_id", "v", "size", "block", "norm")
    queries = saved(queries, "asked")

    first = []
    for s in sizes:
        held = 0
        for r in sorted((r for r in steps if r["size"] == s), key=lambda r: -r["step"]):
            if held <= k:
                first.append((s, r["step"]))
                held += min(r["n"], GROUP_ROWS // 2)
    seeds = grouped.join(F.broadcast(spark.createDataFrame(first, "size int, step int")), ["size", "step"]).where("part = 0")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    schema = "query_id long, vec_id long, score long"

    def matched(queries: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
        return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_search(k), schema)

    seed = matched(queries.withColumn("floor", F.lit(float("-inf"))).drop("norm"), seeds.join(F.broadcast(blocks), "size").select("vec_id", "v", "size", every_block.alias("block")), ["size", "block"])
    floors = seed.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("score")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("score").cast("double")).alias("floor"))
    queries = saved(queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")
    # queries of like need share a block, so that one which needs little carries no others along
    need = F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm")).otherwise(float("-inf"))
    queries = ranked(queries.drop("block").withColumn("need", need), "size", ["need", "vec_id"])
    queries = saved(queries.withColumn("block", F.expr(f"rank div {QUERY_ROWS}")).drop("rank", "norm"), "needs")
    # a block meets the groups whose longest vector can reach the floor of one of its queries ...
    least = queries.groupBy("size", "block").agg(F.min("need").alias("least"))
    reached = lambda needed: F.col("top") >= F.col(needed) * (1 - 1e-9)
    pairs = saved(groups.join(least, "size").where(reached("least")).select("size", "step", "parts", "top", "block"), "blocks")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    # ... and of its queries only those that it can reach go there
    asked = queries.join(pairs, ["size", "block"]).where(reached("need")).select("vec_id", "v", "floor", "size", "block", "step", part)
    offered = grouped.drop("parts", "top").join(pairs.drop("parts", "top"), ["size", "step"]).select("vec_id", "v", "size", "block", "step", "part")
    found = matched(asked, offered, ["size", "block", "step", "part"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
     p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
