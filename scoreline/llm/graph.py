"""Connected components by randomised contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, saved

#: Tasks that the rows of one key may be dealt to.
SALTS = 16


def salted_join(rows: DataFrame, names: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``names`` (one row a key), where one key may hold any share of
    ``rows``: these are dealt out by a hash of the whole row, and names are repeated."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    right = names.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of undirected long ``edges`` (x, y): two nodes
    have one label exactly if a path joins them.

    Each round, every node moves to the neighbour (or itself) that comes first in
    a random order drawn anew; edges inside a merged node vanish. A constant share
    of nodes goes each round, so rounds grow with the logarithm of the longest
    path, and a star of any size takes one partial aggregation, never one group
    in memory. Null ends are dropped; no edges give no rows."""
    edges = edges.where("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    edges = saved(edges.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    labels, step = None, 0
    while not edges.isEmpty():
        step += 1
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("h"), F.col(c).alias("v"))
        picks = both.groupBy(F.col("x").alias("node")).agg(F.min(F.least(order("y"), order("x"))).getField("v").alias("pick"))
        picks = saved(picks, "picks")
        to = lambda c: picks.select(F.col("node").alias(c), F.col("pick").alias(f"{c}_to"))
        edges = saved(
            edges.join(to("x"), "x").join(to("y"), "y").where("x_to <> y_to")
            .select(F.least("x_to", "y_to").alias("x"), F.greatest("x_to", "y_to").alias("y")).distinct(), "edges")
        if labels is None:
            labels = picks.withColumnRenamed("pick", "label")
        else:
            moved = labels.join(picks.select(F.col("node").alias("label"), "pick"), "label", "left")
            before, labels = labels, saved(moved.select("node", F.coalesce("pick", "label").alias("label")), "labels")
            release(before)
    if labels is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labels
