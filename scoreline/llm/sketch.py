"""Fixed-size arrays gathered from a distributed table of (cell, value) rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PAGE = 1 << 14


def dense(cells: DataFrame, size: int) -> np.ndarray:
    """uint8 array of ``size`` entries from distinct integer ``cell`` and ``value``
    (0-255) columns; absent cells are 0. What reaches the driver is bounded by
    ``size`` (one row per 16,384 cells), not by the data."""
    pages = (
        cells.groupBy((F.col("cell") / _PAGE).cast("long").alias("page"))
        .agg(F.collect_list(F.struct((F.col("cell") % _PAGE).cast("int").alias("at"), F.col("value").cast("int").alias("value"))).alias("x"))
        .select("page", F.col("x.at").alias("at"), F.col("x.value").alias("value"))
    )
    out = np.zeros(size, np.uint8)
    for r in pages.toLocalIterator():
        out[np.asarray(r["at"], np.int64) + r["page"] * _PAGE] = r["value"]
    return out
