"""Data-quality checks: not-null and uniqueness per column, lookup coverage.

Each check is one distributed pass: the not-null report counts NULLs of all
requested columns in a single aggregation; the uniqueness report groups by
the key (partial aggregation per task) and keeps only keys seen twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_null_report(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, column, rows, null_rows, passed) for each column, one scan."""
    agg = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("null_rows"))
             for i, c in enumerate(columns)]
    return (agg.select(F.col("__rows"), F.inline(F.array(*parts)))
               .select(F.lit(table).alias("table"), "column", F.col("__rows").alias("rows"),
                       "null_rows", (F.col("null_rows") == 0).alias("passed")))


def unique_report(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """(table, key, duplicate_keys, duplicate_rows, passed) for the key made of
    ``columns`` (NULL keys are not checked, as SQL uniqueness tests do)."""
    k = df.select(*columns).na.drop()
    dup = k.groupBy(*columns).count().where(F.col("count") > 1)
    return dup.agg(F.count(F.lit(1)).alias("duplicate_keys"),
                   F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows")) \
              .select(F.lit(table).alias("table"), F.lit(",".join(columns)).alias("key"),
                      "duplicate_keys", "duplicate_rows",
                      (F.col("duplicate_keys") == 0).alias("passed"))


def lookup_coverage(df: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str) -> DataFrame:
    """(lookup, keys, unmapped_keys) over the distinct non-null keys of ``df``."""
    keys = df.select(F.col(key).alias("__k")).where(F.col("__k").isNotNull()).distinct()
    d = dim.select(F.col(dim_key).alias("__k")).distinct()
    unmapped = keys.join(d, "__k", "left_anti")
    # Two one-row aggregates combined as scalar subqueries (no join needed).
    total = keys.agg(F.count(F.lit(1))).scalar()
    miss = unmapped.agg(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select(F.lit(name).alias("lookup"), total.alias("keys"),
                                           miss.alias("unmapped_keys"))
