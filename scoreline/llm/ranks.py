"""Places of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place from 0 in their group by ``order`` (ascending,
    nulls first). A group may be any share of the table: rows are sorted by ranges of group
    and order, and a range's rows of a group start after those of earlier ranges, known
    from one count for each range and group. Null is a group of its own."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    sort = saved(sort.withColumn("_row", F.monotonically_increasing_id()), "ranges")
    # the upper bits of _row are the range, the lower its rows in order
    part = F.shiftright("_row", 33)
    counted = sort.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    held = sort.join(counted, F.col(group).eqNullSafe(F.col("_group")) & (part == F.col("_part")))
    return held.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias("rank"))
