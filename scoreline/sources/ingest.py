"""Loading several sources into tables, each on its own: one that fails stops no other."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .io import CORRUPT, replace_table
from .versions import discard, read_current, stage, swap

REPORT = "source string, status string, rows long, rejected_rows long, error string"
Source = Callable[[], DataFrame]


def error_name(e: Exception) -> str:
    """What failed, without its wording: Spark's error condition, else the exception's class."""
    condition = e.getCondition() if hasattr(e, "getCondition") else None
    return condition or type(e).__name__


def _status(rows, rejected):
    return F.when(rejected > 0, "rejected").when(rows == 0, "empty").otherwise("read")


def source_report(spark: SparkSession, sources: dict[str, Source]) -> DataFrame:
    """One row for each source, without writing any: (source, status, rows, rejected_rows,
    error). Status is 'read', 'rejected' (some lines don't fit), 'empty', or 'failed' for a
    source that can't be opened; only opening is tried when the report is built, rows
    are counted when it is read."""
    parts = []
    for name, read in sources.items():
        try:
            df = read()
        except Exception as e:  # noqa: BLE001 - whatever stops one source must not stop the others
            parts.append(spark.createDataFrame([(name, "failed", 0, 0, error_name(e))], REPORT))
            continue
        bad = F.count(CORRUPT) if CORRUPT in df.columns else F.lit(0).cast("long")
        counted = df.agg(F.count(F.lit(1)).alias("rows"), bad.alias("rejected_rows"))
        parts.append(counted.select(F.lit(name).alias("source"), _status(F.col("rows"), F.col("rejected_rows")).alias("status"), "rows", "rejected_rows", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], REPORT)


def _load(name: str, df: DataFrame, folder: str) -> tuple:
    """Write one source in one pass: rows that fit as the table ``folder/name``, the others
    beside them; both are counted on the way."""
    spark = df.sparkSession
    if CORRUPT not in df.columns:
        df = df.withColumn(CORRUPT, F.lit(None).cast("string"))
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("rejected")).withColumn("rejected", F.col(CORRUPT).isNotNull())
    staged = stage(rows, f"{folder}/{name}", partition_by="rejected")
    n, bad = seen.get["rows"], seen.get["rejected"]
    if n > bad:
        swap(spark, staged, "rejected=false")
    return staged, n, bad


def ingest_sources(spark: SparkSession, sources: dict[str, Source], folder: str) -> DataFrame:
    """Load each source into the table ``folder/<name>`` and return the report, which is also
    written as ``folder/ingest_report``.

    A source that can't be opened or fails while it is read is reported as 'failed'
    with its error; its table and those of the others stay or are replaced on their
    own. A table is replaced only if the source has rows that fit. Lines that don't
    fit (``_corrupt_record``) are kept as (source, line) in the quarantine table
    ``folder/quarantine``, which has the lines of this load."""
    folder = folder.rstrip("/")
    report, bad_lines, unused = [], [], []
    for name, read in sources.items():
        try:
            staged, n, bad = _load(name, read(), folder)
        except Exception as e:  # noqa: BLE001 - whatever stops one source must not stop the others
            report.append((name, "failed", 0, 0, error_name(e)))
            continue
        if bad:
            bad_lines.append(spark.read.parquet(f"{staged.folder}/rejected=true").select(F.lit(name).alias("source"), F.col(CORRUPT).alias("line")))
        if n <= bad:
            unused.append(staged)
        report.append((name, "rejected" if bad else "read" if n else "empty", n, bad, None))
    empty = spark.createDataFrame([], "source string, line string")
    replace_table(reduce(DataFrame.unionByName, bad_lines, empty), f"{folder}/quarantine")
    for staged in unused:
        discard(spark, staged)
    out = spark.createDataFrame(report, REPORT)
    replace_table(out, f"{folder}/ingest_report")
    return read_current(spark, f"{folder}/ingest_report")


def ingested(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a source that fitted, as loaded last."""
    return read_current(spark, f"{folder.rstrip('/')}/{name}").drop(CORRUPT)
