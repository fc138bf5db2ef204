"""Tables that are replaced as a whole while others read them.

A table is a folder of small pointer files, one for each version, and its data lies in
folders beside it: ``<path>/_versions/<number>`` names ``<path>.data/<id>``. A replacement
has two phases: the rows are written into a fresh data folder (``stage``), then the next
pointer appears by one rename (``swap``). Until then readers see the old version whole;
a reader that started on it ends on it, as old data stays until ``vacuum``. A write that
fails or is lost between the phases leaves an unused folder and the old version.

Pointers are numbered, and one number is taken once: of two writers that started from the
same version the second gets ``Conflict``, and ``update_table`` starts it again from the
first one's result.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


@dataclass(frozen=True)
class Staged:
    """Rows written but not yet published: their folder and number, and the version that
    they replace (0: none)."""

    path: str
    folder: str
    rows: int
    base: int


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def folder_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, bytes) of what lies in a folder; nothing if it is missing."""
    fs, where = _fs(spark, folder)
    return [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(where)] if fs.exists(where) else []


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the table's file system, whole or not at all: written under another
    name and renamed. An existing file is never replaced (FileExistsError)."""
    fs, where = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(where)
    out.write(bytearray(text.encode()))
    out.close()
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()) if where.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(files.makeQualified(where), files.makeQualified(to), none)
    except Py4JJavaError as e:
        fs.delete(where, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise FileExistsError(path) from None
        raise


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table, oldest first; empty if it was never published."""
    return sorted(int(n) for n, _ in folder_files(spark, f"{path.rstrip('/')}/_versions") if n.isdigit())


def version_folder(spark: SparkSession, path: str, version: int) -> str:
    """The folder that holds a version's rows."""
    fs, where = _fs(spark, f"{path.rstrip('/')}/_versions/{version:012d}")
    stream = fs.open(where)
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return f"{path.rstrip('/')}.data/{text}"


def read_current(spark: SparkSession, path: str, fmt: str = "parquet", version: int | None = None) -> DataFrame:
    """The current version of the table at ``path`` (or the one asked for). A folder without
    versions is read as it is; a missing one raises as Spark's readers do."""
    found = versions(spark, path)
    if not found and version is None:
        return spark.read.format(fmt).load(path)
    return spark.read.format(fmt).load(version_folder(spark, path, version or found[-1]))


def stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> Staged:
    """Phase one: write ``df`` beside the table. The rows are counted while they are written,
    so that ``df`` is computed once."""
    spark, path = df.sparkSession, path.rstrip("/")
    base = (versions(spark, path) or [0])[-1]
    folder, seen = f"{path}.data/{uuid.uuid4().hex}", Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(fmt)
    try:
        (writer.partitionBy(partition_by) if partition_by else writer).save(folder)
    except Exception:
        discard(spark, Staged(path, folder, 0, base))
        raise
    return Staged(path, folder, seen.get["rows"], base)


def swap(spark: SparkSession, staged: Staged, part: str = "") -> int:
    """Phase two: make staged rows (or their subfolder ``part``) the current version; returns its
    number. Raises ``Conflict`` if another writer has published since."""
    number = staged.base + 1
    fs, where = _fs(spark, f"{staged.path}/_versions")
    fs.mkdirs(where)
    try:
        write_small(spark, f"{staged.path}/_versions/{number:012d}", "/".join([staged.folder.rsplit("/", 1)[1], *([part] if part else [])]))
    except FileExistsError:
        raise Conflict(f"version {number} of {staged.path} has been published by another writer") from None
    return number


def discard(spark: SparkSession, staged: Staged) -> None:
    """Remove rows that were staged and will not be published."""
    fs, where = _fs(spark, staged.folder)
    fs.delete(where, True)


def update_table(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], fmt: str = "parquet", attempts: int = 5) -> int:
    """Publish ``change(current rows)`` (None for a table without versions) as the next version.
    The current rows may be read by it: they stay where they are. After a ``Conflict``
    the change is made again, on what the other writer published."""
    for attempt in range(attempts):
        found = versions(spark, path)
        staged = stage(change(read_current(spark, path, fmt, found[-1]) if found else None), path, fmt)
        try:
            if staged.base != (found or [0])[-1]:
                raise Conflict(f"{path} has changed while it was read")
            return swap(spark, staged)
        except Conflict:
            discard(spark, staged)
            if attempt + 1 == attempts:
                raise
            time.sleep(0.05 * 2**attempt)
    raise ValueError("attempts must be at least 1")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[int]:
    """Drop all versions but the last ``keep`` with their data; returns their numbers.
    Readers of a dropped version fail: call it when none are left. Folders that were
    staged and not published are not touched."""
    found, path = versions(spark, path), path.rstrip("/")
    gone = found[: max(0, len(found) - max(1, keep))]
    held = {version_folder(spark, path, v).removeprefix(f"{path}.data/").split("/")[0] for v in found[len(gone) :]}
    for v in gone:
        top = version_folder(spark, path, v).removeprefix(f"{path}.data/").split("/")[0]
        fs, pointer = _fs(spark, f"{path}/_versions/{v:012d}")
        fs.delete(pointer, False)
        if top not in held:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.data/{top}"), True)
    return gone


def replace_partitions(df: DataFrame, path: str, by: str, touched: list | None = None) -> None:
    """Write a table partitioned by ``by``. With ``touched``, values of ``by`` (None for null),
    ``df`` has the rows of these alone: only their partitions are rewritten (dynamic
    partition overwrite), those without rows are removed, and no other file changes."""
    spark = df.sparkSession
    if touched is None:
        df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "static").parquet(path)
        return
    seen = Observation()
    df = df.observe(seen, F.collect_set(by).alias("values"), F.count_if(F.col(by).isNull()).alias("nulls"))
    df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)
    left = set(seen.get["values"]) | ({None} if seen.get["nulls"] else set())
    for value in touched:
        if value not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            fs, where = _fs(spark, f"{path.rstrip('/')}/{by}={name}")
            fs.delete(where, True)
