"""A scope in which loaded frames are computed once and shared by all queries.

    with memo(spark):
        ...  # layers and frames passed through ``shared`` stay persisted here

Frames are known by their plan, so that two queries that load the same table in their own
words share one copy. The scope's end frees them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


class Memo:
    """The frames that a scope holds."""

    def __init__(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.level, self.frames = level, []

    def frame(self, df: DataFrame) -> DataFrame:
        """``df`` persisted, or the frame of the same plan that already is. Partitions that
        don't fit into memory go to disk; a lost one is computed again."""
        for held in self.frames:
            if held.sameSemantics(df):
                return held
        self.frames.append(df.persist(self.level))
        return df

    def free(self) -> None:
        for df in self.frames:
            df.unpersist(blocking=True)
        self.frames = []


_OPEN: dict[str, list[Memo]] = {}


@contextmanager
def memo(spark: SparkSession, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[Memo]:
    """Open a scope for queries of this session's application; scopes nest, the inner one
    frees what it added."""
    held = Memo(level)
    scopes = _OPEN.setdefault(spark.sparkContext.applicationId, [])
    scopes.append(held)
    try:
        yield held
    finally:
        scopes.remove(held)
        held.free()


def shared(df: DataFrame) -> DataFrame:
    """``df`` through the open scopes, or as it is without any."""
    scopes = _OPEN.get(df.sparkSession.sparkContext.applicationId, [])
    for held in scopes[:-1]:
        for frame in held.frames:
            if frame.sameSemantics(df):
                return frame
    return scopes[-1].frame(df) if scopes else df
