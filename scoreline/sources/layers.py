"""Layers as an explicit step: tables that a caller has built and named.

Without a layer folder every query computes from the driver tables, lazily. After
``use_layers`` the queries of that input folder read the layer tables instead, the way
the reference's pages read its materialised marts. Nothing is built on the side, and no
folder is chosen here: the caller names one that all executors share. In a ``memo`` scope
a layer is loaded or computed once and shared by the scope's queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .memo import shared
from .versions import read_current


def _key(sf_dir: str) -> str:
    return f"scoreline.layers:{sf_dir.rstrip('/')}"


def use_layers(spark: SparkSession, sf_dir: str, folder: str | None) -> None:
    """From now on queries over ``sf_dir`` read the layers in ``folder`` (None: compute)."""
    if folder is None:
        spark.conf.unset(_key(sf_dir))
    else:
        spark.conf.set(_key(sf_dir), folder.rstrip("/"))


def layer(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The layer table ``name`` of ``sf_dir`` if layers are in use, else ``build()``."""
    folder = spark.conf.get(_key(sf_dir), None)
    return shared(read_current(spark, f"{folder}/{name}") if folder else build())
