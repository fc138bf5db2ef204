"""Intermediate tables in the cluster's shared folder.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it
back, so a lost executor never loses the only copy of an intermediate result.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: While a table is written: rows of an Arrow batch, and that its shuffle files go as soon as
#: it is there (nothing reads them again, as the table cuts the lineage).
WHILE_WRITTEN = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. A machine-local folder is
    used only when the setting is missing and the master is local (tests);
    without the setting a cluster session raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="llm-")
    return _LOCAL[spark.sparkContext.applicationId]


_LOCAL: dict[str, str] = {}


def importable(spark: SparkSession) -> None:
    """Let Python tasks import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; never one that was used before."""
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back. Python tasks get
    small Arrow batches meanwhile: rows may be whole texts, and each batch is held by
    the JVM and by the Python worker at once."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = {key: spark.conf.get(key, None) for key in WHILE_WRITTEN}
    try:
        for key, value in WHILE_WRITTEN.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once nothing reads them any more: neither what is
    returned nor what it is made of when it is computed again."""
    for table in tables:
        spark, top = table.sparkSession, shared_dir(table.sparkSession).rsplit("/", 1)[1]
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            # only folders of fresh_path
            if folder.rsplit("/", 1)[1].startswith("llm-") and folder.rsplit("/", 2)[1] == top:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
