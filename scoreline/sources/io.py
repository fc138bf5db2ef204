"""Readers and sinks: CSV with declared types, header normalisation, GeoJSON
features, key-value JSON caches, replace-table writes.

All readers return lazy DataFrames; nothing is read on the driver. Writes go
through Spark writers (one file per task), so they are retried per task if an
executor is lost.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_header, normalize_header_ws
from .versions import discard, folder_files, read_current, stage, swap, version_folder, versions, write_small


CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             header: bool = True, strict: bool = False) -> DataFrame:
    """CSV scan. With ``schema`` the types are declared (no inference pass over
    the data) and a line that does not fit them keeps its text in ``_corrupt_record``
    (NULL for good lines), or fails the read if ``strict``. Without a schema every
    column is read as text."""
    r = spark.read.option("header", header)
    if schema is None:
        return r.option("mode", "PERMISSIVE").csv(path)
    if strict:
        return r.option("mode", "FAILFAST").schema(schema).csv(path)
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    return r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(fields).csv(path)


def parse_csv_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema`` parsed from the text column ``line``, and
    ``_corrupt_record`` as in ``read_csv``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_csv(F.col(line), f"{schema}, {CORRUPT} STRING", options)
    return df.select("*", parsed.alias("__csv")).select(*[F.col(c) for c in df.columns], "__csv.*")


def reject_report(df: DataFrame, source: str) -> DataFrame:
    """(source, rows, rejected_rows) of a frame with a ``_corrupt_record`` column."""
    return df.agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("rows"), F.count(CORRUPT).alias("rejected_rows"))


def normalize_headers(df: DataFrame, rule: str = "csv") -> DataFrame:
    """Rename columns by the loaders' header rules (metadata only): 'csv' =
    strip, lower, space -> '_'; 'html' = whitespace runs -> '_', lower."""
    f = normalize_header if rule == "csv" else normalize_header_ws
    return df.toDF(*[f(c) for c in df.columns])


def with_source(df: DataFrame, value: str, col: str = "nation",
                collision: str = "player_nationality") -> DataFrame:
    """Prepend a constant source column; an existing column of that name is
    renamed to ``collision`` first."""
    if col in df.columns:
        df = df.withColumnRenamed(col, collision)
    return df.select(F.lit(value).alias(col), "*")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate per-source frames whose columns may differ (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


GEO_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StringType()),
    ]))),
])


def read_features(spark: SparkSession, path: str, fmt: str = "lines") -> DataFrame:
    """GeoJSON -> one row per feature with its properties map and geometry
    kept as JSON text. ``fmt="lines"``: one feature per line (what
    ``write_features`` writes). ``fmt="collection"`` is for import only: the format
    puts a whole FeatureCollection file in one row of one task."""
    if fmt == "lines":
        feature = GEO_SCHEMA["features"].dataType.elementType
        return spark.read.schema(feature).json(path).select("properties", "geometry")
    raw = spark.read.schema(GEO_SCHEMA).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry"))


def country_rows(features: DataFrame, qualified: DataFrame | None = None,
                 name_key: str = "name", iso_key: str = "ISO3166-1-Alpha-3") -> DataFrame:
    """(country_name, iso_a3, qualified_2026): missing name / iso -> ''. The
    qualified flag is membership in ``qualified`` (a one-column frame of names)."""
    p = F.col("properties")
    rows = features.select(F.coalesce(F.nullif(p.getItem(name_key), F.lit("")), F.lit("")).alias("country_name"),
                           F.coalesce(p.getItem(iso_key), F.lit("")).alias("iso_a3"))
    if qualified is None:
        return rows.withColumn("qualified_2026", F.lit(False))
    # Distinct names: the join cannot fan out. The planner broadcasts the
    # list when it is measured small.
    q = qualified.select(F.col(qualified.columns[0]).alias("__q")).distinct()
    return (rows.join(q, F.col("country_name") == F.col("__q"), "left")
                .select("country_name", "iso_a3", F.col("__q").isNotNull().alias("qualified_2026")))


def named_features(features: DataFrame, name_key: str = "name") -> DataFrame:
    """Features that have a non-empty name (the map loader skips the rest)."""
    return features.where(F.coalesce(F.col("properties").getItem(name_key), F.lit("")) != "")


def feature_text(features: DataFrame) -> DataFrame:
    """(text): each feature as one line of JSON; its geometry, which is JSON text, goes in as it is."""
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), "properties"))
    return features.select(F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit("}")).alias("text"))


def parse_feature_text(lines: DataFrame) -> DataFrame:
    """(properties, geometry) of lines of JSON, with or without a comma in front; other lines
    (the head and tail of a document) have none."""
    feature = GEO_SCHEMA["features"].dataType.elementType
    text = F.regexp_replace("text", "^,", "")
    return lines.where(text.startswith("{") & text.endswith("}")).select(F.from_json(text, feature).alias("f")).select("f.properties", "f.geometry")


def write_features(features: DataFrame, path: str) -> None:
    """Write features as JSON lines, one feature per line (a distributed writer)."""
    features.select(F.lit("Feature").alias("type"), "properties", "geometry") \
            .write.mode("overwrite").json(path)


def write_feature_collection(features: DataFrame, path: str, order: list) -> None:
    """Write one FeatureCollection document as a folder of ordered parts: ``head.txt``, a part per
    task with its features joined by commas, a comma after every part but the last, ``tail.txt``.
    The parts' texts in order of their names are the document (``cat path/*.txt``). Features
    are in ``order`` (columns), by a range sort: no task holds them all, and the
    driver knows parts by their names and sizes alone. An empty frame is an empty collection."""
    spark, path = features.sparkSession, path.rstrip("/")
    lines = feature_text(features.orderBy(*order))
    # the lower bits are the row within its task
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.select(F.concat(F.when(first, "").otherwise(","), F.col("text")).alias("text")).write.mode("overwrite").text(path)
    parts = sorted(name for name, size in folder_files(spark, path) if name.startswith("part-") and size)
    write_small(spark, f"{path}/head.txt", '{"type": "FeatureCollection", "features": [\n')
    for name in parts[:-1]:
        # sorts after its part and before the next one
        write_small(spark, f"{path}/{name[:10]}~.txt", ",\n")
    write_small(spark, f"{path}/tail.txt", "]}\n")


def read_feature_collection(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of a document written by ``write_feature_collection``: each line
    is a feature, so that tasks read parts on their own."""
    return parse_feature_text(spark.read.text(path).withColumnRenamed("value", "text"))


def read_kv_json(spark: SparkSession, path: str, key: str = "name", value: str = "url",
                 fmt: str = "lines") -> DataFrame:
    """A key-value cache -> (key, value) rows. ``fmt="lines"``: one {"name": ...,
    "url": ...} per line (what ``write_kv_json`` writes). ``fmt="object"`` is for
    import only: one JSON object {key: value, ...} per file, which the format puts in
    one row of one task. A missing path and unreadable lines give no rows; any other
    error (storage, permission) is raised, so that it is never taken for an empty cache."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())])
    try:
        if fmt == "lines":
            found = versions(spark, path)
            out = spark.read.schema(schema).json(version_folder(spark, path, found[-1]) if found else path).where(F.col(key).isNotNull())
        else:
            txt = spark.read.option("wholetext", True).text(path)
            m = F.from_json(F.col("value"), T.MapType(T.StringType(), T.StringType()))
            out = txt.select(F.explode(m).alias(key, value))
        out.schema  # noqa: B018 - resolves the path now
        return out
    except AnalysisException as e:
        if not _missing_path(e):
            raise
        return spark.createDataFrame([], schema)


def _missing_path(e: AnalysisException) -> bool:
    return (e.getCondition() or "") == "PATH_NOT_FOUND"


def write_kv_json(df: DataFrame, path: str, key: str = "name", value: str = "url") -> None:
    """(key, value) rows -> JSON lines {"name": ..., "url": ...}, as the next version of the
    cache at ``path``. One line per entry, written by every task in parallel (a single
    JSON object would have to be assembled in one task). ``df`` may read the cache that it
    replaces."""
    replace_table(df.select(key, value), path, "json")


def replace_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """CREATE OR REPLACE: publish ``df`` as the next version of the table at ``path``
    (``versions``). Readers see the old rows or the new ones, never a part of either."""
    swap(df.sparkSession, stage(df, path, fmt))


def replace_if_rows(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Replace the table only when ``df`` has rows (the old one stays otherwise). ``df`` is
    computed once: its rows are counted while they are written beside the table."""
    staged = stage(df, path, fmt)
    if staged.rows:
        swap(df.sparkSession, staged)
    else:
        discard(df.sparkSession, staged)
    return staged.rows > 0


def table_or_fallback(spark: SparkSession, path: str, fallback, fmt: str = "parquet") -> DataFrame:
    """Read the stored table at ``path``; when it is missing or empty use
    ``fallback()`` (a function building the same rows from earlier layers). Other
    errors are raised."""
    try:
        df = read_current(spark, path, fmt)
        if not df.isEmpty():
            return df
    except AnalysisException as e:
        if not _missing_path(e):
            raise
    return fallback()
