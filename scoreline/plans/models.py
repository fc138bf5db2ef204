"""Batch build of the silver and gold models as tables, in dependency order,
followed by their quality checks (the reference's transform + test steps).

Each model is written as a parquet table under ``out_dir/<model>``; models
downstream read the *written* upstream tables, so every layer boundary cuts
the lineage and a failed step can be rerun from the last written layer. The order
follows from the inputs that models declare (``build_order``). Models of one row
set per edition are partitioned by edition, and ``rebuild_editions`` rewrites the
partitions of changed editions alone; the other models are replaced as a whole
(``sources.versions``).

Bronze inputs are passed in as DataFrames (``bronze``: matches, cups,
countries, squads, market), so real CSV / JSON / HTML sources or the
stand-in views (``standin_bronze``) plug in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cleaning import stage_matches, stage_players
from ..operators.marts import edition_history_winner, nation_stats, nations_performance, players_profile
from ..operators.quality import not_null_report, unique_report
from ..sources.fixtures import FIXTURE_SQL, fixture
from ..sources.io import replace_table
from ..sources.layers import use_layers
from ..sources.versions import read_current, replace_partitions

Models = dict[str, tuple[list[str], Callable[[dict[str, DataFrame]], DataFrame]]]

# model -> (upstream models / bronze inputs, builder), in any order
MODELS: Models = {
    "stg_matches": (["matches"], lambda t: stage_matches(t["matches"])),
    "stg_nations": (["stg_matches"], lambda t: nation_stats(t["stg_matches"])),
    "stg_players": (["squads", "market"], lambda t: stage_players(t["squads"], t["market"], m90="m90")),
    "mart_nations_performance": (["stg_nations", "cups", "countries"],
                                 lambda t: nations_performance(t["stg_nations"], t["cups"], t["countries"])),
    "mart_edition_history": (["stg_matches"], lambda t: edition_history_winner(t["stg_matches"])),
    "mart_players_profile": (["stg_players"], lambda t: players_profile(t["stg_players"])),
}

# models whose rows of an edition follow from their inputs' rows of that edition
PARTITIONED = {"stg_matches": "edition_year", "mart_edition_history": "edition_year"}

# model -> (not-null columns, unique key) — the checks declared for each model
CHECKS = {
    "stg_matches": (["edition_year", "home_team", "away_team"], None),
    "stg_nations": (["nation"], ["nation"]),
    "stg_players": (["player_name"], None),
    "mart_nations_performance": (["nation"], ["nation"]),
    "mart_edition_history": (["team", "edition_year"], ["team", "edition_year"]),
    "mart_players_profile": (["player_name"], None),
}


def standin_bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Bronze inputs from the stand-in views over the driver tables."""
    return {"matches": fixture(spark, sf_dir, "fx_matches_null"), "cups": fixture(spark, sf_dir, "fx_cups"),
            "countries": fixture(spark, sf_dir, "fx_countries"), "squads": fixture(spark, sf_dir, "fx_squads"),
            "market": fixture(spark, sf_dir, "fx_market")}


def build_layers(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """Write the layers that queries read (bronze and silver matches, both marts) into
    ``folder``, which all executors share, each from the written one below, and use
    them for queries over ``sf_dir``. Returns the folder."""
    from .q_players import players_mart
    folder = folder.rstrip("/")
    use_layers(spark, sf_dir, None)
    replace_table(fixture(spark, sf_dir, "fx_matches"), f"{folder}/bronze_matches")
    bronze = read_current(spark, f"{folder}/bronze_matches")
    bronze.createOrReplaceTempView("fx_matches")
    replace_table(stage_matches(spark.sql(FIXTURE_SQL["fx_matches_null"])), f"{folder}/stg_matches")
    replace_table(players_mart(spark, sf_dir), f"{folder}/mart_players")
    cups = spark.sql(FIXTURE_SQL["fx_cups"])
    nations = nations_performance(nation_stats(read_current(spark, f"{folder}/stg_matches")), cups, fixture(spark, sf_dir, "fx_countries"))
    replace_table(nations, f"{folder}/mart_nations")
    use_layers(spark, sf_dir, folder)
    return folder


def build_order(models: Models = MODELS, bronze: set[str] | None = None) -> list[str]:
    """Models after all that they read, by a topological sort of their declared inputs.
    Raises ValueError for models that need each other, and, given the names of the
    bronze inputs, for an input that is neither one of them nor a model."""
    for name, (inputs, _) in models.items():
        missing = [i for i in inputs if bronze is not None and i not in bronze and i not in models]
        if missing:
            raise ValueError(f"model {name} needs {missing}")
    graph = TopologicalSorter({name: [i for i in inputs if i in models] for name, (inputs, _) in models.items()})
    try:
        return list(graph.static_order())
    except CycleError as e:
        raise ValueError(f"models need each other: {' -> '.join(reversed(e.args[1]))}") from None


def read_model(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A written model; ``schema`` restores the order and types of a partitioned one."""
    if schema is None:
        return read_current(spark, path)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def _write_model(df: DataFrame, name: str, path: str) -> DataFrame:
    if name in PARTITIONED:
        replace_partitions(df, path, PARTITIONED[name])
        return read_model(df.sparkSession, path, df.schema)
    replace_table(df, path)
    return read_model(df.sparkSession, path)


def run_models(spark: SparkSession, bronze: dict[str, DataFrame], out_dir: str,
               only: list[str] | None = None, models: Models = MODELS) -> dict[str, str]:
    """Write every model (or ``only`` these) in dependency order; returns
    model -> path. Upstream models are read back from their written tables."""
    out_dir = out_dir.rstrip("/")
    tables: dict[str, DataFrame] = dict(bronze)
    paths: dict[str, str] = {}
    for name in build_order(models, set(bronze)):
        paths[name] = f"{out_dir}/{name}"
        if only is None or name in only:
            tables[name] = _write_model(models[name][1](tables), name, paths[name])
        else:
            tables[name] = read_model(spark, paths[name])
    return paths


def rebuild_editions(spark: SparkSession, bronze: dict[str, DataFrame], out_dir: str, editions: list[int | None],
                     changed: tuple[str, ...] = ("matches",), models: Models = MODELS) -> list[str]:
    """After rows of ``editions`` have changed in the bronze inputs ``changed``: bring the models
    that depend on them up to date. Partitioned models get the partitions of these
    editions rewritten (removed where no rows are left), from the partitions of these
    editions below; the other models are replaced. Returns the models written."""
    out_dir = out_dir.rstrip("/")
    tables, stale, written = dict(bronze), set(changed), []
    for name in build_order(models, set(bronze)):
        inputs, build = models[name]
        path = f"{out_dir}/{name}"
        if not stale & set(inputs):
            tables[name] = read_model(spark, path)
            continue
        df = build(tables)
        if name in PARTITIONED:
            by = PARTITIONED[name]
            touched = reduce(lambda a, b: a | b, [F.col(by).eqNullSafe(F.lit(e)) for e in editions], F.lit(False))
            replace_partitions(df.where(touched), path, by, editions)
            tables[name] = read_model(spark, path, df.schema)
        else:
            tables[name] = _write_model(df, name, path)
        stale.add(name)
        written.append(name)
    return written


def check_models(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Not-null and uniqueness checks of the written models, as one frame:
    (table_name, check, column_name, failing_rows, passed)."""
    parts = []
    for name, (not_null, key) in CHECKS.items():
        if name not in paths:
            continue
        df = read_model(spark, paths[name])
        nn = not_null_report(df, name, not_null).select(
            F.col("table").alias("table_name"), F.lit("not_null").alias("check"),
            F.col("column").alias("column_name"), F.col("null_rows").alias("failing_rows"), "passed")
        parts.append(nn)
        if key:
            uq = unique_report(df, name, key).select(
                F.col("table").alias("table_name"), F.lit("unique").alias("check"),
                F.col("key").alias("column_name"), F.col("duplicate_rows").alias("failing_rows"), "passed")
            parts.append(uq)
    return reduce(lambda a, b: a.unionByName(b), parts)


def _submitted() -> bool:
    import os
    return "SPARK_ENV_LOADED" in os.environ or "PYSPARK_GATEWAY_PORT" in os.environ


def main(argv: list[str] | None = None) -> int:
    """Build every model from the stand-in bronze inputs of ``--sf`` into
    ``--out`` and print the check report; exit code 1 if a check fails.

    python -m scoreline.plans.models --sf /root/testdata/sf0.01 --out /shared/models
    """
    import argparse

    from ..session import build_session
    ap = argparse.ArgumentParser(description=main.__doc__.splitlines()[0])
    ap.add_argument("--sf", required=True, help="folder with the driver tables")
    ap.add_argument("--out", required=True, help="folder for the model tables (shared storage on a cluster)")
    ap.add_argument("--master", default=None, help="e.g. local[*]; default: as set by spark-submit")
    args = ap.parse_args(argv)
    spark = build_session(master=args.master or ("local[*]" if not _submitted() else None))
    paths = run_models(spark, standin_bronze(spark, args.sf), args.out)
    report = check_models(spark, paths).orderBy("table_name", "check", "column_name")
    rows = report.collect()  # one row per declared check: bounded by the check list
    for r in rows:
        print(f"{'PASS' if r.passed else 'FAIL'} {r.table_name} {r.check}({r.column_name}) failing_rows={r.failing_rows}")
    spark.stop()
    return 0 if all(r.passed for r in rows) else 1


if __name__ == "__main__":
    raise SystemExit(main())
