"""Data-quality and ingest-report queries: not-null and unique checks on the
models, lookup coverage, ingest counts, multi-source union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.facts import team_names
from ..operators.marts import edition_history_winner, nation_stats
from ..operators.quality import lookup_coverage, not_null_report, unique_report
from ..sources.dims import POSITION_PT, confederation_map, dim_frame, values_sql
from ..sources.fixtures import fixture
from ..sources.io import union_sources, with_source
from .oracle import ALL_TEAMS, MART_NATIONS, MART_PLAYERS, STG_MATCHES, STG_NATIONS, STG_PLAYERS
from .q_matches import nations_mart, staged
from .q_players import players_mart, staged_players
from .registry import osql, register

ALL_FX = ["fx_matches_null", "fx_cups", "fx_squads", "fx_market", "fx_countries", "fx_cache"]
CTES = [STG_MATCHES, ALL_TEAMS, STG_NATIONS, MART_NATIONS, STG_PLAYERS, MART_PLAYERS,
        ("hist", "SELECT DISTINCT team, edition_year FROM all_teams")]


def _nn(table, col):
    return (f"SELECT '{table}' AS table_name, '{col}' AS column_name, COUNT(*) AS rows, "
            f"COUNT(*) FILTER (WHERE {col} IS NULL) AS null_rows, "
            f"COUNT(*) FILTER (WHERE {col} IS NULL) = 0 AS passed FROM {table}")


# The declared checks: columns that must not be null, and unique keys, by table.
NOT_NULL = {"fx_cups": ["winner"], "stg_matches": ["edition_year", "home_team", "away_team"], "stg_nations": ["nation"],
            "stg_players": ["player_name"], "mart_nations": ["nation"], "hist": ["edition_year"], "mart_players": ["player_name"]}
# The last three do not hold by construction: the tables are not grouped by these keys.
UNIQUE = {"stg_nations": ["nation"], "mart_nations": ["nation"], "hist": ["team", "edition_year"], "fx_countries": ["country_name"],
          "fx_cache": ["name"], "stg_players": ["nation", "position"]}


def _checked(spark, sf, name):
    """The table that a check is declared on."""
    if name.startswith("fx_"):
        return fixture(spark, sf, name)
    if name == "mart_players":
        return players_mart(spark, sf)
    if name == "stg_players":
        return staged_players(spark, sf)
    if name == "mart_nations":
        return nations_mart(spark, sf)
    m = staged(spark, sf)
    return {"stg_matches": lambda: m, "stg_nations": lambda: nation_stats(m), "hist": lambda: edition_history_winner(m)}[name]()


@register("dq_not_null", osql(ALL_FX, CTES, "\nUNION ALL\n".join(_nn(t, c) for t, cols in NOT_NULL.items() for c in cols)), "D1")
def q_dq_not_null(spark, sf):
    reports = [not_null_report(_checked(spark, sf, t), t, cols) for t, cols in NOT_NULL.items()]
    return reduce(lambda a, b: a.unionByName(b), reports).withColumnsRenamed(
        {"table": "table_name", "column": "column_name"})


def _uq(table, cols):
    k = ", ".join(cols)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT '{table}' AS table_name, '{','.join(cols)}' AS key, COUNT(*) AS duplicate_keys, "
            f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows, COUNT(*) = 0 AS passed FROM "
            f"(SELECT {k}, COUNT(*) AS n FROM {table} WHERE {nn} GROUP BY {k} HAVING COUNT(*) > 1) d")


@register("dq_unique", osql(ALL_FX, CTES, "\nUNION ALL\n".join(_uq(t, c) for t, c in UNIQUE.items())), "D2")
def q_dq_unique(spark, sf):
    reports = [unique_report(_checked(spark, sf, t), t, cols) for t, cols in UNIQUE.items()]
    return reduce(lambda a, b: a.unionByName(b), reports).withColumnRenamed("table", "table_name")


@register("lookup_coverage", osql(ALL_FX, CTES, f"""
SELECT 'confederation' AS lookup, COUNT(*) AS keys, COUNT(*) FILTER (WHERE d.key IS NULL) AS unmapped_keys
FROM (SELECT home_team AS k FROM stg_matches UNION SELECT away_team FROM stg_matches) n
LEFT JOIN {values_sql(confederation_map(), "key", "v", "d")} ON n.k = d.key WHERE n.k IS NOT NULL AND n.k <> ''
UNION ALL
SELECT 'position_label', COUNT(*), COUNT(*) FILTER (WHERE d.key IS NULL)
FROM (SELECT DISTINCT position_group AS k FROM mart_players) n
LEFT JOIN {values_sql(POSITION_PT, "key", "v", "d")} ON n.k = d.key WHERE n.k IS NOT NULL"""), "D3")
def q_lookup_coverage(spark, sf):
    names = team_names(staged(spark, sf))
    conf = dim_frame(spark, confederation_map())
    pos = dim_frame(spark, POSITION_PT)
    return lookup_coverage(names, "nation", conf, "key", "confederation").unionByName(
        lookup_coverage(players_mart(spark, sf), "position_group", pos, "key", "position_label"))


@register("ingest_counts", osql(ALL_FX, CTES, """
SELECT 'stg_matches' AS table_name, COUNT(*) AS rows, COUNT(*) FILTER (WHERE winner = 'Draw') AS flagged FROM stg_matches
UNION ALL SELECT 'countries', COUNT(*), COUNT(*) FILTER (WHERE qualified_2026) FROM fx_countries
UNION ALL SELECT 'stg_players', COUNT(*), COUNT(*) FILTER (WHERE market_value_eur_m IS NULL) FROM stg_players"""), "A22")
def q_ingest_counts(spark, sf):
    m = staged(spark, sf)
    parts = [
        m.agg(F.lit("stg_matches").alias("table_name"), F.count(F.lit(1)).alias("rows"),
              F.count_if(F.col("winner") == "Draw").alias("flagged")),
        fixture(spark, sf, "fx_countries").agg(F.lit("countries").alias("table_name"), F.count(F.lit(1)).alias("rows"),
                                        F.count_if(F.col("qualified_2026")).alias("flagged")),
        staged_players(spark, sf).agg(F.lit("stg_players").alias("table_name"), F.count(F.lit(1)).alias("rows"),
                                      F.count_if(F.col("market_value_eur_m").isNull()).alias("flagged")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("multi_source_union", osql(["fx_squads", "fx_market"], [], """
SELECT 'squads' AS nation, nation AS player_nationality, player, pos, age, mp, gls, ast, m90,
       NULL::VARCHAR AS player_name, NULL::DOUBLE AS market_value_eur_m FROM fx_squads
UNION ALL
SELECT 'market', nation, NULL, NULL, NULL, NULL, NULL, NULL, NULL, player_name, market_value_eur_m FROM fx_market"""),
          "S12 S13 U3")
def q_multi_source_union(spark, sf):
    frames = [with_source(fixture(spark, sf, "fx_squads"), "squads"), with_source(fixture(spark, sf, "fx_market"), "market")]
    return union_sources(frames)
