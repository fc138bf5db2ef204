"""Gold layer: per-side all-time stats, per-edition histories, player profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pct1, pct1_float32
from ..sources.dims import POSITION_GROUPS
from .facts import both_sides


def _count_when(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def nation_stats(matches: DataFrame, draw: str = "Draw") -> DataFrame:
    """All-time stats per side from staged matches.

    One pass over ``both_sides``; Spark aggregates partially on each task
    (map-side) before the shuffle on ``team``, so a side holding a large share
    of the rows costs one partial row per task, not a hot reducer. The single
    COUNT(DISTINCT edition) is planned as a (team, edition) pre-aggregation.
    """
    s = both_sides(matches)
    t, w = F.col("team"), F.col("winner")
    return s.groupBy(t.alias("nation")).agg(
        F.count_distinct("edition_year").alias("editions_played"),
        F.count(F.lit(1)).alias("total_matches"),
        _count_when(w == t).alias("wins"),
        _count_when(w == draw).alias("draws"),
        _count_when(w.isNotNull() & (w != t) & (w != draw)).alias("losses"),
        F.sum("goals_for").alias("total_goals_for"),
        F.sum("goals_against").alias("total_goals_against"),
        F.min("edition_year").alias("first_edition"),
        F.max("edition_year").alias("last_edition"),
    )


def titles_per_winner(cups: DataFrame, winner="winner") -> DataFrame:
    """Editions won per winner name (grouped case-sensitively, as the reference)."""
    return cups.groupBy(F.col(winner).alias("nation")).agg(F.count(F.lit(1)).alias("titles"))


def nations_performance(stats: DataFrame, cups: DataFrame, countries: DataFrame,
                        winner="winner", country="country_name", iso="iso_a3",
                        qualified="qualified_2026", float32: bool = False) -> DataFrame:
    """stats LEFT JOIN titles LEFT JOIN countries, both on lower(name).

    Titles and countries are small derived tables (one row per edition winner /
    per country); the planner broadcasts them when their runtime size is under
    the threshold (AQE re-plans from the actual shuffle size) and falls back
    to a sort-merge join otherwise. Names are matched case-insensitively
    without aliases, so different spellings do not match (reference rule).
    ``float32=True`` computes win_pct with the reference's 32-bit float steps
    (FloatType); the default is double precision.
    """
    t = titles_per_winner(cups, winner).select(F.lower("nation").alias("__tkey"), "titles")
    g = countries.select(F.lower(country).alias("__gkey"), F.col(iso).alias("iso_a3"),
                         F.col(qualified).alias("__q"))
    j = (stats.withColumn("__nkey", F.lower("nation"))
              .join(t, F.col("__nkey") == F.col("__tkey"), "left")
              .join(g, F.col("__nkey") == F.col("__gkey"), "left"))
    return j.select(
        *[F.col(c) for c in stats.columns],
        F.coalesce(F.col("titles"), F.lit(0)).alias("world_cup_titles"),
        F.col("iso_a3"),
        F.coalesce(F.col("__q"), F.lit(False)).alias("qualified_2026"),
        (pct1_float32 if float32 else pct1)("wins", "total_matches").alias("win_pct"),
    )


def edition_history_winner(matches: DataFrame, draw: str = "Draw") -> DataFrame:
    """Per (team, edition): matches, wins/draws/losses from ``winner``, goals
    and the lexically largest stage (reference rule, see ``furthest_stage_ranked``).

    A string MAX cannot use hash aggregation (Spark falls back to a sort
    aggregate over every row), so the rows are first hash-aggregated per
    (team, edition, stage) with all counts and sums; the string MAX then runs
    over a handful of distinct stages per group.
    """
    s = both_sides(matches, keep=("edition_year", "winner", "stage"))
    t, w = F.col("team"), F.col("winner")
    per_stage = s.groupBy("team", "edition_year", "stage").agg(
        F.count(F.lit(1)).alias("n"),
        _count_when(w == t).alias("w"),
        _count_when(w == draw).alias("d"),
        _count_when(~w.isin(t, F.lit(draw))).alias("l"),
        F.sum("goals_for").alias("gf"),
        F.sum("goals_against").alias("ga"),
    )
    return per_stage.groupBy("team", "edition_year").agg(
        F.sum("n").alias("matches_played"),
        F.sum("w").alias("wins"),
        F.sum("d").alias("draws"),
        F.sum("l").alias("losses"),
        F.sum("gf").alias("goals_scored"),
        F.sum("ga").alias("goals_conceded"),
        F.max("stage").alias("furthest_stage"),
    )


def edition_history_goals(matches: DataFrame) -> DataFrame:
    """Per (team, edition) from the goals: a match with a NULL score is neither
    a win, a draw nor a loss (the parameterised page query's rule)."""
    s = both_sides(matches)
    gf, ga = F.col("goals_for"), F.col("goals_against")
    return s.groupBy("team", "edition_year").agg(
        F.count(F.lit(1)).alias("games"),
        _count_when(gf > ga).alias("wins"),
        _count_when(gf == ga).alias("draws"),
        _count_when(gf < ga).alias("losses"),
        F.sum(gf).alias("goals_scored"),
        F.sum(ga).alias("goals_conceded"),
    )


def furthest_stage_ranked(matches: DataFrame, stage_order: list[str]) -> DataFrame:
    """Per (team, edition): the furthest stage by an explicit order (later in
    ``stage_order`` = further); unknown stages rank lowest, ties broken by the
    stage text. Also returns the lexical maximum for comparison. Distinct
    (team, edition, stage) rows are found by hash aggregation first, so the
    string comparisons run over a few rows per group."""
    s = both_sides(matches, keep=("edition_year", "stage"))
    stages = s.groupBy("team", "edition_year", "stage").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in stage_order]), F.col("stage"))
    return stages.groupBy("team", "edition_year").agg(
        F.max_by("stage", F.struct(rank.alias("r"), F.col("stage").alias("s"))).alias("furthest_stage_ranked"),
        F.max("stage").alias("furthest_stage_lexical"),
    )


def position_group(c="position"):
    """Position code -> Goalkeeper / Defender / Midfielder / Forward / Unknown."""
    col = F.col(c)
    expr = None
    for group, codes in POSITION_GROUPS.items():
        cond = col.isin(*codes)
        expr = F.when(cond, group) if expr is None else expr.when(cond, group)
    return expr.otherwise("Unknown")


def players_profile(players: DataFrame) -> DataFrame:
    """Staged players with a position group; rows without a name dropped."""
    return (players.where(F.col("player_name").isNotNull())
                   .select("nation", "player_name", "position", "age", "matches_played",
                           "goals", "assists", "minutes_90s", "market_value_eur_m",
                           position_group("position").alias("position_group")))


def nation_info(features: DataFrame, info: DataFrame, default: dict, name: str = "country_name", key: str = "nation") -> DataFrame:
    """``features`` with their nation's record ``info``, a struct of the columns of ``info`` that
    ``default`` names (arrays among them), or the default record for a nation without
    one. Names meet exactly; ``info`` has one row per nation."""
    fields = [F.col(c) for c in default]
    value = lambda v: F.array().cast("array<string>") if v == [] else F.lit(v)
    record = info.select(F.col(key).alias("_key"), F.struct(*fields).alias("_info"))
    missing = F.struct(*[value(v).alias(c) for c, v in default.items()]).cast(record.schema["_info"].dataType)
    joined = features.join(record, F.col(name) == F.col("_key"), "left")
    return joined.withColumn("info", F.coalesce("_info", missing)).drop("_key", "_info")
