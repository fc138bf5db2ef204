"""Queries over staged matches: silver/gold marts and per-side histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import stage_matches
from ..operators.facts import both_sides, result_code, team_names
from ..operators.marts import (edition_history_goals, edition_history_winner,
                               furthest_stage_ranked, nation_stats, nations_performance)
from ..sources.fixtures import fixture
from ..sources.layers import layer
from .oracle import ALL_TEAMS, HIST_GOALS, MART_NATIONS, MATCH_FX, NATION_FX, STG_MATCHES, STG_NATIONS
from .registry import osql, register

STAGE_ORDER = ["Group Stage", "Round of 16", "Quarter-finals", "Semi-finals", "Third Place", "Final"]
FOCUS_TEAM = "Brazil"
TEAM_ORDER = ["edition_year", "stage", "home_team", "away_team", "home_goals", "away_goals", "attendance", "referee", "stadium"]


def staged(spark, sf):
    """The silver match table: the layer if one is in use, else computed."""
    return layer(spark, sf, "stg_matches", lambda: stage_matches(fixture(spark, sf, "fx_matches_null")))


def build_nations_mart(spark, sf):
    return nations_performance(nation_stats(staged(spark, sf)), fixture(spark, sf, "fx_cups"), fixture(spark, sf, "fx_countries"))


def nations_mart(spark, sf):
    """The gold nations mart: the layer if one is in use, else computed."""
    return layer(spark, sf, "mart_nations", lambda: build_nations_mart(spark, sf))


@register("stage_matches", osql(MATCH_FX, [STG_MATCHES], "SELECT * FROM stg_matches"), "P1-P5")
def q_stage_matches(spark, sf):
    return stage_matches(fixture(spark, sf, "fx_matches_null"))


@register("nation_stats", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, STG_NATIONS],
                               "SELECT * FROM stg_nations"), "U1 A1-A5")
def q_nation_stats(spark, sf):
    return nation_stats(staged(spark, sf))


@register("nations_performance", osql(NATION_FX, [STG_MATCHES, ALL_TEAMS, STG_NATIONS, MART_NATIONS],
                                      "SELECT * FROM mart_nations ORDER BY world_cup_titles DESC, wins DESC, nation"),
          "J2 J3 A6 P15 P16 K1")
def q_nations_performance(spark, sf):
    return build_nations_mart(spark, sf).orderBy(F.desc_nulls_last("world_cup_titles"),
                                           F.desc_nulls_last("wins"), F.asc_nulls_last("nation"))


@register("edition_history_winner", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS], """
SELECT team, edition_year, matches_played, wins, draws, matches_played - wins - draws AS losses, goals_scored, goals_conceded, furthest_stage
FROM (SELECT team, edition_year, count(*) AS matches_played, count_if(winner = team) AS wins, count_if(winner = 'Draw') AS draws,
             sum(goals_for)::BIGINT AS goals_scored, sum(goals_against)::BIGINT AS goals_conceded, list_max(list(stage)) AS furthest_stage
      FROM all_teams GROUP BY ALL)
ORDER BY team, edition_year"""), "A7 A8 K2")
def q_edition_history_winner(spark, sf):
    return edition_history_winner(staged(spark, sf)).orderBy("team", F.asc_nulls_last("edition_year"))


@register("edition_history_goals", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, HIST_GOALS], "SELECT * FROM hist_goals"), "A9 P9")
def q_edition_history_goals(spark, sf):
    return edition_history_goals(staged(spark, sf))


@register("edition_history_null_goals", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS], """
SELECT team, edition_year, count_if(x IS NULL) AS null_score_matches, count_if(winner = 'Draw') AS draws_by_winner,
       count_if(x = 0) AS draws_by_goals, count_if(coalesce(x, -1) < 0) AS defeats_by_code
FROM (SELECT *, goals_for - goals_against AS x FROM all_teams) GROUP BY ALL"""), "T1")
def q_edition_history_null_goals(spark, sf):
    s = both_sides(staged(spark, sf))
    gf, ga = F.col("goals_for"), F.col("goals_against")

    def cnt(c):
        return F.sum(F.when(c, 1).otherwise(0))
    return s.groupBy("team", "edition_year").agg(
        cnt(gf.isNull() | ga.isNull()).alias("null_score_matches"),
        cnt(F.col("winner") == "Draw").alias("draws_by_winner"),
        cnt(gf == ga).alias("draws_by_goals"),
        cnt(result_code() == "D").alias("defeats_by_code"),
    )


_ORDER_SQL = "[" + ", ".join(f"'{s}'" for s in STAGE_ORDER) + "]"


@register("furthest_stage_ranked", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS], f"""
SELECT team, edition_year,
       arg_max(stage, {{'r': COALESCE(list_position({_ORDER_SQL}, stage), 0), 's': stage}}) AS furthest_stage_ranked,
       MAX(stage) AS furthest_stage_lexical
FROM all_teams GROUP BY team, edition_year"""), "A8 T2")
def q_furthest_stage_ranked(spark, sf):
    return furthest_stage_ranked(staged(spark, sf), STAGE_ORDER)


@register("team_names", osql(MATCH_FX, [STG_MATCHES], """
SELECT DISTINCT nation FROM (SELECT unnest([home_team, away_team]) AS nation FROM stg_matches)
WHERE length(nation) > 0 ORDER BY nation"""), "U2 K16")
def q_team_names(spark, sf):
    return team_names(staged(spark, sf)).orderBy("nation")


@register("team_matches", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT * FROM stg_matches WHERE '{FOCUS_TEAM}' IN (home_team, away_team)
ORDER BY {", ".join(TEAM_ORDER)}"""), "P10 P11 K4")
def q_team_matches(spark, sf):
    # Bound parameter marker, as the reference's page query; the predicate is
    # an OR of two equalities that Spark pushes into the parquet scan as far
    # as the stand-in view allows.
    # The sort ends with tie-break columns so that range partitioning can
    # split an (edition, stage) holding many rows across tasks.
    return spark.sql(
        "SELECT * FROM {m} WHERE home_team = :t OR away_team = :t "
        "ORDER BY " + ", ".join(f"{c} ASC NULLS LAST" for c in TEAM_ORDER),
        args={"t": FOCUS_TEAM}, m=staged(spark, sf))
