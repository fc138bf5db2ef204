"""Queries of the tournament page: standings from results, best third-placed
sides, result cards per date, group status and per-match flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.standings import best_thirds, group_status, match_calendar, match_flags, matches_by_date, standings, upcoming_by_date
from ..sources.dims import GROUP_START, GROUP_START_DEFAULT, SEASON, SHORT_PT, map_expr, values_sql
from ..sources.fixtures import fixture
from .registry import osql, register

FOCUS_TEAM = "Brazil"
RES_FX = ["fx_results"]

TEAM_ROWS = ("team_rows", """
SELECT grp, home AS team, hs AS gf, as_ AS ga FROM fx_results
UNION ALL
SELECT grp, away, as_, hs FROM fx_results""")

STANDINGS = ("standings", """
SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY pts DESC, sg DESC, gp DESC, team) AS INTEGER) AS position
FROM (SELECT *, gp - gc AS sg, v * 3 + e AS pts FROM (
  SELECT grp, team,
         CAST(SUM(CASE WHEN gf IS NOT NULL AND ga IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS p,
         CAST(SUM(CASE WHEN gf > ga THEN 1 ELSE 0 END) AS BIGINT) AS v,
         CAST(SUM(CASE WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS e,
         CAST(SUM(CASE WHEN gf < ga THEN 1 ELSE 0 END) AS BIGINT) AS d,
         CAST(COALESCE(SUM(CASE WHEN gf IS NOT NULL AND ga IS NOT NULL THEN gf END), 0) AS BIGINT) AS gp,
         CAST(COALESCE(SUM(CASE WHEN gf IS NOT NULL AND ga IS NOT NULL THEN ga END), 0) AS BIGINT) AS gc
  FROM team_rows WHERE team IS NOT NULL GROUP BY grp, team) a) b""")


def results(spark, sf):
    return fixture(spark, sf, "fx_results")


@register("standings", osql(RES_FX, [TEAM_ROWS, STANDINGS], """
SELECT *, position <= 2 AS advances,
       CASE WHEN sg > 0 THEN concat('+', CAST(sg AS VARCHAR)) ELSE CAST(sg AS VARCHAR) END AS sg_str
FROM standings"""), "A25 W1 W2 P30 P31")
def q_standings(spark, sf):
    return standings(results(spark, sf))


@register("best_thirds", osql(RES_FX, [TEAM_ROWS, STANDINGS], """
SELECT *, position <= 2 AS advances,
       CASE WHEN sg > 0 THEN concat('+', CAST(sg AS VARCHAR)) ELSE CAST(sg AS VARCHAR) END AS sg_str
FROM standings WHERE position = 3 ORDER BY pts DESC, sg DESC, gp DESC, team, grp LIMIT 8"""), "W3")
def q_best_thirds(spark, sf):
    return best_thirds(standings(results(spark, sf)))


ORDER = ("seq_order", "seq_line", "home", "away", "hs", "as_")
# a year-less text as a date, put together from its two numbers
_DAY = f"CAST(make_date({SEASON}, try_cast(split_part(date, '/', 2) AS INTEGER), try_cast(split_part(date, '/', 1) AS INTEGER)) AS VARCHAR)"
_MINUTE = "CASE WHEN regexp_full_match(time, '[0-9]{2}:[0-9]{2}') THEN CAST(left(time, 2) AS INTEGER) * 60 + CAST(right(time, 2) AS INTEGER) END"


def _shown(cards):
    """Days as ISO text."""
    return cards.withColumn("day", F.col("day").cast("string"))


@register("matches_by_date", osql(RES_FX, [("days", f"SELECT *, {_DAY} AS day FROM fx_results")], """
SELECT *, count(*) OVER (PARTITION BY day) AS matches_on_date FROM days
ORDER BY day, seq_order, seq_line, home, away, hs, as_"""), "A20")
def q_matches_by_date(spark, sf):
    return _shown(matches_by_date(results(spark, sf), order=ORDER))


@register("upcoming_by_date", osql(["fx_upcoming"], [("days", f"SELECT *, {_DAY} AS day, {_MINUTE} AS kickoff_minute FROM fx_upcoming")], """
SELECT *, count(*) OVER (PARTITION BY day) AS matches_on_date FROM days
ORDER BY day NULLS LAST, kickoff_minute NULLS LAST, seq_order, seq_line, home, away"""), "A20")
def q_upcoming_by_date(spark, sf):
    return _shown(upcoming_by_date(fixture(spark, sf, "fx_upcoming"), order=("seq_order", "seq_line", "home", "away")))


@register("match_calendar", osql(["fx_results", "fx_upcoming"], [("both_layouts", f"""
SELECT *, {_DAY} AS day, {_MINUTE} AS kickoff_minute FROM (
  SELECT *, CAST(NULL AS VARCHAR) AS time, TRUE AS played FROM fx_results WHERE hs IS NOT NULL OR as_ IS NOT NULL
  UNION ALL SELECT grp, date, seq_order, seq_line, home, NULL, NULL, away, time, FALSE FROM fx_upcoming)""")], """
SELECT *, count(*) OVER (PARTITION BY day) AS matches_on_date FROM both_layouts
ORDER BY day NULLS LAST, kickoff_minute NULLS LAST, seq_order, seq_line, home, away, hs, as_"""), "A20 U3")
def q_match_calendar(spark, sf):
    return _shown(match_calendar(results(spark, sf).where("hs IS NOT NULL OR as_ IS NOT NULL"), fixture(spark, sf, "fx_upcoming"), order=ORDER))


_SHORT = "MAP {" + ", ".join("'" + k.replace("'", "''") + "': '" + v.replace("'", "''") + "'" for k, v in SHORT_PT.items()) + "}"


@register("short_names", osql(RES_FX, [], f"""
SELECT seq_order, seq_line, coalesce({_SHORT}[home], home) AS home_short, coalesce({_SHORT}[away], away) AS away_short FROM fx_results"""), "P19")
def q_short_names(spark, sf):
    """The sides of each match by their short names."""
    return results(spark, sf).select("seq_order", "seq_line", map_expr(SHORT_PT, "home", F.col("home")).alias("home_short"), map_expr(SHORT_PT, "away", F.col("away")).alias("away_short"))


@register("group_not_started", osql(RES_FX, [TEAM_ROWS, STANDINGS], f"""
SELECT s.grp, s.not_started, s.sides, COALESCE(gs.first_match, '{GROUP_START_DEFAULT}') AS first_match
FROM (SELECT grp, bool_and(p = 0) AS not_started, COUNT(*) AS sides FROM standings GROUP BY grp) s
LEFT JOIN {values_sql(GROUP_START, "key", "first_match", "gs")} ON s.grp = gs.key"""), "A21 P49")
def q_group_not_started(spark, sf):
    return group_status(standings(results(spark, sf)))


@register("match_flags", osql(RES_FX, [], f"""
SELECT *, hs = as_ AS is_draw, hs > as_ AS home_won, as_ > hs AS away_won,
       (home = '{FOCUS_TEAM}' OR away = '{FOCUS_TEAM}') AS is_focus
FROM fx_results"""), "P48")
def q_match_flags(spark, sf):
    return match_flags(results(spark, sf), FOCUS_TEAM)
