"""Queries of the ranking and deep-dive pages: derived ranking metrics, top-N,
filtered scatter frame, head-to-head records, history KPIs, best / worst
edition, title flags, name lookups and the nation selector order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import combined_label
from ..operators.analytics import (best_worst_edition, filter_in, head_to_head, history_kpis,
                                   title_years, title_years_literal, top_n, top_per_group, with_points,
                                   with_ranking_metrics, with_title_flags)
from ..operators.facts import team_names
from ..operators.marts import edition_history_goals
from ..sources.dims import (CONFEDERATION_DEFAULT, NATION_PT, POPULAR_NATIONS, RANKING_METRICS, TITLE_YEARS,
                            confederation_map, map_expr, values_sql)
from ..sources.fixtures import fixture
from .oracle import ALL_TEAMS, HIST_GOALS, MART_NATIONS, MATCH_FX, NATION_FX, STG_MATCHES, STG_NATIONS
from .q_matches import nations_mart, staged
from .registry import osql, register

RANK_METRIC = "win_pct"
RANK_N = 15
CONFED_FILTER = ["Outro", "UEFA"]
MIN_MATCHES = 5
H2H_TOP = 15

N_CTES = [STG_MATCHES, ALL_TEAMS, STG_NATIONS, MART_NATIONS]
RANKED = ("ranked", f"""
SELECT m.*, round_even(CAST(m.total_goals_for AS DOUBLE) / GREATEST(m.total_matches, 1), 2) AS goals_per_game,
       COALESCE(cf.conf, '{CONFEDERATION_DEFAULT}') AS confederation, COALESCE(pt.label, m.nation) AS nacao
FROM mart_nations m
LEFT JOIN {values_sql(confederation_map(), "key", "conf", "cf")} ON m.nation = cf.key
LEFT JOIN {values_sql(NATION_PT, "key", "label", "pt")} ON m.nation = pt.key""")
H_CTES = [STG_MATCHES, ALL_TEAMS, HIST_GOALS]


def ranked(spark, sf):
    return with_ranking_metrics(nations_mart(spark, sf))


def history(spark, sf):
    return edition_history_goals(staged(spark, sf))


@register("ranking_topn", osql(NATION_FX, N_CTES + [RANKED], f"""
SELECT * FROM ranked ORDER BY {RANK_METRIC} DESC NULLS LAST, nation LIMIT {RANK_N}"""), "P17 P18 P19 K6")
def q_ranking_topn(spark, sf):
    return top_n(ranked(spark, sf), RANK_METRIC, RANK_N)


@register("ranking_resorted", osql(NATION_FX, N_CTES + [RANKED], f"""
SELECT nation, nacao, {RANK_METRIC}, world_cup_titles FROM (
  SELECT * FROM ranked ORDER BY {RANK_METRIC} DESC NULLS LAST, nation LIMIT {RANK_N}) t
ORDER BY {RANK_METRIC} ASC NULLS LAST, nation"""), "K7")
def q_ranking_resorted(spark, sf):
    t = top_n(ranked(spark, sf), RANK_METRIC, RANK_N)
    return (t.select("nation", "nacao", RANK_METRIC, "world_cup_titles")
             .orderBy(F.col(RANK_METRIC).asc_nulls_last(), "nation"))


_CONF_SQL = ", ".join(f"'{c}'" for c in CONFED_FILTER)


@register("ranking_filtered", osql(NATION_FX, N_CTES + [RANKED], f"""
SELECT nation, nacao, confederation, total_matches, total_goals_for, total_goals_against, win_pct, goals_per_game
FROM ranked WHERE confederation IN ({_CONF_SQL}) AND total_matches > {MIN_MATCHES}"""), "P22 P23")
def q_ranking_filtered(spark, sf):
    f = filter_in(ranked(spark, sf), "confederation", CONFED_FILTER).where(F.col("total_matches") > MIN_MATCHES)
    return f.select("nation", "nacao", "confederation", "total_matches", "total_goals_for",
                    "total_goals_against", "win_pct", "goals_per_game")


@register("scatter_axis", osql(NATION_FX, N_CTES + [RANKED], f"""
SELECT GREATEST(MAX(total_goals_for), MAX(total_goals_against)) AS axis_max, COUNT(*) AS nations
FROM ranked WHERE confederation IN ({_CONF_SQL}) AND total_matches > {MIN_MATCHES}"""), "A24")
def q_scatter_axis(spark, sf):
    f = filter_in(ranked(spark, sf), "confederation", CONFED_FILTER).where(F.col("total_matches") > MIN_MATCHES)
    return f.agg(F.greatest(F.max("total_goals_for"), F.max("total_goals_against")).alias("axis_max"),
                 F.count(F.lit(1)).alias("nations"))


@register("name_lookup", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT nation, nacao, CASE WHEN nacao <> nation THEN concat(nacao, ' (', nation, ')') ELSE nation END AS label
FROM (SELECT n.nation, COALESCE(pt.label, n.nation) AS nacao
      FROM (SELECT home_team AS nation FROM stg_matches UNION SELECT away_team FROM stg_matches) n
      LEFT JOIN {values_sql(NATION_PT, "key", "label", "pt")} ON n.nation = pt.key
      WHERE n.nation IS NOT NULL AND n.nation <> '') t"""), "P19 P47")
def q_name_lookup(spark, sf):
    n = team_names(staged(spark, sf))
    t = n.withColumn("nacao", map_expr(NATION_PT, "nation", F.col("nation")))
    return t.withColumn("label", combined_label("nacao", "nation"))


_H2H_SQL = """
SELECT team, opponent, COUNT(*) AS games,
       CAST(SUM(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) AS BIGINT) AS wins,
       CAST(SUM(CASE WHEN goals_for = goals_against THEN 1 ELSE 0 END) AS BIGINT) AS draws,
       CAST(SUM(CASE WHEN goals_for > goals_against OR goals_for = goals_against THEN 0 ELSE 1 END) AS BIGINT) AS losses,
       CAST(COALESCE(SUM(goals_for), 0) AS BIGINT) AS goals_for,
       CAST(COALESCE(SUM(goals_against), 0) AS BIGINT) AS goals_against,
       round_even(CAST(SUM(CASE WHEN goals_for > goals_against THEN 1 ELSE 0 END) * 3 AS DOUBLE)
                  / (COUNT(*) * 3) * 100, 1) AS win_pct
FROM all_teams GROUP BY team, opponent"""


@register("head_to_head", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS], _H2H_SQL), "A10 P9 P36")
def q_head_to_head(spark, sf):
    return head_to_head(staged(spark, sf))


@register("head_to_head_top", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, ("h2h", _H2H_SQL)], f"""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY team ORDER BY games DESC, opponent) AS INTEGER) AS rank FROM h2h) t
WHERE rank <= {H2H_TOP}"""), "K9")
def q_head_to_head_top(spark, sf):
    h = head_to_head(staged(spark, sf))
    return top_per_group(h, "team", [F.col("games").desc(), F.col("opponent").asc()], H2H_TOP)


@register("head_to_head_translated", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, ("h2h", _H2H_SQL)], f"""
SELECT h2h.*, coalesce(pt.label, opponent) AS adversario
FROM h2h LEFT JOIN {values_sql(NATION_PT, "key", "label", "pt")} ON opponent = pt.key"""), "A10 P19")
def q_head_to_head_translated(spark, sf):
    return head_to_head(staged(spark, sf)).withColumn("adversario", map_expr(NATION_PT, "opponent", F.col("opponent")))


@register("ranking_metrics", osql(NATION_FX, N_CTES + [RANKED], f"""
SELECT metric, rank::INTEGER AS rank, nation, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, nation) AS rank
  FROM (UNPIVOT (SELECT nation, {", ".join(f"{m}::DOUBLE AS {m}" for m in RANKING_METRICS)} FROM ranked)
        ON {", ".join(RANKING_METRICS)} INTO NAME metric VALUE value))
WHERE rank <= {RANK_N}"""), "K6")
def q_ranking_metrics(spark, sf):
    """The top nations by each of the ranking page's metrics, in one job."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in RANKING_METRICS])
    long = ranked(spark, sf).select("nation", F.inline(pairs))
    return top_per_group(long, "metric", [F.col("value").desc_nulls_last(), F.col("nation").asc()], RANK_N)


@register("title_years_literal", osql(MATCH_FX, H_CTES + [("ty", "SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {y})" for n, years in TITLE_YEARS.items() for y in years) + ") v(nation, year)")], """
SELECT h.*, EXISTS (FROM ty WHERE nation = team AND year = edition_year) AS is_title_year,
       (SELECT count(*)::INTEGER FROM ty WHERE nation = team) AS n_titles,
       coalesce((SELECT string_agg(year, ', ' ORDER BY year) FROM ty WHERE nation = team), '—') AS titles_str
FROM hist_goals h"""), "J9 P45")
def q_title_years_literal(spark, sf):
    return with_title_flags(history(spark, sf), title_years_literal(spark))


@register("history_kpis", osql(MATCH_FX, H_CTES, """
SELECT team, COUNT(DISTINCT edition_year) AS editions,
       CAST(COALESCE(SUM(wins), 0) AS BIGINT) AS total_wins,
       CAST(COALESCE(SUM(goals_scored), 0) AS BIGINT) AS total_goals_for,
       CAST(COALESCE(SUM(goals_conceded), 0) AS BIGINT) AS total_goals_against,
       round_even(AVG(wins), 1) AS avg_wins, round_even(AVG(goals_scored), 1) AS avg_goals
FROM hist_goals GROUP BY team"""), "A11 A12")
def q_history_kpis(spark, sf):
    return history_kpis(history(spark, sf))


@register("best_worst_edition", osql(MATCH_FX, H_CTES + [("h", """
SELECT *, wins * 3 + COALESCE(draws, 0) AS pts FROM hist_goals WHERE games >= 3""")], """
SELECT b.team, b.edition_year AS best_year, b.pts AS best_pts, b.wins AS best_wins, b.goals_scored AS best_goals,
       w.edition_year AS worst_year, w.pts AS worst_pts, w.wins AS worst_wins, w.goals_scored AS worst_goals
FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pts DESC, edition_year) AS rn FROM h) b
JOIN (SELECT *, row_number() OVER (PARTITION BY team ORDER BY pts, edition_year) AS rn FROM h) w
  ON b.team = w.team AND b.rn = 1 AND w.rn = 1"""), "A13 P30")
def q_best_worst_edition(spark, sf):
    return best_worst_edition(history(spark, sf))


@register("points_and_difference", osql(MATCH_FX, H_CTES, """
SELECT *, wins * 3 + COALESCE(draws, 0) AS pts, goals_scored - goals_conceded AS goal_difference
FROM hist_goals"""), "P30 P31")
def q_points_and_difference(spark, sf):
    return with_points(history(spark, sf))


@register("title_flags", osql(["fx_matches_null", "fx_cups"], H_CTES, """
SELECT h.*, COALESCE(list_contains(ty.years, h.edition_year), FALSE) AS is_title_year,
       CAST(COALESCE(len(ty.years), 0) AS INTEGER) AS n_titles,
       COALESCE(array_to_string(ty.years, ', '), '—') AS titles_str
FROM hist_goals h
LEFT JOIN (SELECT lower(winner) AS k, list_sort(list(CAST(year AS INTEGER))) AS years FROM fx_cups GROUP BY lower(winner)) ty
  ON lower(h.team) = ty.k"""), "J9 P45 A26")
def q_title_flags(spark, sf):
    h = history(spark, sf)
    return with_title_flags(h, title_years(fixture(spark, sf, "fx_cups")))


_POP = "[" + ", ".join(f"'{n}'" for n in POPULAR_NATIONS) + "]"


@register("semi_anti_pref", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT nation, CAST(list_position({_POP}, nation) AS INTEGER) AS pref_rank,
       list_position({_POP}, nation) IS NOT NULL AS is_preferred
FROM (SELECT home_team AS nation FROM stg_matches UNION SELECT away_team FROM stg_matches) n
WHERE nation IS NOT NULL AND nation <> ''
ORDER BY COALESCE(pref_rank, 1000000), nation"""), "J8 K14")
def q_semi_anti_pref(spark, sf):
    # preferred ∩ available and available ∖ preferred in one pass: a left join
    # of the available names with the literal preference list (unique keys,
    # size fixed by the code, so broadcast) marks both sets at once.
    names = team_names(staged(spark, sf))
    pref = F.broadcast(spark.createDataFrame([(n, i + 1) for i, n in enumerate(POPULAR_NATIONS)],
                                             "nation string, pref_rank int"))
    return (names.join(pref, "nation", "left")
                 .select("nation", "pref_rank", F.col("pref_rank").isNotNull().alias("is_preferred"))
                 .orderBy(F.coalesce(F.col("pref_rank"), F.lit(1_000_000)), "nation"))
