"""Head-to-head, history KPIs, best / worst edition, title flags and the
player-profile analytics (KPIs, rollup, histogram, radar)."""

import pytest
from pyspark.sql import functions as F

from scoreline.operators.analytics import (age_histogram, best_worst_edition, default_pick,
                                           head_to_head, history_kpis, plot_frame, radar_group_avg,
                                           radar_scores, search_players, sort_players, squad_kpis,
                                           title_years, top_n, top_per_group, value_rollup,
                                           with_position_label, with_ranking_metrics, with_title_flags)
from scoreline.operators.cleaning import stage_matches, stage_players
from scoreline.operators.marts import edition_history_goals, players_profile

from .test_matches import RAW, SCHEMA


@pytest.fixture(scope="module")
def staged(spark):
    return stage_matches(spark.createDataFrame(RAW, SCHEMA)).cache()


def test_head_to_head_null_is_defeat(staged):
    r = {(x.team, x.opponent): x for x in head_to_head(staged).collect()}
    t = r[("Turkey", "Germany")]
    # 3-2 win, NULL-1 (defeat by result code), 1-1 draw
    assert (t.games, t.wins, t.draws, t.losses) == (3, 1, 1, 1)
    assert (t.goals_for, t.goals_against) == (4, 4)
    assert t.win_pct == 33.3
    b = r[("Brazil", "Turkey")]
    assert (b.games, b.wins, b.win_pct) == (2, 2, 100.0)


def test_top_per_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1)], "g string, v int")
    got = top_per_group(df, "g", [F.col("v").desc()], 3).collect()
    assert sorted((r.g, r.v) for r in got) == [("a", 7), ("a", 8), ("a", 9), ("b", 1)]


def test_history_kpis_and_best_worst(spark, staged):
    h = edition_history_goals(staged)
    k = {x.team: x for x in history_kpis(h).collect()}
    assert (k["Germany"].editions, k["Germany"].total_wins) == (2, 0)  # the NULL-score match is no result
    hist = spark.createDataFrame(
        [("X", 1990, 3, 1, 1, 1, 4, 3), ("X", 1994, 3, 1, 1, 1, 5, 5), ("X", 1998, 5, 3, 1, 1, 9, 2),
         ("X", 2002, 2, 0, 0, 2, 0, 3)],
        "team string, edition_year int, games int, wins int, draws int, losses int, goals_scored int, goals_conceded int")
    r = best_worst_edition(hist).first()
    assert (r.best_year, r.best_pts) == (1998, 10)
    assert (r.worst_year, r.worst_pts) == (1990, 4)  # tie 1990/1994 -> earliest; 2002 has < 3 games


def test_title_flags(spark, staged):
    cups = spark.createDataFrame([(2002, "Brazil"), (1994, "brazil"), (2006, "Italy")], "year int, winner string")
    h = edition_history_goals(staged)
    r = {(x.team, x.edition_year): x for x in with_title_flags(h, title_years(cups)).collect()}
    assert r[("Brazil", 2002)].is_title_year and not r[("Brazil", 2006)].is_title_year
    assert r[("Brazil", 2002)].n_titles == 2 and r[("Brazil", 2002)].titles_str == "1994, 2002"
    assert r[("Turkey", 2002)].n_titles == 0 and r[("Turkey", 2002)].titles_str == "—"
    from scoreline.operators.analytics import title_years_literal
    lit = {(x.team, x.edition_year): x for x in with_title_flags(h, title_years_literal(spark)).collect()}
    assert lit[("Brazil", 2002)].is_title_year and lit[("Brazil", 2002)].n_titles == 5
    assert lit[("Germany", 2006)].n_titles == 4 and not lit[("Germany", 2006)].is_title_year


def test_ranking_metrics_and_top_n(spark):
    mart = spark.createDataFrame([("Brazil", 10, 3, 2.0), ("Fiji", 0, 0, None), ("Chile", 7, 3, 2.0)],
                                 "nation string, total_goals_for int, total_matches int, win_pct double")
    r = {x.nation: x for x in with_ranking_metrics(mart).collect()}
    assert r["Brazil"].goals_per_game == 3.33 and r["Fiji"].goals_per_game == 0.0
    assert r["Brazil"].confederation == "CONMEBOL" and r["Brazil"].nacao == "Brasil"
    assert r["Fiji"].confederation == "OFC"
    top = [x.nation for x in top_n(with_ranking_metrics(mart), "win_pct", 3).collect()]
    assert top == ["Brazil", "Chile", "Fiji"]  # ties by name, NULL last


SQUADS = [
    ("Brazil", "Vinicius Junior", "LW", "24-100", 10, 5.0, 3.0, 9.0),
    ("Brazil", "Alisson", "GK", "31-20", 12, 0.0, 0.0, 12.0),
    ("Brazil", "Rodrygo", "RW", "n/a", 8, 5.0, 1.0, None),
    ("Brazil", "Ederson", "GK", "30-1", 1, 0.0, 0.0, 0.0),
    ("France", "Kylian Mbappé", "FW", "25-10", 10, 8.0, 2.0, 10.0),
    ("France", "N'Golo Kanté", "CAM", "33-5", 5, 0.0, 1.0, 5.0),
]
MARKET = [("Brazil", " VINICIUS JUNIOR ", 150.0), ("Brazil", "Alisson", 30.0),
          ("France", "Kylian Mbappé", 180.0), ("Brazil", "Ederson", 30.0)]


@pytest.fixture(scope="module")
def players(spark):
    s = spark.createDataFrame(SQUADS, "nation string, player string, pos string, age string, mp int, "
                                      "gls double, ast double, `90s` double")
    m = spark.createDataFrame(MARKET, "nation string, player_name string, market_value_eur_m double")
    return players_profile(stage_players(s, m)).cache()


def test_stage_players_join_and_casts(players):
    r = {x.player_name: x for x in players.collect()}
    assert r["Vinicius Junior"].market_value_eur_m == 150.0  # lower(trim()) key
    assert r["Rodrygo"].age is None and r["Rodrygo"].market_value_eur_m is None
    assert r["Kylian Mbappé"].position_group == "Forward"
    assert r["N'Golo Kanté"].position_group == "Unknown"


def test_stage_players_float32_option(spark):
    s = spark.createDataFrame(SQUADS, "nation string, player string, pos string, age string, mp int, "
                                      "gls double, ast double, `90s` double")
    m = spark.createDataFrame(MARKET, "nation string, player_name string, market_value_eur_m double")
    types = dict(stage_players(s, m, float32=True).dtypes)
    assert (types["goals"], types["assists"], types["minutes_90s"]) == ("float", "float", "float")
    assert dict(stage_players(s, m).dtypes)["goals"] == "double"


def test_squad_kpis(players):
    r = {x.nation: x for x in squad_kpis(players).collect()}
    b = r["Brazil"]
    assert b.total_value_eur_m == 210.0 and b.players == 4
    # tie on goals (5): higher value wins
    assert b.top_scorer == "Vinicius Junior" and b.top_scorer_goals == 5
    assert b.top_scorer_short == "Vinicius J…"
    a = r["Todas"]  # all nations together
    assert a.players == 6 and a.total_value_eur_m == 390.0
    assert a.top_scorer == "Kylian Mbappé" and a.top_scorer_goals == 8


def test_rollup_totals(players):
    plot = plot_frame(with_position_label(players))
    rows = value_rollup(plot).collect()
    leaves = sum(r.value_eur_m for r in rows if r.level == 0)
    grand = [r.value_eur_m for r in rows if r.level == 3]
    assert grand == [leaves]
    per_nation = {r.nation: r.value_eur_m for r in rows if r.level == 1}
    assert per_nation["Brazil"] == 210.0


def test_age_histogram(players):
    plot = plot_frame(with_position_label(players))
    rows = age_histogram(plot, bins=15).collect()
    assert sum(r.players for r in rows) == plot.where(F.col("age").isNotNull()).count()
    assert all(r.bin_end >= r.bin_start for r in rows)


def test_radar_scores_rules(players):
    r = {x.player_name: x for x in radar_scores(players).collect()}
    for x in r.values():
        for c in ("score_g90", "score_a90", "score_matches", "score_value", "score_youth"):
            assert 3.0 <= getattr(x, c) <= 100.0
    assert r["Rodrygo"].score_youth == 3.0  # unknown age
    assert r["Kylian Mbappé"].score_value == 100.0
    # zero minutes -> 0.1, so 0 goals stays 0 -> floor 3
    assert r["Ederson"].score_g90 == 3.0


def test_radar_constant_metric_scores_50(spark):
    p = spark.createDataFrame([("A", "x", "Forward", 20, 5, 1.0, 1.0, 1.0, 10.0),
                               ("A", "y", "Forward", 30, 5, 2.0, 1.0, 1.0, 10.0)],
                              "nation string, player_name string, position_group string, age int, "
                              "matches_played int, goals double, assists double, minutes_90s double, "
                              "market_value_eur_m double")
    r = radar_scores(p).collect()
    assert all(x.score_matches == 50.0 and x.score_value == 50.0 for x in r)
    g = radar_group_avg(p).first()
    assert g.n == 2 and g.avg_score_matches == 50.0


def test_radar_group_needs_two_rows(players):
    groups = {x.position_group for x in radar_group_avg(players).collect()}
    assert "Goalkeeper" in groups and "Unknown" not in groups  # one Unknown player only


def test_search_sort_and_pick(players):
    got = [r.player_name for r in sort_players(search_players(players, "^ed|ALI"), "idade").collect()]
    assert got == ["Ederson", "Alisson"]
    picks = {r.nation: r.default_player for r in default_pick(players).collect()}
    assert picks == {"Brazil": "Vinicius Junior", "France": "Kylian Mbappé"}


def test_scores_use_scalar_subquery_not_cross_join(players):
    plan = radar_scores(players)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
