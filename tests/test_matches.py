"""Staging, both-sides facts and the nation / edition marts on a hand-made
eight-match fixture (three sides, two editions, NULL goals, NULL home side)."""

import pytest
from pyspark.sql import functions as F

from scoreline.operators.cleaning import stage_matches
from scoreline.operators.facts import both_sides, side_view, team_names
from scoreline.operators.marts import (edition_history_goals, edition_history_winner,
                                       furthest_stage_ranked, nation_stats, nations_performance)

RAW = [
    # year, stage, home, hg, ag, away
    (2002, "Group Stage", " Brazil ", 2, 0, "Turkey"),
    (2002, "Semi-finals", "Brazil", 1, 0, "Turkey"),
    (2002, "Final", "Germany ", 0, 2, "Brazil"),
    (2002, "Third Place", "Turkey", 3, 2, "Germany"),
    (2006, "Group Stage", "Brazil", 0, 0, "Germany"),
    (2006, "Group Stage", "Turkey", None, 1, "Germany"),
    (2006, "Group Stage", None, 1, 1, "Brazil"),
    (2006, "Quarter-finals", "Germany", 1, 1, "Turkey"),
]
SCHEMA = "year int, stage string, home_team_name string, home_team_goals int, away_team_goals int, away_team_name string"


@pytest.fixture(scope="module")
def staged(spark):
    return stage_matches(spark.createDataFrame(RAW, SCHEMA)).cache()


def test_stage_matches(staged):
    rows = staged.collect()
    assert len(rows) == 7  # NULL home side dropped
    assert {r.home_team for r in rows} == {"Brazil", "Germany", "Turkey"}  # trimmed, NBSP too
    w = {(r.edition_year, r.stage, r.home_team): r.winner for r in rows}
    assert w[(2002, "Final", "Germany")] == "Brazil"
    assert w[(2006, "Group Stage", "Turkey")] == "Draw"  # NULL goals fall to 'Draw'
    assert w[(2006, "Group Stage", "Brazil")] == "Draw"


def test_stage_matches_fractional_goals_round_half_even(spark):
    df = spark.createDataFrame([(2002.0, "F", "A", 2.5, 3.5, "B")],
                               "year double, stage string, home_team_name string, home_team_goals double, "
                               "away_team_goals double, away_team_name string")
    r = stage_matches(df).first()
    assert (r.edition_year, r.home_goals, r.away_goals) == (2002, 2, 4)


def test_both_sides_one_scan(staged):
    s = both_sides(staged)
    assert s.count() == 14
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Generate" in plan


def test_nation_stats(staged):
    r = {x.nation: x for x in nation_stats(staged).collect()}
    b = r["Brazil"]
    assert (b.editions_played, b.total_matches, b.wins, b.draws, b.losses) == (2, 4, 3, 1, 0)
    assert (b.total_goals_for, b.total_goals_against, b.first_edition, b.last_edition) == (5, 0, 2002, 2006)
    t = r["Turkey"]
    # NULL-goal match: 'Draw' for the winner rule
    assert (t.total_matches, t.wins, t.draws, t.losses) == (5, 1, 2, 2)
    assert (t.total_goals_for, t.total_goals_against) == (4, 7)  # NULL ignored
    # invariant: wins + draws + losses = matches
    for x in r.values():
        assert x.wins + x.draws + x.losses == x.total_matches


def test_nations_performance_joins_and_ratio(spark, staged):
    cups = spark.createDataFrame([(2002, "Brazil"), (1994, "Brazil"), (1954, "Germany FR")], "year int, winner string")
    countries = spark.createDataFrame([("brazil", "BRA", True), ("Turkey", "TUR", False)],
                                      "country_name string, iso_a3 string, qualified_2026 boolean")
    r = {x.nation: x for x in nations_performance(nation_stats(staged), cups, countries).collect()}
    assert r["Brazil"].world_cup_titles == 2 and r["Brazil"].iso_a3 == "BRA" and r["Brazil"].qualified_2026
    assert r["Germany"].world_cup_titles == 0  # 'Germany FR' never matches (no aliases)
    assert r["Germany"].iso_a3 is None and r["Germany"].qualified_2026 is False
    assert r["Brazil"].win_pct == 75.0 and r["Turkey"].win_pct == 20.0


def test_three_null_goal_rules(staged):
    # winner rule: NULL -> 'Draw'; goals rule: NULL -> no result at all
    w = {(x.team, x.edition_year): x for x in edition_history_winner(staged).collect()}
    g = {(x.team, x.edition_year): x for x in edition_history_goals(staged).collect()}
    assert w[("Turkey", 2006)].draws == 2
    assert g[("Turkey", 2006)].draws == 1 and g[("Turkey", 2006)].losses == 0 and g[("Turkey", 2006)].games == 2


def test_furthest_stage_lexical_vs_ranked(staged):
    w = {(x.team, x.edition_year): x for x in edition_history_winner(staged).collect()}
    assert w[("Brazil", 2002)].furthest_stage == "Semi-finals"  # lexical max, reference rule
    order = ["Group Stage", "Round of 16", "Quarter-finals", "Semi-finals", "Third Place", "Final"]
    r = {(x.team, x.edition_year): x for x in furthest_stage_ranked(staged, order).collect()}
    assert r[("Brazil", 2002)].furthest_stage_ranked == "Final"
    assert r[("Germany", 2002)].furthest_stage_ranked == "Final"


def test_side_view_and_names(staged):
    v = side_view(staged, "Turkey").collect()
    assert len(v) == 5
    assert all(r.opponent != "Turkey" for r in v)
    assert sorted(r.nation for r in team_names(staged).collect()) == ["Brazil", "Germany", "Turkey"]


def test_nulls_last_ordering(spark):
    df = spark.createDataFrame([(None,), (3,), (1,)], "v int")
    asc = [r.v for r in df.orderBy(F.asc_nulls_last("v")).collect()]
    assert asc == [1, 3, None]


def test_schema_adaptive_rename_and_select(spark):
    from scoreline.operators.facts import rename_if_missing, select_existing
    df = spark.createDataFrame([(1, 2, 3)], "matches_played int, goals_for int, goals_scored int")
    r = rename_if_missing(df, {"matches_played": "games", "goals_for": "goals_scored"})
    assert r.columns == ["games", "goals_for", "goals_scored"]  # goals_scored already there
    assert select_existing(r, ["edition_year", "goals_scored", "games"]).columns == ["goals_scored", "games"]
