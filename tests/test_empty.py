"""Every operator on empty inputs: no error, empty result (or the one row a
global aggregate gives), schema unchanged."""

import pytest

from scoreline.functions import sql_trim, strip_all
from scoreline.operators.analytics import (age_histogram, best_worst_edition, default_pick,
                                           head_to_head, history_kpis, plot_frame, radar_group_avg,
                                           radar_scores, squad_kpis, value_by_position, value_rollup,
                                           with_position_label)
from scoreline.operators.cleaning import stage_matches, stage_players
from scoreline.operators.facts import both_sides, team_names
from scoreline.operators.marts import (edition_history_goals, edition_history_winner, nation_stats,
                                       players_profile)
from scoreline.operators.quality import not_null_report, unique_report
from scoreline.operators.standings import best_thirds, group_status, matches_by_date, standings

MATCHES = ("year int, stage string, home_team_name string, home_team_goals int, "
           "away_team_goals int, away_team_name string")
SQUADS = "nation string, player string, pos string, age string, mp int, gls double, ast double, `90s` double"
MARKET = "nation string, player_name string, market_value_eur_m double"
RESULTS = "grp string, date string, seq_order int, home string, hs int, as_ int, away string"


@pytest.fixture(scope="module")
def empty(spark):
    m = stage_matches(spark.createDataFrame([], MATCHES))
    p = players_profile(stage_players(spark.createDataFrame([], SQUADS), spark.createDataFrame([], MARKET)))
    r = spark.createDataFrame([], RESULTS)
    return m, p, r


def test_match_operators_on_empty(empty):
    m, _, _ = empty
    for df in (m, both_sides(m), team_names(m), nation_stats(m), edition_history_winner(m),
               edition_history_goals(m), head_to_head(m), history_kpis(edition_history_goals(m)),
               best_worst_edition(edition_history_goals(m))):
        assert df.count() == 0


def test_player_operators_on_empty(empty):
    _, p, _ = empty
    plot = plot_frame(with_position_label(p))
    for df in (p, value_by_position(plot), age_histogram(plot), radar_scores(p), radar_group_avg(p),
               default_pick(p)):
        assert df.count() == 0
    # Spark's rollup over no rows gives no rows at all (no grand-total row),
    # like a pandas groupby over an empty frame
    assert value_rollup(plot).count() == 0
    assert squad_kpis(p).count() == 0
    assert squad_kpis(p, all_label=None).count() == 0


def test_standings_on_empty(empty):
    _, _, r = empty
    t = standings(r)
    for df in (t, best_thirds(t), group_status(t), matches_by_date(r, order=("seq_order",))):
        assert df.count() == 0


def test_quality_on_empty(spark, empty):
    m, _, _ = empty
    nn = not_null_report(m, "stg_matches", ["home_team"]).first()
    assert nn.rows == 0 and nn.passed
    assert unique_report(m, "stg_matches", ["home_team"]).first().passed


def test_nbsp_and_tab_padding(spark):
    df = spark.createDataFrame([(" Brazil ",), ("\tBrazil\t",), (" Brazil ",)], "v string")
    rows = df.select(sql_trim("v").alias("t"), strip_all("v").alias("s")).collect()
    assert [r.t for r in rows] == ["Brazil", "\tBrazil\t", "Brazil"]  # SQL TRIM keeps tabs
    assert [r.s for r in rows] == ["Brazil", "Brazil", "Brazil"]      # str.strip() drops all whitespace
