"""Invariants over generated match sets (hypothesis): per-side counts add up,
goals balance across sides, standings and radar scores stay in range."""

from hypothesis import given, settings
from hypothesis import strategies as st

from scoreline.operators.analytics import head_to_head, radar_scores
from scoreline.operators.cleaning import stage_matches
from scoreline.operators.marts import edition_history_goals, nation_stats
from scoreline.operators.standings import standings

TEAMS = ["A", "B", "C", "D"]
SCHEMA = ("year int, stage string, home_team_name string, home_team_goals int, "
          "away_team_goals int, away_team_name string")


@st.composite
def matches(draw, with_nulls=False):
    n = draw(st.integers(min_value=1, max_value=25))
    out = []
    for _ in range(n):
        h, a = draw(st.sampled_from([(x, y) for x in TEAMS for y in TEAMS if x != y]))
        goal = st.integers(0, 5) | st.none() if with_nulls else st.integers(0, 5)
        out.append((draw(st.sampled_from([1998, 2002, 2006])), draw(st.sampled_from(["G", "F"])),
                    h, draw(goal), draw(goal), a))
    return out


@settings(max_examples=12, deadline=None)
@given(matches())
def test_counts_and_goals_balance(spark, rows):
    m = stage_matches(spark.createDataFrame(rows, SCHEMA))
    stats = nation_stats(m).collect()
    assert sum(r.total_matches for r in stats) == 2 * len(rows)
    for r in stats:
        assert r.wins + r.draws + r.losses == r.total_matches
    assert sum(r.total_goals_for for r in stats) == sum(r.total_goals_against for r in stats)
    assert sum(r.wins for r in stats) == sum(r.losses for r in stats)


@settings(max_examples=10, deadline=None)
@given(matches(with_nulls=True))
def test_null_scores_are_no_result_by_goals_and_defeat_by_code(spark, rows):
    m = stage_matches(spark.createDataFrame(rows, SCHEMA))
    hist = edition_history_goals(m).collect()
    nulls = sum(1 for r in rows if r[3] is None or r[4] is None)
    assert sum(r.games - r.wins - r.draws - r.losses for r in hist) == 2 * nulls
    h2h = head_to_head(m).collect()
    assert all(r.wins + r.draws + r.losses == r.games for r in h2h)


@settings(max_examples=10, deadline=None)
@given(matches(with_nulls=True))
def test_standings_positions(spark, rows):
    res = spark.createDataFrame([(str(r[0]), r[2], r[3], r[4], r[5]) for r in rows],
                                "grp string, home string, hs int, as_ int, away string")
    tab = standings(res).collect()
    by_grp = {}
    for r in tab:
        by_grp.setdefault(r.grp, []).append(r)
        assert r.p == r.v + r.e + r.d and r.pts == 3 * r.v + r.e and r.sg == r.gp - r.gc
    for g, rs in by_grp.items():
        assert sorted(r.position for r in rs) == list(range(1, len(rs) + 1))
        top = min(rs, key=lambda r: r.position)
        assert top.pts == max(r.pts for r in rs)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(16, 40) | st.none(), st.integers(0, 40) | st.none(),
                          st.floats(0, 30) | st.none(), st.floats(0, 40) | st.none(),
                          st.floats(0, 200) | st.none()), min_size=1, max_size=20))
def test_radar_scores_in_range(spark, rows):
    df = spark.createDataFrame(
        [("N", f"p{i}", "Forward", a, mp, g, m90, mv, 1.0) for i, (a, mp, g, m90, mv) in enumerate(rows)],
        "nation string, player_name string, position_group string, age int, matches_played int, "
        "goals double, minutes_90s double, market_value_eur_m double, assists double")
    for r in radar_scores(df).collect():
        for c in ("score_g90", "score_a90", "score_matches", "score_value", "score_youth"):
            v = getattr(r, c)
            assert 3.0 <= v <= 100.0 or v == 50.0


@settings(max_examples=10, deadline=None)
@given(matches(with_nulls=True))
def test_head_to_head_and_history_add_up_to_all_time(spark, rows):
    m = stage_matches(spark.createDataFrame(rows, SCHEMA))
    stats = {r.nation: r for r in nation_stats(m).collect()}
    h2h = {}
    for r in head_to_head(m).collect():
        g, gf = h2h.get(r.team, (0, 0))
        h2h[r.team] = (g + r.games, gf + r.goals_for)
    hist = {}
    for r in edition_history_goals(m).collect():
        g, e = hist.get(r.team, (0, set()))
        hist[r.team] = (g + r.games, e | {r.edition_year})
    for team, s in stats.items():
        assert h2h[team][0] == s.total_matches and hist[team][0] == s.total_matches
        assert h2h[team][1] == (s.total_goals_for or 0)
        assert len(hist[team][1]) == s.editions_played


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["A", "B", "", None, " C "]), st.sampled_from(["A", "D", None])),
                min_size=1, max_size=20))
def test_team_names_is_the_set_of_named_sides(spark, pairs):
    from scoreline.operators.facts import team_names
    df = spark.createDataFrame(pairs, "home_team string, away_team string")
    got = sorted(r.nation for r in team_names(df).collect())
    want = sorted({n for p in pairs for n in p if n})
    assert got == want
