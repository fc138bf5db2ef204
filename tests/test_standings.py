"""Standings derived from results, best thirds, result cards per date."""

from scoreline.operators.standings import (best_thirds, group_status, match_calendar, match_flags, matches_by_date,
                                           standings, upcoming_by_date)

RESULTS = [
    # grp, date, seq, home, hs, as_, away
    ("A", "11/06", 1, "Mexico", 2, 0, "South Africa"),
    ("A", "11/06", 2, "South Korea", 2, 1, "Czechia"),
    ("B", "12/06", 3, "Canada", 1, 1, "Bosnia and Herzegovina"),
    ("B", "13/06", 4, "Qatar", 1, 1, "Switzerland"),
    ("C", "13/06", 5, "Brazil", 1, 1, "Morocco"),
    ("C", "13/06", 6, "Haiti", 0, 1, "Scotland"),
    ("D", "14/06", 7, "Australia", None, None, "Türkiye"),
]
SCHEMA = "grp string, date string, seq_order int, home string, hs int, as_ int, away string"


def test_standings_table(spark):
    t = {(r.grp, r.team): r for r in standings(spark.createDataFrame(RESULTS, SCHEMA)).collect()}
    m = t[("A", "Mexico")]
    assert (m.p, m.v, m.e, m.d, m.gp, m.gc, m.sg, m.pts, m.position, m.advances) == (1, 1, 0, 0, 2, 0, 2, 3, 1, True)
    assert t[("A", "South Korea")].position == 2 and t[("A", "Czechia")].position == 3
    assert t[("A", "Mexico")].sg_str == "+2" and t[("A", "Czechia")].sg_str == "-1"
    assert t[("B", "Canada")].sg_str == "0"
    assert t[("D", "Australia")].p == 0  # unknown score = not played


def test_group_status_and_thirds(spark):
    tab = standings(spark.createDataFrame(RESULTS, SCHEMA))
    s = {r.grp: r for r in group_status(tab).collect()}
    assert s["D"].not_started and s["D"].first_match == "12/06"
    assert not s["A"].not_started and s["A"].first_match == "11/06"
    thirds = best_thirds(tab, n=8).collect()
    assert [r.team for r in thirds] == ["Morocco", "Qatar", "Czechia"]  # pts, gd, gf, then name


def test_matches_by_date(spark):
    df = spark.createDataFrame(RESULTS, SCHEMA)
    rows = matches_by_date(df, order=("seq_order",)).collect()
    assert len(rows) == len(RESULTS)
    assert [r.date for r in rows] == sorted(r.date for r in rows)
    assert {r.date: r.matches_on_date for r in rows}["13/06"] == 3
    assert [r.home for r in rows if r.date == "13/06"][0] == "Qatar"


def test_match_flags(spark):
    r = {x.home: x for x in match_flags(spark.createDataFrame(RESULTS, SCHEMA), "Brazil").collect()}
    assert r["Brazil"].is_draw and r["Brazil"].is_focus and not r["Mexico"].is_focus
    assert r["Mexico"].home_won and r["Haiti"].away_won


def test_dates_follow_the_calendar_not_their_text(spark):
    dates = ["02/06", "01/07", "30/06", "31/06", "TBD", None, "29/02", "1/7"]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(dates)], "date string, seq_order int")
    rows = [(r.date, str(r.day or ""), r.matches_on_date) for r in matches_by_date(df, order=("seq_order",)).collect()]
    assert rows[:3] == [("02/06", "2026-06-02", 1), ("30/06", "2026-06-30", 1), ("01/07", "2026-07-01", 1)]
    assert [r[0] for r in rows[3:]] == ["31/06", "TBD", None, "29/02", "1/7"] and {r[1:] for r in rows[3:]} == {("", 5)}
    assert str(matches_by_date(df, 2028, order=("seq_order",)).first().day) == "2028-02-29"


def test_upcoming_matches_by_kickoff(spark):
    rows = [("15/06", "22:00", 1), ("15/06", "09:00", 2), ("15/06", None, 3), ("14/06", "23:59", 4), ("15/06", "25:00", 5), ("15/06", "", 6)]
    df = spark.createDataFrame(rows, "date string, time string, seq_order int")
    got = upcoming_by_date(df, order=("seq_order",)).collect()
    assert [r.seq_order for r in got] == [4, 2, 1, 3, 5, 6]
    assert [r.kickoff_minute for r in got] == [1439, 540, 1320, None, None, None]
    assert [r.matches_on_date for r in got] == [1, 5, 5, 5, 5, 5]


def test_calendar_of_two_layouts(spark):
    played = spark.createDataFrame([("A", "01/07", 1, "x", 2, 0, "y"), ("A", "14/06", 2, "x", 1, 1, "z")], SCHEMA)
    coming = spark.createDataFrame([("B", "01/07", 3, "u", "v", "13:00")], "grp string, date string, seq_order int, home string, away string, time string")
    got = match_calendar(played, coming, order=("seq_order",)).collect()
    assert [(r.seq_order, r.played, r.hs, r.time, r.matches_on_date) for r in got] == [(2, True, 1, None, 1), (3, False, None, "13:00", 2), (1, True, 2, None, 2)]
