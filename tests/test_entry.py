"""Driver contract: entry() smoke run, registry consistency, and every
registered query against its DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from scoreline.plans import all_queries
from scoreline.sources.tables import TABLES

from .conftest import SF_SMALL


QUERIES = all_queries()

# Queries that exist to sort: their sequence is compared, too.
SORTED = ["nations_performance", "edition_history_winner", "players_profile", "team_matches", "qualified_nations",
          "ranking_resorted", "player_search", "nations_table", "semi_anti_pref", "team_names", "matches_by_date",
          "ranking_topn", "best_thirds", "player_sort_valor", "player_sort_gols", "player_sort_assist", "player_sort_idade",
          "value_by_position", "position_options", "nation_options", "upcoming_by_date", "match_calendar"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "nation" in df.columns and "win_pct" in df.columns
    assert df.count() >= 0


def test_every_query_has_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert all(q.sql and E.oracle_sql()[n] == q.sql for n, q in QUERIES.items())
    assert len(QUERIES) >= 70


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name].build(spark, SF_SMALL)
    cols = sorted(df.columns)
    got = [repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect()]
    cur = duck.execute(QUERIES[name].sql)
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = [repr(tuple(_norm(r[i]) for i in idx)) for r in cur.fetchall()]
    assert sorted(got) == sorted(want)
    if name in SORTED:
        assert got == want


def test_switching_input_folders_in_one_session(spark):
    q = {n: x.build for n, x in QUERIES.items()}
    small = q["nation_stats"](spark, SF_SMALL).agg({"total_matches": "sum"}).first()[0]
    big = q["nation_stats"](spark, "/root/testdata/sf0.01").agg({"total_matches": "sum"}).first()[0]
    again = q["nation_stats"](spark, SF_SMALL).agg({"total_matches": "sum"}).first()[0]
    assert small == again and big > 5 * small
    p_small = q["players_profile"](spark, SF_SMALL).count()
    p_big = q["radar_scores"](spark, "/root/testdata/sf0.01").count()
    assert (p_small, p_big) == (148, 1484)


def test_every_match_has_its_card(spark):
    cards = QUERIES["matches_by_date"].build(spark, SF_SMALL)
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert cards.count() == lines
    assert cards.agg({"matches_on_date": "max"}).first()[0] < lines


def test_self_matches_stay_and_count_twice(spark, duck):
    m = QUERIES["stage_matches"].build(spark, SF_SMALL)
    own = m.where("home_team = away_team").count()
    assert own > 0
    total = QUERIES["nation_stats"].build(spark, SF_SMALL).agg({"total_matches": "sum"}).first()[0]
    assert total == 2 * m.count()


# (query, expression over its rows): each must have more than one outcome, or its lookup or
# branch would be tested on one side only.
BRANCHES = [
    ("ranking_filtered", "confederation"), ("ranking_topn", "confederation"), ("name_lookup", "label = nation"), ("label_lookup", "is_highlight"),
    ("label_lookup", "stage_pt = stage"), ("membership_flag", "has_squad"), ("membership_flag", "is_qualified"), ("flag_columns", "iso2_flag_url = ''"),
    ("semi_anti_pref", "is_preferred"), ("group_not_started", "not_started"), ("group_not_started", "first_match = 'em breve'"), ("display_text", "initials"),
    ("json_fields", "thumbnail_source = ''"), ("title_years_literal", "is_title_year"), ("title_flags", "is_title_year"), ("dq_not_null", "passed"),
    ("stage_players", "player_name IS NULL"), ("stage_players", "market_value_eur_m IS NULL"), ("stage_players", "age IS NULL"), ("cache_missing", "slug LIKE 'slug%'"),
    ("csv_typed", "_corrupt_record IS NULL"), ("head_to_head_translated", "adversario = opponent"), ("translated_matches", "fase"), ("stage_matches", "attendance"),
    ("features_lookup", "trophy_str = '—'"), ("nation_info", "info_group = '—'"), ("nation_info", "trophies = '—'"), ("matches_by_date", "substring(day, 6, 2)"), ("upcoming_by_date", "day IS NULL"),
    ("upcoming_by_date", "kickoff_minute IS NULL"), ("match_calendar", "played"), ("short_names", "home_short = 'EUA'"), ("history_layouts", "draws IS NULL"), ("history_layouts", "file_group"),
    ("ingest_report", "status"), ("confederation_join", "confederation = 'Outro'"), ("dq_unique", "passed"), ("value_tier", "tier"), ("default_pick", "default_player IN ('Lionel Messi', 'Rodri', 'Harry Kane', 'Kylian Mbappé')"),
]


@pytest.mark.parametrize("name,what", BRANCHES)
def test_every_branch_is_met(spark, name, what):
    rows = QUERIES[name].build(spark, "/root/testdata/sf0.01")
    assert rows.selectExpr(f"{what} AS x").distinct().limit(2).count() == 2


def test_small_groups_are_filtered(spark):
    sf = "/root/testdata/sf0.01"
    games = QUERIES["edition_history_goals"].build(spark, sf)
    assert games.where("games < 3").count() > 0 and games.where("games >= 3").count() > 0
    few = QUERIES["nation_stats"].build(spark, sf).where("total_matches <= 5").count()
    assert few > 0


def test_building_a_query_starts_no_job(spark):
    for name in ("parse_money", "stage_players", "nations_performance", "multi_source_union"):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        df = QUERIES[name].build(spark, SF_SMALL)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build-{name}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(jobs) <= (2 if name == "parse_money" else 20)  # at most schema reads of the tables
        if name == "parse_money":
            assert "part.parquet" in df._jdf.queryExecution().executedPlan().toString()
            assert "lineitem" not in df._jdf.queryExecution().executedPlan().toString()


def test_layers_are_read_once_built(spark, tmp_out):
    from scoreline.plans.models import build_layers
    from scoreline.sources.layers import use_layers
    plain = {n: sorted(map(str, QUERIES[n].build(spark, SF_SMALL).collect())) for n in ("nations_table", "nation_stats", "squad_kpis")}
    build_layers(spark, SF_SMALL, f"{tmp_out}/layers")
    try:
        for n, rows in plain.items():
            df = QUERIES[n].build(spark, SF_SMALL)
            assert any("/layers/" in f for f in df.inputFiles())
            assert sorted(map(str, df.collect())) == rows
    finally:
        use_layers(spark, SF_SMALL, None)
