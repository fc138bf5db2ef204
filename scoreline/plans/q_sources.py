"""Queries over text built from driver columns and parsed back: typed CSV with rejected
lines, reports of sources, GeoJSON features, the key-value cache, matches of one side, layouts
with other names, models in dependency order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import select_existing, side_view, unify_layouts
from ..operators.marts import edition_history_goals, nation_stats
from ..sources.dims import CONFEDERATION_DEFAULT, confederation_map, dim_frame, lookup, values_sql
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from ..sources.ingest import source_report
from ..sources.io import country_rows, feature_text, named_features, normalize_headers, parse_csv_lines, parse_feature_text, reject_report, table_or_fallback
from .oracle import ALL_TEAMS, HIST_GOALS, MART_NATIONS, MART_PLAYERS, MATCH_FX, STG_MATCHES, STG_NATIONS, STG_PLAYERS
from .q_matches import FOCUS_TEAM, staged
from .registry import osql, register

CSV_SCHEMA = "id BIGINT, segment STRING, nation_key INT"
CSV = ("parsed", """
SELECT c_custkey, line, try_cast(f[1] AS BIGINT) AS id, f[2] AS segment, try_cast(f[3] AS INTEGER) AS nation_key,
       CASE WHEN len(f) <> 3 OR try_cast(f[1] AS BIGINT) IS NULL THEN line END AS _corrupt_record
FROM (SELECT *, string_split(line, ',') AS f FROM fx_csv)""")


def _csv(spark, sf):
    return parse_csv_lines(fixture(spark, sf, "fx_csv"), "line", CSV_SCHEMA)


@register("csv_typed", osql(["fx_csv"], [CSV], "SELECT * FROM parsed"), "S1 S2 S3 S6")
def q_csv_typed(spark, sf):
    return _csv(spark, sf)


@register("csv_rejects", osql(["fx_csv"], [CSV], """
SELECT 'customers' AS source, count(*) AS rows, count(_corrupt_record) AS rejected_rows FROM parsed"""), "S16")
def q_csv_rejects(spark, sf):
    return reject_report(_csv(spark, sf), "customers")


@register("ingest_report", osql(["fx_lines"], [("fields", "SELECT source, string_split(line, ',') AS f FROM fx_lines"), ("judged", """
SELECT source, len(f) <> 3 OR try_cast(f[1] AS BIGINT) IS NULL OR try_cast(f[3] AS INTEGER) IS NULL AS bad FROM fields""")], """
SELECT source, CASE WHEN count_if(bad) > 0 THEN 'rejected' ELSE 'read' END AS status, count(*) AS rows, count_if(bad)::BIGINT AS rejected_rows, NULL::VARCHAR AS error
FROM judged GROUP BY source
UNION ALL SELECT 'nowhere', 'failed', 0, 0, 'PATH_NOT_FOUND'
UNION ALL SELECT 'none', 'empty', 0, 0, NULL"""), "S16")
def q_ingest_report(spark, sf):
    """Sources of lines: one with bad lines, one whole, one missing, one without rows."""
    lines = fixture(spark, sf, "fx_lines")
    source = lambda name: lambda: parse_csv_lines(lines.where(F.col("source") == name), "line", CSV_SCHEMA)
    return source_report(spark, {"customers": source("customers"), "nowhere": lambda: spark.read.text(f"{sf}/nowhere.csv"), "parts": source("parts"), "none": source("none")})


@register("header_rules", "SELECT c_custkey AS cust_key, c_name AS full__name, c_mktsegment AS market_segment FROM customer", "S4 S5")
def q_header_rules(spark, sf):
    """Headers with odd spaces and case, by the CSV rule and then by that of HTML tables."""
    c = read_table(spark, sf, "customer")
    csv = normalize_headers(c.select(F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Full  Name"), F.col("c_mktsegment").alias("Market\tSegment")))
    return normalize_headers(csv, "html")


@register("geo_features", osql(["fx_countries"], [], """
SELECT country_name, upper(iso_a3) AS iso_a3, FALSE AS qualified_2026 FROM fx_countries WHERE country_name <> ''"""), "S7 S8 S9")
def q_geo_features(spark, sf):
    """Features written as JSON text, one per line, and read by the readers' schema."""
    c = fixture(spark, sf, "fx_countries")
    props = F.create_map(F.lit("name"), F.col("country_name"), F.lit("ISO3166-1-Alpha-3"), F.upper("iso_a3"))
    return country_rows(named_features(parse_feature_text(feature_text(c.select(props.alias("properties"), F.lit("{}").alias("geometry"))))))


@register("kv_cache", osql(["fx_cache"], [], "SELECT name, url FROM fx_cache"), "S20")
def q_kv_cache(spark, sf):
    """The cache written as JSON text, one entry per line, and parsed back."""
    text = fixture(spark, sf, "fx_cache").select(F.to_json(F.struct("name", "url")).alias("line"))
    return text.select(F.from_json("line", "name string, url string").alias("e")).select("e.*")


@register("side_matches", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT *, list_extract([away_team, home_team], p) AS opponent, list_extract([home_goals, away_goals], p) AS team_goals,
       list_extract([away_goals, home_goals], p) AS opponent_goals
FROM (SELECT *, list_position([home_team, away_team], '{FOCUS_TEAM}') AS p FROM stg_matches) WHERE p > 0""".replace("SELECT *, list_extract", "SELECT * EXCLUDE (p), list_extract")), "P9 P10")
def q_side_matches(spark, sf):
    return side_view(staged(spark, sf), FOCUS_TEAM)


# a column's other names, in the order in which they are looked for
LAYOUT = {"games": ["matches_played"], "goals_scored": ["goals_for"], "goals_conceded": ["goals_against"]}


@register("history_layouts", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, HIST_GOALS], """
SELECT team, edition_year, games, wins, CASE WHEN edition_year % 2 = 0 THEN draws END AS draws, goals_scored, goals_conceded,
       CASE WHEN edition_year % 2 = 0 THEN 'even' ELSE 'odd' END AS file_group
FROM hist_goals"""), "P33 P34 U3")
def q_history_layouts(spark, sf):
    """Records of each edition in two layouts: other names, and a column that one of them lacks."""
    h = edition_history_goals(staged(spark, sf))
    rows = lambda odd, name: h.where(F.pmod("edition_year", F.lit(2)) == odd).withColumn("file_group", F.lit(name))
    even = rows(0, "even").withColumnsRenamed({"games": "matches_played", "goals_scored": "goals_for"})
    odd = rows(1, "odd").withColumnsRenamed({"goals_conceded": "goals_against"}).drop("draws")
    return select_existing(unify_layouts([even, odd], LAYOUT), ["team", "edition_year", "games", "wins", "draws", "goals_scored", "goals_conceded", "no_such_column", "file_group"])


@register("models_in_order", osql(["fx_matches_null", "fx_cups", "fx_countries", "fx_squads", "fx_market"],
                                  [STG_MATCHES, ALL_TEAMS, STG_NATIONS, MART_NATIONS, STG_PLAYERS, MART_PLAYERS], """
SELECT 'stg_matches' AS model, count(*) AS rows FROM stg_matches
UNION ALL SELECT 'stg_nations', count(*) FROM stg_nations
UNION ALL SELECT 'stg_players', count(*) FROM stg_players
UNION ALL SELECT 'mart_nations_performance', count(*) FROM mart_nations
UNION ALL SELECT 'mart_players_profile', count(*) FROM mart_players
UNION ALL SELECT 'mart_edition_history', count(DISTINCT (team, edition_year)) FROM all_teams"""), "S17")
def q_models_in_order(spark, sf):
    """Every model, each built from those that it declares as its inputs, and its rows."""
    from .models import MODELS, build_order, standin_bronze
    tables = standin_bronze(spark, sf)
    for name in build_order(bronze=set(tables)):
        tables[name] = MODELS[name][1](tables)
    return reduce(DataFrame.unionByName, [tables[m].agg(F.lit(m).alias("model"), F.count(F.lit(1)).alias("rows")) for m in MODELS])


@register("history_fallback", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, HIST_GOALS], "SELECT * FROM hist_goals"), "S22")
def q_history_fallback(spark, sf):
    """The stored history if there is one, else the same rows from the staged matches."""
    return table_or_fallback(spark, f"{sf}/mart_history.parquet", lambda: edition_history_goals(staged(spark, sf)))


@register("confederation_join", osql(MATCH_FX, [STG_MATCHES, ALL_TEAMS, STG_NATIONS], f"""
SELECT nation, coalesce((SELECT max(conf) FROM {values_sql(confederation_map(), "key", "conf", "cf")} WHERE cf.key = nation), '{CONFEDERATION_DEFAULT}') AS confederation
FROM stg_nations"""), "J4 P18")
def q_confederation_join(spark, sf):
    """Nations with a dimension table joined to them, its default for the others."""
    nations = nation_stats(staged(spark, sf)).select("nation")
    return lookup(nations, "nation", dim_frame(spark, confederation_map()), "confederation", CONFEDERATION_DEFAULT, bounded=True)
