"""Queries over nested and web-shaped data: country features with nation
info, photo cache (missing names, merge, photo column), slugs and thumbnail
URLs, flag columns, display text, label lookups, links from HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (ellipsis, flag_emoji, flag_url, flag_url_alt, initials, repeat_symbol, sql_trim,
                         upgrade_thumbnail, wiki_slug)
from ..operators.analytics import top_per_group
from ..operators.facts import select_existing, team_names
from ..operators.marts import nation_info
from ..operators.photos import merge_cache, names_to_fetch, with_photo
from ..sources.dims import (HIGHLIGHT_STAGES_PT, INFO_DEFAULT, NATION_ISO2, NATION_PT, SQUAD_NATIONS, STAGE_PT, map_expr,
                            values_sql)
from ..sources.fixtures import fixture
from ..sources.tables import read_table
from .oracle import ALL_TEAMS, MART_NATIONS, MART_PLAYERS, MATCH_FX, NATION_FX, PLAYER_FX, STG_MATCHES, STG_NATIONS, STG_PLAYERS
from .q_matches import nations_mart, staged
from .q_players import players_mart
from .registry import osql, register

API = "https://en.wikipedia.org/api/rest_v1/page/summary/"
_REGIONAL = "".join(chr(0x1F1E6 + i) for i in range(26))
N_CTES = [STG_MATCHES, ALL_TEAMS, STG_NATIONS, MART_NATIONS]
P_CTES = [STG_PLAYERS, MART_PLAYERS]


@register("features_lookup", osql(NATION_FX + ["fx_squads"], N_CTES + [("top4", """
SELECT nation, list_sort(list(player)) AS top_players FROM (
  SELECT nation, player, row_number() OVER (PARTITION BY nation ORDER BY player) AS rn FROM fx_squads WHERE player IS NOT NULL) t
WHERE rn <= 4 GROUP BY nation""")], """
SELECT f.country_name, f.iso_a3, f.qualified_2026,
       COALESCE(m.world_cup_titles, 0) AS titles, COALESCE(m.editions_played, 0) AS editions,
       COALESCE(array_to_string(p.top_players, ', '), '') AS top_players,
       CASE WHEN COALESCE(m.world_cup_titles, 0) > 0 THEN trim(repeat('🏆 ', CAST(m.world_cup_titles AS INTEGER)))
            ELSE '—' END AS trophy_str
FROM fx_countries f
LEFT JOIN mart_nations m ON f.country_name = m.nation
LEFT JOIN top4 p ON f.country_name = p.nation
WHERE f.country_name <> ''"""), "S7 S9 J5 P43")
def q_features_lookup(spark, sf):
    info = nations_mart(spark, sf).select(F.col("nation").alias("__n"), "world_cup_titles", "editions_played")
    squads = fixture(spark, sf, "fx_squads").where(F.col("player").isNotNull())
    top4 = (top_per_group(squads, "nation", [F.col("player").asc()], 4)
            .groupBy(F.col("nation").alias("__p"))
            .agg(F.array_sort(F.collect_list("player")).alias("top_players")))
    f = fixture(spark, sf, "fx_countries").where(F.col("country_name") != "")
    j = (f.join(info, f.country_name == F.col("__n"), "left")
          .join(top4, f.country_name == F.col("__p"), "left"))
    titles = F.coalesce(F.col("world_cup_titles"), F.lit(0))
    return j.select(
        "country_name", "iso_a3", "qualified_2026",
        titles.alias("titles"),
        F.coalesce(F.col("editions_played"), F.lit(0)).alias("editions"),
        # the first four names, in order, as one text (as the page lists them)
        F.coalesce(F.array_join("top_players", ", "), F.lit("")).alias("top_players"),
        repeat_symbol("🏆", titles).alias("trophy_str"),
    )


@register("nation_info", osql(["fx_countries", "fx_info", "fx_squads"], [("top4", """
SELECT nation, list(player ORDER BY player)[:4] AS players FROM fx_squads WHERE player IS NOT NULL GROUP BY nation""")], """
SELECT f.country_name, coalesce(i.info_group, '—') AS info_group, coalesce(i.confederation, '—') AS confederation, coalesce(i.titles, 0) AS titles,
       coalesce(i.editions, '—') AS editions, coalesce(i.curiosity, '') AS curiosity, CASE WHEN i.nation IS NULL THEN '' ELSE coalesce(array_to_string(p.players, ', '), '') END AS players,
       CASE WHEN coalesce(i.titles, 0) = 0 THEN '—' ELSE repeat('🏆 ', i.titles - 1) || '🏆' END AS trophies
FROM fx_countries f LEFT JOIN fx_info i ON i.nation = f.country_name LEFT JOIN top4 p ON p.nation = f.country_name"""), "J5 P43")
def q_nation_info(spark, sf):
    """Each country's nested record, or the default one, and what a page shows of it."""
    squads = fixture(spark, sf, "fx_squads").where(F.col("player").isNotNull())
    top = top_per_group(squads, "nation", [F.col("player").asc()], 4).groupBy(F.col("nation").alias("_n")).agg(F.array_sort(F.collect_list("player")).alias("players"))
    info = fixture(spark, sf, "fx_info").join(top, F.col("nation") == F.col("_n"), "left").withColumnRenamed("info_group", "group")
    info = info.withColumn("players", F.coalesce("players", F.array().cast("array<string>")))
    rows = nation_info(fixture(spark, sf, "fx_countries").select("country_name"), info, INFO_DEFAULT)
    return rows.select(
        "country_name", F.col("info.group").alias("info_group"), "info.confederation", "info.titles", "info.editions", "info.curiosity",
        F.array_join(F.slice("info.players", 1, 4), ", ").alias("players"), repeat_symbol("🏆", F.col("info.titles")).alias("trophies"))


_MISSING_SQL = """
SELECT n.name, url_encode(COALESCE(o.slug, replace(n.name, ' ', '_'))) AS slug
FROM (SELECT DISTINCT player_name AS name FROM mart_players WHERE player_name IS NOT NULL) n
LEFT JOIN fx_cache c ON n.name = c.name
LEFT JOIN (SELECT * FROM fx_overrides WHERE slug IS NOT NULL) o ON n.name = o.name
WHERE c.name IS NULL OR (c.url = '' AND o.name IS NOT NULL)"""
CACHE_FX = PLAYER_FX + ["fx_cache", "fx_overrides"]


def _missing(spark, sf):
    p = players_mart(spark, sf)
    return names_to_fetch(p, fixture(spark, sf, "fx_cache"), fixture(spark, sf, "fx_overrides"))


@register("cache_missing", osql(CACHE_FX, P_CTES, _MISSING_SQL), "J6 X2")
def q_cache_missing(spark, sf):
    return _missing(spark, sf)


@register("cache_merge", osql(CACHE_FX, P_CTES + [("upd", f"""
SELECT name, concat('{API}', slug) AS url FROM ({_MISSING_SQL}) m""")], """
SELECT c.name, c.url FROM fx_cache c WHERE NOT EXISTS (SELECT 1 FROM upd u WHERE u.name = c.name)
UNION ALL
SELECT name, url FROM upd"""), "U4 S20")
def q_cache_merge(spark, sf):
    upd = _missing(spark, sf).select("name", F.concat(F.lit(API), F.col("slug")).alias("url"))
    return merge_cache(fixture(spark, sf, "fx_cache"), upd)


@register("slug_url", osql(["fx_cache", "fx_overrides"], [], """
SELECT c.name, url_encode(COALESCE(o.slug, replace(c.name, ' ', '_'))) AS slug,
       regexp_replace(c.url, '/(50|80|100|150|200)px-', '/320px-', 'g') AS photo_url
FROM fx_cache c LEFT JOIN (SELECT * FROM fx_overrides WHERE slug IS NOT NULL) o ON c.name = o.name"""), "X2 X3")
def q_slug_url(spark, sf):
    c = fixture(spark, sf, "fx_cache")
    o = fixture(spark, sf, "fx_overrides").where(F.col("slug").isNotNull()).select(F.col("name").alias("__o"), "slug")
    j = c.join(o, c.name == F.col("__o"), "left")
    return j.select("name", wiki_slug("name", "slug").alias("slug"), upgrade_thumbnail("url").alias("photo_url"))


@register("player_photos", osql(CACHE_FX, P_CTES, """
SELECT p.*, COALESCE(regexp_replace(c.url, '/(50|80|100|150|200)px-', '/320px-', 'g'), '') AS photo_url
FROM mart_players p LEFT JOIN fx_cache c ON p.player_name = c.name"""), "J7")
def q_player_photos(spark, sf):
    return with_photo(players_mart(spark, sf), fixture(spark, sf, "fx_cache"))


@register("flag_columns", osql(MATCH_FX + ["fx_countries"], [STG_MATCHES], f"""
SELECT t.nation, t.iso_a3,
       CASE WHEN t.iso_a3 IS NULL OR t.iso_a3 = '' THEN '' ELSE concat('https://flagcdn.com/w40/', lower(t.iso_a3), '.png') END AS flag_url,
       translate(lower(split_part(t.iso_a3, '-', 1)), 'abcdefghijklmnopqrstuvwxyz', '{_REGIONAL}') AS flag_emoji,
       CASE WHEN t.iso_a3 IS NULL OR t.iso_a3 = '' THEN ''
            ELSE concat('https://hatscripts.github.io/circle-flags/flags/', lower(split_part(t.iso_a3, '-', 1)), '.svg')
       END AS flag_url_alt,
       CASE WHEN i.iso2 IS NULL OR i.iso2 = '' THEN '' ELSE concat('https://flagcdn.com/w40/', lower(i.iso2), '.png') END AS iso2_flag_url
FROM (SELECT n.nation, c.iso_a3
      FROM (SELECT home_team AS nation FROM stg_matches UNION SELECT away_team FROM stg_matches) n
      LEFT JOIN fx_countries c ON lower(n.nation) = lower(c.country_name)
      WHERE n.nation IS NOT NULL AND n.nation <> '') t
LEFT JOIN {values_sql(NATION_ISO2, "key", "iso2", "i")} ON t.nation = i.key"""), "P39 P40")
def q_flag_columns(spark, sf):
    n = team_names(staged(spark, sf))
    c = fixture(spark, sf, "fx_countries").select(F.lower("country_name").alias("__k"), "iso_a3")
    j = n.join(c, F.lower(F.col("nation")) == F.col("__k"), "left")
    iso2 = map_expr(NATION_ISO2, "nation")
    return j.select("nation", "iso_a3", flag_url("iso_a3").alias("flag_url"),
                    flag_emoji("iso_a3").alias("flag_emoji"), flag_url_alt("iso_a3").alias("flag_url_alt"),
                    flag_url(iso2).alias("iso2_flag_url"))


@register("display_text", osql(PLAYER_FX, P_CTES, """
SELECT nation, player_name,
       CASE WHEN length(player_name) > 10 THEN concat(substring(player_name, 1, 10), '…') ELSE player_name END AS short_name,
       CASE WHEN len(parts) >= 2 THEN upper(concat(substring(parts[1], 1, 1), substring(parts[len(parts)], 1, 1)))
            ELSE upper(substring(player_name, 1, 2)) END AS initials,
       CAST(trunc(COALESCE(goals, 0)) AS INTEGER) AS goals_int,
       CASE WHEN position_group = 'Goalkeeper' THEN CAST(COALESCE(matches_played, 0) AS INTEGER)
            ELSE CAST(trunc(COALESCE(goals, 0)) AS INTEGER) END AS stat1,
       CASE WHEN position_group = 'Goalkeeper' THEN 'JGS' ELSE 'GOL' END AS stat1_label
FROM (SELECT *, list_filter(regexp_split_to_array(player_name, '\\s+'), lambda x: x <> '') AS parts FROM mart_players) t"""),
          "P38 P41 P42 P46")
def q_display_text(spark, sf):
    p = players_mart(spark, sf)
    goals = F.coalesce(F.col("goals"), F.lit(0.0)).cast("int")
    gk = F.col("position_group") == "Goalkeeper"
    return p.select("nation", "player_name", ellipsis("player_name", 10).alias("short_name"),
                    initials("player_name").alias("initials"), goals.alias("goals_int"),
                    F.when(gk, F.coalesce(F.col("matches_played"), F.lit(0))).otherwise(goals).alias("stat1"),
                    F.when(gk, F.lit("JGS")).otherwise(F.lit("GOL")).alias("stat1_label"))


_HL = ", ".join(f"'{s}'" for s in HIGHLIGHT_STAGES_PT)


@register("label_lookup", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT m.*, COALESCE(sp.label, m.stage) AS stage_pt, COALESCE(COALESCE(sp.label, m.stage) IN ({_HL}), FALSE) AS is_highlight
FROM stg_matches m LEFT JOIN {values_sql(STAGE_PT, "key", "label", "sp")} ON m.stage = sp.key"""), "P20 P21 P44")
def q_label_lookup(spark, sf):
    m = staged(spark, sf)
    pt = map_expr(STAGE_PT, "stage", F.col("stage"))
    return m.select("*", pt.alias("stage_pt"),
                    F.coalesce(pt.isin(*HIGHLIGHT_STAGES_PT), F.lit(False)).alias("is_highlight"))


@register("translated_matches", osql(MATCH_FX, [STG_MATCHES], f"""
SELECT edition_year AS ano, coalesce(sp.label, stage) AS fase, coalesce(h.label, home_team) AS mandante, home_goals AS gols_mandante,
       away_goals AS gols_visitante, coalesce(a.label, away_team) AS visitante
FROM stg_matches LEFT JOIN {values_sql(STAGE_PT, "key", "label", "sp")} ON stage = sp.key
LEFT JOIN {values_sql(NATION_PT, "key", "label", "h")} ON home_team = h.key
LEFT JOIN {values_sql(NATION_PT, "key", "label", "a")} ON away_team = a.key"""), "P19 P21 P33 P34")
def q_translated_matches(spark, sf):
    """The match table as a page lists it: stage and both names translated, columns
    pruned and renamed."""
    name = lambda c: map_expr(NATION_PT, c, F.col(c))
    m = staged(spark, sf).select("edition_year", map_expr(STAGE_PT, "stage", F.col("stage")).alias("stage"), name("home_team").alias("home_team"),
                                 "home_goals", "away_goals", name("away_team").alias("away_team"), "referee")
    shown = {"edition_year": "ano", "stage": "fase", "home_team": "mandante", "home_goals": "gols_mandante",
             "away_goals": "gols_visitante", "away_team": "visitante"}
    return select_existing(m, list(shown)).withColumnsRenamed(shown)


_SQUADS = "[" + ", ".join(f"'{n}'" for n in SQUAD_NATIONS) + "]"


@register("membership_flag", osql(MATCH_FX + ["fx_countries"], [STG_MATCHES], f"""
SELECT n.nation, q.country_name IS NOT NULL AS is_qualified, list_contains({_SQUADS}, n.nation) AS has_squad
FROM (SELECT home_team AS nation FROM stg_matches UNION SELECT away_team FROM stg_matches) n
LEFT JOIN (SELECT DISTINCT country_name FROM fx_countries WHERE qualified_2026) q ON n.nation = q.country_name
WHERE n.nation IS NOT NULL AND n.nation <> ''"""), "P32")
def q_membership_flag(spark, sf):
    n = team_names(staged(spark, sf))
    q = (fixture(spark, sf, "fx_countries").where(F.col("qualified_2026"))
              .select(F.col("country_name").alias("__q")).distinct())
    squads = F.array(*[F.lit(x) for x in SQUAD_NATIONS])
    return (n.join(q, F.col("nation") == F.col("__q"), "left")
             .select("nation", F.col("__q").isNotNull().alias("is_qualified"),
                     F.array_contains(squads, F.col("nation")).alias("has_squad")))


@register("qualified_nations", osql(NATION_FX, N_CTES, """
SELECT nation, world_cup_titles, win_pct FROM mart_nations WHERE qualified_2026 = TRUE ORDER BY nation"""),
          "P14 K5 K11")
def q_qualified_nations(spark, sf):
    return (nations_mart(spark, sf).where(F.col("qualified_2026"))
            .select("nation", "world_cup_titles", "win_pct").orderBy("nation"))


LINK = '<a href="([^"]*)">([^<]*)</a>'


@register("html_items", f"""
SELECT page_id, i::INTEGER AS link_no, hrefs[i] AS href, trim(texts[i]) AS text
FROM (SELECT page_id, hrefs, texts, unnest(generate_series(1, len(hrefs))) AS i
      FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS hrefs, regexp_extract_all(html, '{LINK}', 2) AS texts
            FROM pages) p) t""", "links of a page")
def q_html_items(spark, sf):
    found = read_table(spark, sf, "pages").select(
        "page_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"),
                                             F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text"))))
    return found.select("page_id", (F.col("pos") + 1).alias("link_no"), F.col("col.href").alias("href"),
                        sql_trim(F.col("col.text")).alias("text"))


@register("json_fields", osql(["fx_events"], [], """
SELECT event_id, event_type, COALESCE(json_extract_string(props, '$.k'), '') AS k,
       COALESCE(json_extract_string(props, '$.thumbnail.source'), '') AS thumbnail_source
FROM fx_events"""), "S20 JSON get with default")
def q_json_fields(spark, sf):
    from ..functions import json_get
    e = fixture(spark, sf, "fx_events")
    return e.select("event_id", "event_type", json_get("props", "$.k").alias("k"),
                    json_get("props", "$.thumbnail.source").alias("thumbnail_source"))


@register("nations_table", osql(NATION_FX, N_CTES, f"""
SELECT m.nation, COALESCE(pt.label, m.nation) AS nacao, m.editions_played, m.wins, m.draws, m.losses,
       m.total_goals_for, m.world_cup_titles, m.win_pct,
       CASE WHEN i.iso2 IS NULL OR i.iso2 = '' THEN '' ELSE concat('https://flagcdn.com/w40/', lower(i.iso2), '.png') END
         AS flag_url
FROM mart_nations m
LEFT JOIN {values_sql(NATION_PT, "key", "label", "pt")} ON m.nation = pt.key
LEFT JOIN {values_sql(NATION_ISO2, "key", "iso2", "i")} ON m.nation = i.key
ORDER BY m.world_cup_titles DESC, m.nation"""), "K11 P19 P39")
def q_nations_table(spark, sf):
    m = nations_mart(spark, sf)
    return (m.select("nation", map_expr(NATION_PT, "nation", F.col("nation")).alias("nacao"),
                     "editions_played", "wins", "draws", "losses", "total_goals_for", "world_cup_titles",
                     "win_pct", flag_url(map_expr(NATION_ISO2, "nation")).alias("flag_url"))
             .orderBy(F.col("world_cup_titles").desc(), "nation"))
