"""Oracle CTEs for DuckDB over the stand-in views, used only by ``oracle_sql()``.

They state the rules by another way of computing than the Spark side, so that they are
a second opinion: sides by unnesting a pair of records, totals over all editions by
adding up per-edition rows, losses as what remains, lookups by scalar subqueries and
lists instead of joins.
"""

from ..sources.dims import POSITION_GROUPS

STG_MATCHES = ("stg_matches", """
SELECT year::INTEGER AS edition_year, trim(stage) AS stage, trim(stadium) AS stadium, trim(city) AS city, h AS home_team,
       home_team_goals::INTEGER AS home_goals, away_team_goals::INTEGER AS away_goals, a AS away_team,
       attendance::INTEGER AS attendance, trim(referee) AS referee,
       CASE sign(home_team_goals - away_team_goals) WHEN 1 THEN h WHEN -1 THEN a ELSE 'Draw' END AS winner
FROM (SELECT *, trim(home_team_name) AS h, trim(away_team_name) AS a FROM fx_matches_null)
WHERE h IS NOT NULL""")

ALL_TEAMS = ("all_teams", """
SELECT s.* FROM (
  SELECT unnest([
    {'team': home_team, 'opponent': away_team, 'edition_year': edition_year, 'stage': stage, 'goals_for': home_goals, 'goals_against': away_goals, 'winner': winner},
    {'team': away_team, 'opponent': home_team, 'edition_year': edition_year, 'stage': stage, 'goals_for': away_goals, 'goals_against': home_goals, 'winner': winner}]) AS s
  FROM stg_matches)""")

STG_NATIONS = ("stg_nations", """
SELECT team AS nation, count(edition_year) AS editions_played, sum(m)::BIGINT AS total_matches, sum(w)::BIGINT AS wins, sum(d)::BIGINT AS draws,
       (sum(m) - sum(w) - sum(d))::BIGINT AS losses, sum(f)::BIGINT AS total_goals_for, sum(g)::BIGINT AS total_goals_against,
       min(edition_year) AS first_edition, max(edition_year) AS last_edition
FROM (SELECT team, edition_year, count(*) AS m, count_if(winner = team) AS w, count_if(winner = 'Draw') AS d, sum(goals_for) AS f, sum(goals_against) AS g
      FROM all_teams GROUP BY ALL)
GROUP BY team""")

MART_NATIONS = ("mart_nations", """
SELECT *, (SELECT count(*) FROM fx_cups WHERE lower(winner) = lower(nation)) AS world_cup_titles,
       (SELECT max(iso_a3) FROM fx_countries WHERE lower(country_name) = lower(nation)) AS iso_a3,
       EXISTS (FROM fx_countries WHERE lower(country_name) = lower(nation) AND qualified_2026) AS qualified_2026,
       round(wins / total_matches * 100, 1) AS win_pct
FROM stg_nations""")

HIST_GOALS = ("hist_goals", """
SELECT team, edition_year, count(*) AS games, count_if(x = 1)::BIGINT AS wins, count_if(x = 0)::BIGINT AS draws, count_if(x = -1)::BIGINT AS losses,
       sum(goals_for)::BIGINT AS goals_scored, sum(goals_against)::BIGINT AS goals_conceded
FROM (SELECT *, sign(goals_for - goals_against) AS x FROM all_teams) GROUP BY ALL""")

STG_PLAYERS = ("stg_players", """
SELECT q.nation, q.player AS player_name, q.pos AS position,
       nullif(regexp_extract(q.age, '^([0-9]+)(-|$)', 1), '')::INTEGER AS age, q.mp::INTEGER AS matches_played,
       q.gls::DOUBLE AS goals, q.ast::DOUBLE AS assists, q.m90::DOUBLE AS minutes_90s, v.market_value_eur_m
FROM (SELECT *, lower(trim(player)) AS k FROM fx_squads) q
LEFT JOIN (SELECT nation, lower(trim(player_name)) AS k, market_value_eur_m FROM fx_market) v USING (nation, k)""")

_GROUPS = "MAP {" + ", ".join(f"'{code}': '{group}'" for group, codes in POSITION_GROUPS.items() for code in codes) + "}"

MART_PLAYERS = ("mart_players", f"""
SELECT *, coalesce({_GROUPS}[position], 'Unknown') AS position_group
FROM stg_players WHERE player_name IS NOT NULL""")

MATCH_FX = ["fx_matches_null"]
NATION_FX = ["fx_matches_null", "fx_cups", "fx_countries"]
PLAYER_FX = ["fx_squads", "fx_market"]
