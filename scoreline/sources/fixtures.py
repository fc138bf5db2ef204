"""Stand-in views over the driver's tables.

The reference's own inputs (match results, squads, market values, countries,
photo cache) are mostly not shipped. Each operator therefore runs on views
derived from the driver tables. The SQL text below is the single source of
truth: Spark registers it as temp views and the DuckDB oracle prepends the
very same text as CTEs, so both engines see identical rows. Views change values
only, so that every branch of every lookup is met; they drop no rows.

``fx_matches`` is also available as a DataFrame plan with a join order chosen
for scale (``matches_frame``): orders are joined to their customer first, so
the large lineitem side is shuffled once, on the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import TABLES, read_table

# Real names for some nation keys, so that name lookups hit and miss.
NATION_NAMES = {0: "Brazil", 1: "Argentina", 2: "Germany", 3: "France", 4: "Spain", 5: "England", 6: "Portugal",
                7: "Netherlands", 8: "Morocco", 9: "Japan", 10: "United States", 11: "Mexico", 12: "South Korea",
                13: "Côte d'Ivoire", 14: "New Zealand", 15: "Italy"}
STAGE_NAMES = {"1-URGENT": "Final", "2-HIGH": "Semi-finals", "3-MEDIUM": "Quarter-finals", "4-NOT SPECIFIED": "Group Stage"}
PLAYER_NAMES = {1: "Lionel Messi", 2: "Rodri", 3: "Harry Kane", 4: "Kylian Mbappé"}


def _case(column: str, names: dict, other: str) -> str:
    """A CASE over the literal ``names`` in SQL that both engines read."""
    return f"CASE {column} " + " ".join(f"WHEN {_quoted(k) if isinstance(k, str) else k} THEN {_quoted(v)}" for k, v in names.items()) + f" ELSE {other} END"


def _quoted(v: str) -> str:
    """A string literal; a quote inside is written as chr(39), which both engines read alike."""
    return " || chr(39) || ".join(f"'{part}'" for part in v.split("'"))


# Two rare sides, so that small groups of matches exist.
_HOME = "CASE WHEN l_orderkey % 16000 = 3 THEN 'Fiji' WHEN l_orderkey = 7 AND l_linenumber = 1 THEN 'Palau' ELSE hs.nation END"

FIXTURE_SQL: dict[str, str] = {
    "fx_nations": f"""
SELECT n_nationkey AS nation_key, {_case("n_nationkey", NATION_NAMES, "n_name")} AS nation, n_regionkey AS region_key
FROM nation""",
    "fx_matches": f"""
SELECT l_orderkey AS match_order, l_linenumber AS match_line,
       CAST(year(o_orderdate) AS INT) AS year,
       ' ' || {_case("o_orderpriority", STAGE_NAMES, "o_orderpriority")} || ' ' AS stage,
       concat(' Stadium ', l_suppkey % 40) AS stadium, concat('City ', l_suppkey % 12, ' ') AS city,
       {_HOME} AS home_team_name, CAST(CAST(l_quantity AS BIGINT) % 5 AS INT) AS home_team_goals,
       CAST((l_partkey + l_linenumber) % 5 AS INT) AS away_team_goals, aw.nation AS away_team_name,
       CAST(l_partkey % 90000 AS DOUBLE) + 0.5 AS attendance, concat(' Referee ', l_linenumber, ' ') AS referee
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN fx_nations hs ON s_nationkey = hs.nation_key
JOIN customer ON o_custkey = c_custkey JOIN fx_nations aw ON c_nationkey = aw.nation_key""",
    "fx_matches_null": """
SELECT match_order, match_line, year, stage, stadium, city,
       CASE WHEN match_line = 7 THEN NULL ELSE home_team_name END AS home_team_name,
       nullif(home_team_goals, 4) AS home_team_goals, away_team_goals, away_team_name, attendance, referee
FROM fx_matches""",
    "fx_cups": """
SELECT year, CASE WHEN year = 1997 THEN NULL ELSE winner END AS winner FROM (
  SELECT year, lower(home_team_name) AS winner,
         row_number() OVER (PARTITION BY year ORDER BY sum(home_team_goals) % (year % 10 + 7) DESC, home_team_name) AS rn
  FROM fx_matches GROUP BY year, home_team_name) t
WHERE rn = 1""",
    "fx_countries": """
SELECT CASE WHEN nation_key % 5 = 4 THEN concat(nation, ' FR')
            WHEN nation_key % 3 = 0 THEN lower(nation) ELSE nation END AS country_name,
       substring(r_name, 1, 3) AS iso_a3, nation_key % 2 = 0 AS qualified_2026
FROM fx_nations JOIN region ON region_key = r_regionkey""",
    "fx_people": f"""
SELECT c_custkey, c_name, c_acctbal, nation,
       CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey <= {max(PLAYER_NAMES)} THEN {_case("c_custkey", PLAYER_NAMES, "c_name")}
            WHEN c_custkey % 4 = 1 THEN concat('Ana ', c_name) ELSE c_name END AS player
FROM customer JOIN fx_nations ON c_nationkey = nation_key""",
    "fx_squads": """
SELECT nation, player,
       CASE c_custkey % 9 WHEN 0 THEN 'GK' WHEN 1 THEN 'CB' WHEN 2 THEN 'RB' WHEN 3 THEN 'LB' WHEN 4 THEN 'DM'
            WHEN 5 THEN 'MF' WHEN 6 THEN 'LW' WHEN 7 THEN 'FW' ELSE 'CAM' END AS pos,
       CASE WHEN c_custkey % 11 = 0 THEN 'n/a' ELSE concat(18 + c_custkey % 22, '-', c_custkey % 365) END AS age,
       CAST(c_custkey % 40 AS INT) AS mp, CAST(c_custkey % 17 AS DOUBLE) AS gls, CAST(c_custkey % 13 AS DOUBLE) AS ast,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_custkey % 38 AS DOUBLE) END AS m90
FROM fx_people""",
    "fx_market": """
SELECT nation, CASE WHEN c_custkey % 7 = 0 THEN player || ' Jr' ELSE ' ' || upper(player) || ' ' END AS player_name,
       CAST(floor(abs(c_acctbal) / 50) AS DOUBLE) AS market_value_eur_m
FROM fx_people""",
    "fx_money": """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN concat('€', p_size, 'M') WHEN 1 THEN concat('€', p_size, ',5M')
       WHEN 2 THEN concat('€', p_size, '00k') WHEN 3 THEN '-' WHEN 4 THEN '' WHEN 5 THEN concat('€1.', p_size, ',5M')
       ELSE concat('€', p_size) END AS value_text
FROM part""",
    "fx_results": """
SELECT substring('ABCDEFGHIJKLZ', CAST(match_order % 13 AS INT) + 1, 1) AS grp,
       concat(lpad(CAST((match_order * 7 + match_line) % 28 + 1 AS STRING), 2, '0'), CASE WHEN match_order % 3 = 0 THEN '/07' ELSE '/06' END) AS date,
       match_order AS seq_order, match_line AS seq_line, home_team_name AS home,
       CASE WHEN match_order % 13 = 10 THEN NULL ELSE home_team_goals END AS hs,
       CASE WHEN match_order % 13 = 10 THEN NULL ELSE away_team_goals END AS as_, away_team_name AS away
FROM fx_matches_null""",
    "fx_upcoming": """
SELECT grp, CASE WHEN seq_order % 17 = 0 THEN 'a definir' ELSE date END AS date, seq_order, seq_line, home, away,
       CASE seq_line % 5 WHEN 0 THEN '13:00' WHEN 1 THEN '16:00' WHEN 2 THEN '19:00' WHEN 3 THEN '9:30' END AS time
FROM fx_results WHERE hs IS NULL AND as_ IS NULL""",
    "fx_info": """
SELECT nation, substring('ABCDEFGHIJKL', CAST(nation_key % 12 AS INT) + 1, 1) AS info_group, r_name AS confederation,
       CAST(nation_key % 6 AS INT) AS titles, concat(nation_key % 20 + 1, '') AS editions, concat('Sobre ', nation) AS curiosity
FROM fx_nations JOIN region ON region_key = r_regionkey WHERE nation_key % 4 <> 1""",
    "fx_lines": """
SELECT 'customers' AS source, c_custkey AS id, line FROM fx_csv
UNION ALL
SELECT 'parts' AS source, p_partkey AS id, concat(p_partkey, ',', replace(p_name, ',', ' '), ',', p_size) AS line FROM part""",
    "fx_cache": """
SELECT CASE WHEN c_custkey % 3 = 0 THEN concat(coalesce(player, c_name), ' (old)') ELSE coalesce(player, c_name) END AS name,
       CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('https://img.example/', c_custkey, '/200px-x.jpg') END AS url
FROM fx_people""",
    "fx_overrides": """
SELECT coalesce(player, c_name) AS name, CASE WHEN c_custkey % 10 = 0 THEN concat('slug_(', c_custkey, ')') END AS slug
FROM fx_people""",
    "fx_csv": """
SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN concat('x', c_custkey, ',', c_mktsegment, ',', c_nationkey)
                       WHEN c_custkey % 10 = 7 THEN concat(c_custkey, ',', c_mktsegment)
                       ELSE concat(c_custkey, ',', c_mktsegment, ',', c_nationkey) END AS line
FROM customer""",
    "fx_events": """
SELECT event_id, event_type,
       CASE WHEN event_id % 3 = 0 THEN concat('{"k": "n', event_id % 7, '", "thumbnail": {"source": "https://img.example/', event_id % 11, '.jpg"}}')
            ELSE props END AS props
FROM events""",
}

# Which views and tables each view reads.
FIXTURE_DEPS: dict[str, list[str]] = {
    "fx_nations": ["nation"],
    "fx_matches": ["fx_nations", "lineitem", "orders", "supplier", "customer"],
    "fx_matches_null": ["fx_matches"],
    "fx_cups": ["fx_matches"],
    "fx_countries": ["fx_nations", "region"],
    "fx_people": ["fx_nations", "customer"],
    "fx_squads": ["fx_people"],
    "fx_market": ["fx_people"],
    "fx_money": ["part"],
    "fx_results": ["fx_matches_null"],
    "fx_upcoming": ["fx_results"],
    "fx_info": ["fx_nations", "region"],
    "fx_lines": ["fx_csv", "part"],
    "fx_cache": ["fx_people"],
    "fx_overrides": ["fx_people"],
    "fx_csv": ["customer"],
    "fx_events": ["events"],
}


def matches_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_matches`` as a DataFrame plan, same rows as the SQL text.

    Join plan for scale: lineitem is the largest input and must meet orders
    (order key) and supplier (supplier key), so it is shuffled twice at
    scale unless a side is measured small enough to broadcast. Both big
    joins therefore carry only narrow columns: orders are reduced to their
    customer's nation key first, supplier to its nation key, and the two
    nation names are resolved last from the nation table (25 rows, broadcast
    by the planner on its measured size).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    read_table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    n = spark.sql(FIXTURE_SQL["fx_nations"])
    away = (o.join(c, o.o_custkey == c.c_custkey)
             .select("o_orderkey", F.year("o_orderdate").cast("int").alias("year"), "o_orderpriority",
                     F.col("c_nationkey").alias("aw_key")))
    m = li.join(away, li.l_orderkey == away.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    hs = n.select(F.col("nation_key").alias("hs_key"), F.col("nation").alias("hs_name"))
    aw = n.select(F.col("nation_key").alias("aw_key2"), F.col("nation").alias("aw_name"))
    m = (m.join(hs, F.col("s_nationkey") == F.col("hs_key"))
          .join(aw, F.col("aw_key") == F.col("aw_key2")))
    stage = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_NAMES.items() for x in kv]), "o_orderpriority"),
                       F.col("o_orderpriority"))
    home = (F.when(F.col("l_orderkey") % 16000 == 3, "Fiji")
             .when((F.col("l_orderkey") == 7) & (F.col("l_linenumber") == 1), "Palau").otherwise(F.col("hs_name")))
    return m.select(
        F.col("l_orderkey").alias("match_order"),
        F.col("l_linenumber").alias("match_line"),
        F.col("year"),
        F.concat(F.lit(" "), stage, F.lit(" ")).alias("stage"),
        F.concat(F.lit(" Stadium "), F.col("l_suppkey") % 40).alias("stadium"),
        F.concat(F.lit("City "), F.col("l_suppkey") % 12, F.lit(" ")).alias("city"),
        home.alias("home_team_name"),
        (F.col("l_quantity").cast("bigint") % 5).cast("int").alias("home_team_goals"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("int").alias("away_team_goals"),
        F.col("aw_name").alias("away_team_name"),
        ((F.col("l_partkey") % 90000).cast("double") + 0.5).alias("attendance"),
        F.concat(F.lit(" Referee "), F.col("l_linenumber"), F.lit(" ")).alias("referee"),
    )


def needed(names: list[str]) -> list[str]:
    """``names`` and all views and tables that they read, each after what it reads."""
    out: list[str] = []

    def add(n):
        for d in FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return out


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stand-in view as a DataFrame. Only the views and tables that it reads are
    registered, for ``sf_dir``; nothing is computed or written. The match rows come from
    the bronze layer if one is in use (``layers``)."""
    from .layers import layer
    if name == "fx_matches":
        return layer(spark, sf_dir, "bronze_matches", lambda: matches_frame(spark, sf_dir))
    for n in FIXTURE_DEPS[name]:
        (read_table(spark, sf_dir, n) if n in TABLES else fixture(spark, sf_dir, n)).createOrReplaceTempView(n)
    return spark.sql(FIXTURE_SQL[name])


def oracle_ctes(names: list[str]) -> str:
    """'WITH a AS (...), b AS (...)' for the views ``names`` and what they read."""
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in needed(names) if n in FIXTURE_SQL]
    return "WITH " + ",\n".join(parts) + "\n"
