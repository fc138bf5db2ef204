"""Silver layer: typed, trimmed match rows and joined player rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import norm_key, safe_int, sql_trim, to_int


def match_winner(home_goals="home_goals", away_goals="away_goals",
                 home="home_team", away="away_team", draw: str = "Draw"):
    """Winner of a match: home side, away side, or 'Draw'. NULL goals fall to
    'Draw' (the staging rule)."""
    hg, ag = F.col(home_goals), F.col(away_goals)
    return F.when(hg > ag, F.col(home)).when(ag > hg, F.col(away)).otherwise(F.lit(draw))


def stage_matches(df: DataFrame, year="year", stage="stage", home="home_team_name",
                  home_goals="home_team_goals", away_goals="away_team_goals",
                  away="away_team_name", stadium="stadium", city="city",
                  attendance="attendance", referee="referee") -> DataFrame:
    """Raw match rows -> staged rows (edition_year, stage, ..., winner).

    Integer columns are cast strictly (fractional input rounds half to even),
    text columns are trimmed, rows without a home side are dropped, and the
    winner column is derived. Optional columns (stadium, city, attendance,
    referee) are kept only when the input has them.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [to_int(year, types[year]).alias("edition_year"),
            sql_trim(stage).alias("stage")]
    for src, dst in ((stadium, "stadium"), (city, "city")):
        if src in types:
            cols.append(sql_trim(src).alias(dst))
    cols += [sql_trim(home).alias("home_team"),
             to_int(home_goals, types[home_goals]).alias("home_goals"),
             to_int(away_goals, types[away_goals]).alias("away_goals"),
             sql_trim(away).alias("away_team")]
    if attendance in types:
        cols.append(to_int(attendance, types[attendance]).alias("attendance"))
    if referee in types:
        cols.append(sql_trim(referee).alias("referee"))
    staged = df.where(F.col(home).isNotNull()).select(*cols)
    return staged.withColumn("winner", match_winner())


def stage_players(squads: DataFrame, market: DataFrame, nation="nation", player="player",
                  pos="pos", age="age", mp="mp", gls="gls", ast="ast", m90="90s",
                  m_nation="nation", m_player="player_name",
                  m_value="market_value_eur_m", float32: bool = False) -> DataFrame:
    """Squad rows LEFT JOIN market values on (nation, lower(trim(name))).

    Numeric text is cast leniently (bad values -> NULL); age is the integer
    part before '-' of a 'YY-DDD' text. Join keys are computed once as
    columns so the sort-merge / hash join compares plain strings.
    ``float32=True`` types goals, assists and minutes as 32-bit floats, as the
    reference's staging does; the default is double precision.
    """
    ftype = "float" if float32 else "double"
    s = squads.select(
        F.col(nation).alias("nation"),
        F.col(player).alias("player_name"),
        F.col(pos).alias("position"),
        safe_int(F.split_part(F.col(age).cast("string"), F.lit("-"), F.lit(1))).alias("age"),
        safe_int(F.col(mp)).alias("matches_played"),
        F.col(gls).try_cast(ftype).alias("goals"),
        F.col(ast).try_cast(ftype).alias("assists"),
        F.col(f"`{m90}`").try_cast(ftype).alias("minutes_90s"),
        norm_key(player).alias("__pkey"),
    )
    m = market.select(F.col(m_nation).alias("__mnation"), norm_key(m_player).alias("__mkey"),
                      F.col(m_value).cast("double").alias("market_value_eur_m"))
    j = s.join(m, (s.nation == m.__mnation) & (s.__pkey == m.__mkey), "left")
    return j.drop("__pkey", "__mnation", "__mkey")
