"""Group standings computed from match results, and the result-card frames.

The reference keeps a hand-entered standings table next to its results; here
the table is derived from the results themselves (one row per side and
match, then one aggregation), so it stays right as results arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.dims import GROUP_START, GROUP_START_DEFAULT, SEASON, map_expr
from .analytics import count_when


def team_results(results: DataFrame, grp="grp", home="home", away="away",
                 hs="hs", as_="as_") -> DataFrame:
    """Each result twice, once per side: (grp, team, gf, ga). Written as one
    ``inline(array(struct, struct))`` so the input is scanned once. Sides
    with no name are dropped."""
    def side(t, f, a):
        return F.struct(F.col(grp).alias("grp"), F.col(t).alias("team"),
                        F.col(f).alias("gf"), F.col(a).alias("ga"))
    return (results.select(F.inline(F.array(side(home, hs, as_), side(away, as_, hs))))
                   .where(F.col("team").isNotNull()))


def standings(results: DataFrame, **cols) -> DataFrame:
    """Per (group, side): P, V, E, D, GP, GC, SG, PTS and the position in the
    group (pts, goal difference, goals for, then name). A match whose score
    is not known yet counts as not played. The top two advance.

    The aggregation is partial per task before the shuffle; the ranking
    window then sees one row per side of a group.
    """
    s = team_results(results, **cols)
    played = F.col("gf").isNotNull() & F.col("ga").isNotNull()
    agg = s.groupBy("grp", "team").agg(
        count_when(played).alias("p"),
        count_when(played & (F.col("gf") > F.col("ga"))).alias("v"),
        count_when(played & (F.col("gf") == F.col("ga"))).alias("e"),
        count_when(played & (F.col("gf") < F.col("ga"))).alias("d"),
        F.coalesce(F.sum(F.when(played, F.col("gf"))), F.lit(0)).alias("gp"),
        F.coalesce(F.sum(F.when(played, F.col("ga"))), F.lit(0)).alias("gc"),
    )
    agg = (agg.withColumn("sg", F.col("gp") - F.col("gc"))
              .withColumn("pts", F.col("v") * 3 + F.col("e")))
    w = Window.partitionBy("grp").orderBy(F.col("pts").desc(), F.col("sg").desc(),
                                          F.col("gp").desc(), F.col("team").asc())
    return (agg.withColumn("position", F.row_number().over(w))
               .withColumn("advances", F.col("position") <= 2)
               .withColumn("sg_str", F.when(F.col("sg") > 0, F.concat(F.lit("+"), F.col("sg").cast("string")))
                                      .otherwise(F.col("sg").cast("string"))))


def best_thirds(table: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` best third-placed sides over all groups (a top-n: each task
    keeps n rows, then one merge)."""
    return (table.where(F.col("position") == 3)
                 .orderBy(F.col("pts").desc(), F.col("sg").desc(), F.col("gp").desc(),
                          F.col("team").asc(), F.col("grp").asc())
                 .limit(n))


def calendar_day(date, season: int) -> Column:
    """The day that a year-less 'dd/mm' text means in ``season``; null for any other text."""
    text = F.col(date) if isinstance(date, str) else date
    return F.try_to_date(F.concat(text, F.lit(f"/{season}")), "dd/MM/yyyy")


def matches_by_date(results: DataFrame, season: int = SEASON, date="date", order=("seq_order", "seq_line"), count="matches_on_date") -> DataFrame:
    """Cards per date: every match, in order of the calendar and of input, with its day and the
    number of matches on it. Texts that are no date come last, counted together.

    The counts are one row per day of a season, a size that the date's form bounds, so
    they are broadcast and the matches are shuffled once, for the sort; its further
    keys let one day spread over many tasks.
    """
    days = results.withColumn("day", calendar_day(date, season))
    counts = days.groupBy(F.col("day").alias("_day")).agg(F.count(F.lit(1)).alias(count))
    out = days.join(F.broadcast(counts), F.col("day").eqNullSafe(F.col("_day"))).drop("_day")
    return out.orderBy(F.col("day").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in order])


def upcoming_by_date(upcoming: DataFrame, season: int = SEASON, date="date", time="time", order=("seq_order", "seq_line")) -> DataFrame:
    """Matches to come, by day and kick-off ('HH:mm' text; others last), with the number of
    matches on the day: ``matches_by_date`` without scores."""
    kickoff = F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.col(time)), F.lit("yyyy-MM-dd HH:mm"))
    known = upcoming.withColumn("kickoff_minute", (F.hour(kickoff) * 60 + F.minute(kickoff)).cast("int"))
    return matches_by_date(known, season, date, ("kickoff_minute", *order))


def match_calendar(results: DataFrame, upcoming: DataFrame, season: int = SEASON, order=("seq_order", "seq_line")) -> DataFrame:
    """Played and coming matches as one frame of two layouts: results have scores and no
    time, fixtures a time and no scores. In order of day, kick-off (results last) and input."""
    both = results.withColumn("played", F.lit(True)).unionByName(upcoming.withColumn("played", F.lit(False)), allowMissingColumns=True)
    return upcoming_by_date(both, season, order=order)


def group_status(table: DataFrame) -> DataFrame:
    """Per group: not started (every side has P = 0) and the first match date
    ('em breve' when the group is unknown)."""
    return (table.groupBy("grp").agg(F.bool_and(F.col("p") == 0).alias("not_started"),
                                     F.count(F.lit(1)).alias("sides"))
                 .withColumn("first_match", map_expr(GROUP_START, "grp", GROUP_START_DEFAULT)))


def match_flags(results: DataFrame, focus: str, home="home", away="away", hs="hs", as_="as_") -> DataFrame:
    """Per result: draw, home won, away won, and whether the focus side plays."""
    h, a = F.col(hs), F.col(as_)
    return results.select(
        "*",
        (h == a).alias("is_draw"), (h > a).alias("home_won"), (a > h).alias("away_won"),
        ((F.col(home) == focus) | (F.col(away) == focus)).alias("is_focus"),
    )
