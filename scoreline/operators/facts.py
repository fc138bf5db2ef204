"""Match facts seen from each side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def both_sides(df: DataFrame, home="home_team", away="away_team", home_goals="home_goals",
               away_goals="away_goals", keep=("edition_year", "winner")) -> DataFrame:
    """Each match twice, once from each side: (team, opponent, goals_for,
    goals_against, is_home, *keep).

    Written as ``inline(array(struct, struct))`` so the input is scanned once
    (a UNION ALL of two projections would evaluate the whole input plan twice).
    """
    keep = [k for k in keep if k in df.columns]

    def side(team, opp, gf, ga, is_home):
        return F.struct(F.col(team).alias("team"), F.col(opp).alias("opponent"),
                        F.col(gf).alias("goals_for"), F.col(ga).alias("goals_against"),
                        F.lit(is_home).alias("is_home"),
                        *[F.col(k).alias(k) for k in keep])

    return df.select(F.inline(F.array(side(home, away, home_goals, away_goals, True),
                                      side(away, home, away_goals, home_goals, False))))


def side_view(df: DataFrame, team: str, home="home_team", away="away_team",
              home_goals="home_goals", away_goals="away_goals") -> DataFrame:
    """Matches of one side (home = t OR away = t, pushed into the scan) with
    opponent, own goals and opponent goals."""
    is_home = F.col(home) == F.lit(team)
    return (df.where((F.col(home) == team) | (F.col(away) == team))
              .withColumn("opponent", F.when(is_home, F.col(away)).otherwise(F.col(home)))
              .withColumn("team_goals", F.when(is_home, F.col(home_goals)).otherwise(F.col(away_goals)))
              .withColumn("opponent_goals", F.when(is_home, F.col(away_goals)).otherwise(F.col(home_goals))))


def result_code(gf="goals_for", ga="goals_against"):
    """'V' win, 'E' draw, else 'D' (NULL goals count as a defeat, like the
    head-to-head table of the reference)."""
    return F.when(F.col(gf) > F.col(ga), "V").when(F.col(gf) == F.col(ga), "E").otherwise("D")


def team_names(df: DataFrame, home="home_team", away="away_team") -> DataFrame:
    """Distinct names over both sides, NULL and '' dropped (one scan)."""
    return (df.select(F.explode(F.array(F.col(home), F.col(away))).alias("nation"))
              .where(F.col("nation").isNotNull() & (F.col("nation") != ""))
              .distinct())


def rename_if_missing(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Schema-adaptive rename: ``old -> new`` only when ``new`` is absent and
    ``old`` is present (metadata only, no data pass)."""
    for old, new in renames.items():
        if new not in df.columns and old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def unify_layouts(frames: list[DataFrame], names: dict[str, list[str]]) -> DataFrame:
    """Rows of frames whose columns go by different names, as one frame. ``names`` declares
    for each column the other names that it may have, the preferred first: a frame that has
    the column keeps it, else the first of the others that it has is renamed (metadata
    only). Columns that a frame lacks are null."""
    out = []
    for df in frames:
        for column, others in names.items():
            for other in others:
                df = rename_if_missing(df, {other: column})
        out.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def read_layouts(spark: SparkSession, groups: dict[str, list[str]], names: dict[str, list[str]], fmt: str = "parquet", group_col: str = "file_group") -> DataFrame:
    """One input whose files come in several layouts: each group of files (name -> paths) has one
    layout and is one scan; ``unify_layouts`` resolves the names, and ``group_col`` says
    which group a row is from."""
    return unify_layouts([spark.read.format(fmt).load(paths).withColumn(group_col, F.lit(name)) for name, paths in groups.items()], names)


def select_existing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Project the listed columns that exist, in the listed order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])
