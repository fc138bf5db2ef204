"""Analytics over the marts: rankings, head-to-head records, history KPIs,
squad KPIs, value breakdowns, histograms and min-max radar scores.

Every operator works for all entities at once (group by the entity instead of
filtering one parameter), so one job serves every selection a user can make.
Global bounds (min / max over a whole table) are attached as a scalar
subquery: one aggregate row computed once and inlined as a constant, never a
cross join and never a global window (which would pull all rows into a
single task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip_lower, ellipsis, round2_even, round_half_even
from ..sources.dims import (CONFEDERATION_DEFAULT, NATION_PT, POSITION_ORDER_PT, POSITION_PT,
                            STAR_PLAYERS, confederation_map, map_expr)
from .facts import both_sides, result_code


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


# ---------------------------------------------------------------------------
# Ranking page
# ---------------------------------------------------------------------------

def with_ranking_metrics(mart: DataFrame) -> DataFrame:
    """Nations mart + goals_per_game (2 decimals, half even), confederation
    (default 'Outro') and the translated name (identity default)."""
    gpg = F.col("total_goals_for") / F.greatest(F.col("total_matches"), F.lit(1))
    return mart.select(
        "*",
        round2_even(gpg).alias("goals_per_game"),
        map_expr(confederation_map(), "nation", CONFEDERATION_DEFAULT).alias("confederation"),
        map_expr(NATION_PT, "nation", F.col("nation")).alias("nacao"),
    )


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """Set filter where an empty (or None) selection means 'all'."""
    return df.where(F.col(col).isin(list(values))) if values else df


def top_n(df: DataFrame, metric: str, n: int, tie: str = "nation") -> DataFrame:
    """N rows with the largest ``metric`` (NULLs last, ties by ``tie``).
    Planned as TakeOrderedAndProject: each task keeps its own top N, then one
    merge of at most N rows per task."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(n)


# ---------------------------------------------------------------------------
# Head-to-head and history (deep-dive page)
# ---------------------------------------------------------------------------

def head_to_head(matches: DataFrame, team: str | None = None) -> DataFrame:
    """Record of each side against each opponent: games, V/E/D, goals, win%.

    A NULL score counts as a defeat (result code rule); goal sums of only
    NULLs are 0. Win% = wins*3 / (games*3) * 100, one decimal, half even.
    Aggregated partially per task before the shuffle on (team, opponent), so
    a side holding a large share of all matches does not make a hot reducer.
    """
    s = both_sides(matches)
    if team is not None:
        s = s.where(F.col("team") == team)
    code = result_code()
    agg = s.groupBy("team", "opponent").agg(
        F.count(F.lit(1)).alias("games"),
        count_when(code == "V").alias("wins"),
        count_when(code == "E").alias("draws"),
        count_when(code == "D").alias("losses"),
        F.coalesce(F.sum("goals_for"), F.lit(0)).alias("goals_for"),
        F.coalesce(F.sum("goals_against"), F.lit(0)).alias("goals_against"),
    )
    pct = (F.col("wins") * 3).cast("double") / (F.col("games") * 3) * 100
    return agg.withColumn("win_pct", round_half_even(pct, 1))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows of every group by ``order``.

    ``row_number() <= k`` is planned with a window group limit: each map task
    keeps at most k rows per group before the shuffle, so even a group holding
    a third of all rows sends only k rows per task.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def history_kpis(history: DataFrame) -> DataFrame:
    """Per side over its per-edition history: editions, total wins / goals,
    mean wins and goals per edition (one decimal, half even)."""
    return history.groupBy("team").agg(
        F.count_distinct("edition_year").alias("editions"),
        F.coalesce(F.sum("wins"), F.lit(0)).alias("total_wins"),
        F.coalesce(F.sum("goals_scored"), F.lit(0)).alias("total_goals_for"),
        F.coalesce(F.sum("goals_conceded"), F.lit(0)).alias("total_goals_against"),
        round_half_even(F.avg("wins"), 1).alias("avg_wins"),
        round_half_even(F.avg("goals_scored"), 1).alias("avg_goals"),
    )


def with_points(history: DataFrame) -> DataFrame:
    """pts = 3 * wins + draws (NULL / absent draws count 0); goal difference."""
    draws = F.coalesce(F.col("draws"), F.lit(0)) if "draws" in history.columns else F.lit(0)
    out = history.withColumn("pts", F.col("wins") * 3 + draws)
    if "goals_scored" in history.columns and "goals_conceded" in history.columns:
        out = out.withColumn("goal_difference", F.col("goals_scored") - F.col("goals_conceded"))
    return out


def best_worst_edition(history: DataFrame, min_games: int = 3) -> DataFrame:
    """Per side: best and worst edition by points among editions with at least
    ``min_games`` games; the earliest edition wins ties. One aggregation:
    ``max_by`` / ``min_by`` over a (pts, year) ordering key."""
    h = with_points(history).where(F.col("games") >= min_games)
    rec = F.struct("edition_year", "pts", "wins", "goals_scored")
    best = F.max_by(rec, F.struct(F.col("pts"), -F.col("edition_year")))
    worst = F.min_by(rec, F.struct(F.col("pts"), F.col("edition_year")))
    return (h.groupBy("team").agg(best.alias("b"), worst.alias("w"))
             .select("team",
                     F.col("b.edition_year").alias("best_year"), F.col("b.pts").alias("best_pts"),
                     F.col("b.wins").alias("best_wins"), F.col("b.goals_scored").alias("best_goals"),
                     F.col("w.edition_year").alias("worst_year"), F.col("w.pts").alias("worst_pts"),
                     F.col("w.wins").alias("worst_wins"), F.col("w.goals_scored").alias("worst_goals")))


def title_years(cups: DataFrame, winner: str = "winner", year: str = "year") -> DataFrame:
    """Editions won per winner as a sorted array, keyed by lower(name).
    A set, so each array is bounded by the number of editions."""
    return (cups.groupBy(F.lower(F.col(winner)).alias("title_key"))
                .agg(F.array_sort(F.collect_set(F.col(year).cast("int"))).alias("title_years")))


def title_years_literal(spark, mapping: dict | None = None) -> DataFrame:
    """Title years from a literal map (nation -> years), in the same shape as
    ``title_years``: (title_key = lower(name), sorted years)."""
    from ..sources.dims import TITLE_YEARS
    m = TITLE_YEARS if mapping is None else mapping
    rows = [(k.lower(), sorted(int(y) for y in v)) for k, v in m.items()]
    return spark.createDataFrame(rows, "title_key string, title_years array<int>")


def with_title_flags(history: DataFrame, titles: DataFrame, team: str = "team") -> DataFrame:
    """Per-edition rows + is_title_year, n_titles, titles_str ('—' when none)."""
    j = history.join(titles, F.lower(F.col(team)) == F.col("title_key"), "left").drop("title_key")
    years = F.col("title_years")
    return j.select(
        *[F.col(c) for c in history.columns],
        F.coalesce(F.array_contains(years, F.col("edition_year")), F.lit(False)).alias("is_title_year"),
        F.coalesce(F.size(years), F.lit(0)).alias("n_titles"),
        F.coalesce(F.array_join(years, ", "), F.lit("—")).alias("titles_str"),
    )


# ---------------------------------------------------------------------------
# Player profile page
# ---------------------------------------------------------------------------

def with_position_label(players: DataFrame) -> DataFrame:
    """posicao = Portuguese label of position_group (identity default)."""
    return players.withColumn("posicao", map_expr(POSITION_PT, "position_group", F.col("position_group")))


def player_filter(players: DataFrame, nation: str | None = None, posicao: str | None = None,
                  all_value: str = "Todas") -> DataFrame:
    """Equality filters where ``all_value`` (or None) means no filter."""
    out = players
    if nation not in (None, all_value):
        out = out.where(F.col("nation") == nation)
    if posicao not in (None, all_value):
        out = out.where(F.col("posicao") == posicao)
    return out


def plot_frame(players: DataFrame) -> DataFrame:
    """Analysis-tab frame: rows with age and value known; goals, assists and
    matches with NULL as 0."""
    return (players.na.drop(subset=["age", "market_value_eur_m"])
                   .na.fill({"goals": 0.0, "assists": 0.0, "matches_played": 0}))


def squad_kpis(players: DataFrame, group: str = "nation", all_label: str | None = "Todas") -> DataFrame:
    """Per group, plus one row for all groups together (``all_label``; None
    = no such row): total value (0 when none), mean age, players, top scorer
    (most goals; ties by group, then value desc, then name — the mart's row
    order) with goals and a short name. The numbers are hash-aggregated, the scorer
    comes from a group limit before its shuffle, and the row for all groups is made
    from the groups' rows."""
    g, mv = F.col("goals"), F.col("market_value_eur_m")
    numbers = players.groupBy(group).agg(F.sum(mv).alias("value"), F.sum("age").alias("ages"), F.count("age").alias("n_ages"),
                                         F.count(F.lit(1)).alias("players"))
    first = top_per_group(players.select(group, "player_name", "goals", "market_value_eur_m"), group,
                          [g.desc_nulls_last(), mv.desc_nulls_last(), F.col("player_name").asc()], 1)
    top = F.struct(F.col("player_name").alias("n"), g.alias("g"))
    rows = numbers.join(first, group).select(group, "value", "ages", "n_ages", "players", top.alias("top"))
    if all_label is not None:
        key = F.struct(F.col("top.g").isNull().alias("gn"), (-F.col("top.g")).alias("g"), F.col(group).alias("k"))
        every = rows.agg(F.sum("value").alias("value"), F.sum("ages").alias("ages"), F.sum("n_ages").alias("n_ages"),
                         F.sum("players").alias("players"), F.min_by("top", key).alias("top")).where(F.col("players") > 0)
        rows = rows.unionByName(every.withColumn(group, F.lit(all_label)))
    has = F.col("top.g").isNotNull()
    name = F.when(has, F.col("top.n")).otherwise(F.lit("—"))
    return rows.select(
        group, F.coalesce("value", F.lit(0.0)).alias("total_value_eur_m"), F.try_divide(F.col("ages"), F.col("n_ages")).alias("avg_age"), "players",
        name.alias("top_scorer"),
        F.when(has, F.col("top.g").cast("int")).otherwise(F.lit(0)).alias("top_scorer_goals"),
        ellipsis(name, 10).alias("top_scorer_short"),
    )


def value_by_position(plot: DataFrame) -> DataFrame:
    """Mean / count / sum of market value per position label."""
    return (plot.where(F.col("posicao").isNotNull())
                .groupBy("posicao").agg(F.avg("market_value_eur_m").alias("mean_value_eur_m"),
                                        F.count("market_value_eur_m").alias("players"),
                                        F.sum("market_value_eur_m").alias("total_value_eur_m")))


def value_rollup(plot: DataFrame) -> DataFrame:
    """Value per (nation, position) leaf with nation subtotals and the grand
    total (rollup); ``level`` 0 = leaf, 1 = nation total, 3 = grand total."""
    return (plot.where(F.col("nation").isNotNull() & F.col("posicao").isNotNull())
                .rollup("nation", "posicao")
                .agg(F.grouping_id().cast("int").alias("level"),
                     F.sum("market_value_eur_m").alias("value_eur_m"),
                     F.count(F.lit(1)).alias("players")))


def age_histogram(plot: DataFrame, bins: int = 15) -> DataFrame:
    """Fixed-width age bins (at most ``bins``), counted per position label.

    Width = ceil((max - min + 1) / bins) from the global bounds, attached as a
    scalar subquery; the count is a plain partial + final aggregation.
    """
    ages = plot.where(F.col("age").isNotNull())
    bounds = ages.select(F.struct(F.min("age").alias("lo"), F.max("age").alias("hi"))).scalar()
    b = ages.withColumn("__b", bounds)
    lo, hi = F.col("__b.lo"), F.col("__b.hi")
    width = F.ceil((hi - lo + 1) / F.lit(bins))
    idx = F.floor((F.col("age") - lo) / width)
    return (b.select((lo + idx * width).cast("int").alias("bin_start"),
                     (lo + (idx + 1) * width - 1).cast("int").alias("bin_end"),
                     F.col("posicao"))
             .groupBy("bin_start", "bin_end", "posicao").agg(F.count(F.lit(1)).alias("players")))


# Radar -----------------------------------------------------------------------

RADAR_METRICS = ["g90", "a90", "matches_played", "market_value_eur_m", "age"]


def radar_reference(players: DataFrame) -> DataFrame:
    """Reference set of the radar: NULL goals / assists / value / matches -> 0,
    NULL minutes -> 1, minutes clipped below at 0.1, per-90 rates."""
    m90 = clip_lower(F.coalesce(F.col("minutes_90s"), F.lit(1.0)), 0.1)
    return (players.withColumn("minutes_90s", m90)
                   .na.fill({"goals": 0.0, "assists": 0.0, "market_value_eur_m": 0.0,
                             "matches_played": 0})
                   .withColumn("g90", F.col("goals") / F.col("minutes_90s"))
                   .withColumn("a90", F.col("assists") / F.col("minutes_90s")))


def metric_bounds(ref: DataFrame, metrics=RADAR_METRICS) -> DataFrame:
    """One row: min and max of each metric (NULLs ignored)."""
    aggs = []
    for m in metrics:
        aggs += [F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return ref.agg(*aggs)


def minmax_score(v: Column, lo: Column, hi: Column, higher_is_better: bool = True) -> Column:
    """0-100 position of v between lo and hi, floored at 3; a constant metric
    (lo == hi) scores 50; an unknown value scores 3."""
    norm = (v - lo) / (hi - lo) * 100
    if not higher_is_better:
        norm = 100 - norm
    return (F.when(hi == lo, F.lit(50.0))
             .when(norm.isNull(), F.lit(3.0))
             .otherwise(F.greatest(F.lit(3.0), norm)))


def bounds_struct(ref: DataFrame, metrics=RADAR_METRICS) -> Column:
    """Global min / max of each metric as one struct-valued scalar subquery
    (one aggregate row, computed once and inlined as a constant): no cross
    join, and no global window that would pull every row into one task."""
    b = metric_bounds(ref, metrics)
    return b.select(F.struct(*[F.col(c) for c in b.columns])).scalar()


def with_bounds(df: DataFrame, ref: DataFrame, metrics=RADAR_METRICS, col: str = "__b") -> DataFrame:
    """``df`` plus one column holding the bounds struct of ``ref``; later
    expressions read its fields, so the plan holds a single subquery."""
    return df.withColumn(col, bounds_struct(ref, metrics))


def _scores(b: str, cols: dict[str, Column], prefix: str) -> list[Column]:
    def f(m):
        return F.col(f"{b}.{m}")
    out = []
    for name, metric, v, higher in (("g90", "g90", cols["g90"], True), ("a90", "a90", cols["a90"], True),
                                    ("matches", "matches_played", cols["matches"], True),
                                    ("value", "market_value_eur_m", cols["value"], True),
                                    ("youth", "age", cols["age"], False)):
        out.append(minmax_score(v, f(f"{metric}_min"), f(f"{metric}_max"), higher).alias(f"{prefix}{name}"))
    return out


def radar_scores(players: DataFrame) -> DataFrame:
    """Per player: five 0-100 scores (goals/90, assists/90, matches, value,
    youth) against the bounds of the whole reference set. Unknown age scores 3
    (an age of 0 is read as 25)."""
    base = radar_reference(players)
    ref = with_bounds(base, base)
    age = F.when(F.col("age") == 0, F.lit(25)).otherwise(F.col("age"))
    cols = {"g90": F.col("g90"), "a90": F.col("a90"), "matches": F.col("matches_played"),
            "value": F.col("market_value_eur_m"), "age": age}
    return ref.select("nation", "player_name", "position_group", *_scores("__b", cols, "score_"))


def radar_group_avg(players: DataFrame, min_rows: int = 2) -> DataFrame:
    """Per position group with at least ``min_rows`` players: the mean of each
    radar metric scored against the whole reference set (mean of ratios).
    Groups are hash-aggregated first; the bounds are attached to the few
    group rows afterwards."""
    ref = radar_reference(players)
    g = (ref.groupBy("position_group")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("g90").alias("avg_g90"),
                 F.avg("a90").alias("avg_a90"), F.avg("matches_played").alias("avg_matches"),
                 F.avg("market_value_eur_m").alias("avg_value"), F.avg("age").alias("avg_age"))
            .where(F.col("n") >= min_rows))
    g = with_bounds(g, ref)
    cols = {"g90": F.col("avg_g90"), "a90": F.col("avg_a90"), "matches": F.col("avg_matches"),
            "value": F.col("avg_value"), "age": F.col("avg_age")}
    return g.select("position_group", "n", *_scores("__b", cols, "avg_score_"))


def radar_with_group(players: DataFrame) -> DataFrame:
    """Player scores next to the scores of their group average. The group
    table has one row per position group; AQE broadcasts it when it is small."""
    return radar_scores(players).join(radar_group_avg(players), "position_group", "left")


# Search, sort, picks --------------------------------------------------------

SORT_CHOICES = {"valor": ("market_value_eur_m", False), "gols": ("goals", False),
                "assist": ("assists", False), "idade": ("age", True)}


def search_players(players: DataFrame, query: str, col: str = "player_name") -> DataFrame:
    """Case-insensitive regular-expression search; NULL names never match."""
    q = query.strip()
    if not q:
        return players
    return players.where(F.coalesce(F.col(col).rlike("(?iu)" + q), F.lit(False)))


def sort_players(players: DataFrame, choice: str = "valor") -> DataFrame:
    field, asc = SORT_CHOICES.get(choice, SORT_CHOICES["valor"])
    c = F.col(field)
    return players.orderBy(c.asc_nulls_last() if asc else c.desc_nulls_last(),
                           F.col("player_name").asc_nulls_last(), F.col("nation").asc_nulls_last())


def preference_rank(c: Column, preferred: list[str], missing: int = 1_000_000) -> Column:
    """1-based position of c in ``preferred``; ``missing`` when absent."""
    pos = F.array_position(F.array(*[F.lit(x) for x in preferred]), c)
    return F.when(pos > 0, pos).otherwise(F.lit(missing)).cast("int")


def default_pick(players: DataFrame, preferred=STAR_PLAYERS, group: str = "nation") -> DataFrame:
    """Per group: the first preferred name present, else the first name in
    alphabetical order (a group limit before the shuffle), and how many there are."""
    p = players.where(F.col("player_name").isNotNull()).select(group, "player_name")
    rank = preference_rank(F.col("player_name"), preferred)
    first = top_per_group(p, group, [rank.asc(), F.col("player_name").asc()], 1)
    counts = p.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"))
    return counts.join(first.select(group, F.col("player_name").alias("default_player")), group)


def category_order(df: DataFrame, col: str = "posicao", order=POSITION_ORDER_PT,
                   unknown: int = 99) -> DataFrame:
    """Distinct non-null values with their display order (unknown -> 99)."""
    pos = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col))
    return (df.select(col).where(F.col(col).isNotNull()).distinct()
              .withColumn("sort_key", F.when(pos > 0, pos).otherwise(F.lit(unknown)).cast("int")))
