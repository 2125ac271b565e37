"""Leaderboards and per-team profiles over the scoreboard.

Every function takes the scoreboard (``scoreboard.matchups``) and returns a
DataFrame keyed by ``league_id``. ``weeks``/``played_only`` select the
completed-week filter: the weekly report uses ``(1, 14), True``; the season
script variants use ``None, False`` (all rows, unplayed zero weeks included).
Top-n reports rank within each league unless ``per_league=False``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.exact import average
from huddle.functions.numeric import round_ref
from huddle.operators.common import LEAGUE, place, result_letter, summarise, top_n, week_list
from huddle.operators.scoreboard import played


TEAM = [LEAGUE, "team_name"]


def _week_leaders(m: DataFrame, highest: bool) -> DataFrame:
    """Rows that rank first in their (league, week), ties to the lower roster id."""
    pts = F.col("points").desc_nulls_last() if highest else F.col("points").asc_nulls_last()
    w = Window.partitionBy(*place(m, "week")).orderBy(pts, F.col("roster_id").asc_nulls_last())
    return m.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)


# --- season script stats (all rows) ---------------------------------------

def most_high_weeks_list(m: DataFrame, weeks=None, played_only=False) -> DataFrame:
    """Teams by number of weeks with the league's highest score, with the weeks."""
    lead = _week_leaders(played(m, weeks, played_only), highest=True)
    return lead.groupBy(LEAGUE, "team_name").agg(
        F.count(F.lit(1)).alias("count_of_highest_scores"), week_list().alias("weeks"))


def most_low_weeks_list(m: DataFrame, weeks=None, played_only=False) -> DataFrame:
    """Teams by number of weeks with the league's lowest score, with the weeks."""
    lead = _week_leaders(played(m, weeks, played_only), highest=False)
    return lead.groupBy(LEAGUE, "team_name").agg(
        F.count(F.lit(1)).alias("count_of_lowest_scores"), week_list().alias("weeks"))


def top_scores_all(m: DataFrame, n: int = 10, per_league: bool = True, weeks=None,
                   played_only=False) -> DataFrame:
    """The ``n`` highest single-week scores with their rank."""
    order = [F.col("points").desc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc()]
    t = top_n(played(m, weeks, played_only), order, n, per_league, rank_col="rank")
    return t.select(LEAGUE, "team_name", "week", "points", "rank")


def low_scores_all(m: DataFrame, n: int = 10, per_league: bool = True, weeks=None,
                   played_only=False) -> DataFrame:
    """The ``n`` lowest single-week scores with their rank."""
    order = [F.col("points").asc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc()]
    t = top_n(played(m, weeks, played_only), order, n, per_league, rank_col="rank")
    return t.select(LEAGUE, "team_name", "week", "points", "rank")


def _own_extreme_result(m: DataFrame, lowest: bool, won: int, count_name: str) -> DataFrame:
    w = Window.partitionBy(*place(m, "week"))
    ext = F.min("points").over(w) if lowest else F.max("points").over(w)
    rows = m.withColumn("_ext", ext).filter(
        (F.col("points") == F.col("_ext")) & (F.col("won") == won))
    s = summarise(rows, TEAM, "points", {count_name: ("count", F.lit(1)), "weeks": ("texts", F.col("week"))})
    return s.select(*TEAM, count_name, average().alias("avg_points"), "weeks")


def own_low_wins(m: DataFrame) -> DataFrame:
    """Wins in weeks where the team's own score was the league's lowest."""
    return _own_extreme_result(m, lowest=True, won=1, count_name="wins_with_lowest_score")


def own_high_losses(m: DataFrame) -> DataFrame:
    """Losses in weeks where the team's own score was the league's highest."""
    return _own_extreme_result(m, lowest=False, won=0, count_name="losses_with_highest_score")


def _points_profile(rows: DataFrame, games: str, kind: str) -> DataFrame:
    s = summarise(rows, TEAM, "points", {games: ("count", F.lit(1)), f"min_{kind}": ("min", F.col("points")),
                                         f"max_{kind}": ("max", F.col("points"))})
    return s.select(*TEAM, games, average().alias(f"avg_points_in_{kind}"), f"min_{kind}", f"max_{kind}")


def win_points_profile(m: DataFrame) -> DataFrame:
    """Wins with average, lowest and highest points scored in them."""
    return _points_profile(m.filter(F.col("won") == 1), "wins", "win")


def loss_points_profile(m: DataFrame) -> DataFrame:
    """Losses (ties included) with average, lowest and highest points in them."""
    return _points_profile(m.filter(F.col("won") == 0), "losses", "loss")


# --- weekly report (completed weeks) ---------------------------------------

def standings(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Wins, losses (ties count as losses) and average points."""
    s = summarise(played(m, weeks, played_only), TEAM, "points",
                  {"wins": ("sum", F.col("won").cast("bigint")), "games": ("count", F.lit(1))})
    return s.select(*TEAM, "wins", (F.col("games") - F.col("wins")).alias("losses"), round_ref(average()).alias("avg_pts"))


def top_scores(m: DataFrame, n: int = 10, per_league: bool = True, weeks=(1, 14),
               played_only=True) -> DataFrame:
    """The ``n`` highest completed-week scores: rank, team, week, points, W/L."""
    order = [F.col("points").desc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc()]
    t = top_n(played(m, weeks, played_only), order, n, per_league, rank_col="rank")
    return t.select(LEAGUE, "rank", "team_name", "week", round_ref("points").alias("points"),
                    result_letter(F.col("won")).alias("result"))


def low_scores(m: DataFrame, n: int = 10, per_league: bool = True, weeks=(1, 14),
               played_only=True) -> DataFrame:
    """The ``n`` lowest completed-week scores: rank, team, week, points, W/L."""
    order = [F.col("points").asc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc()]
    t = top_n(played(m, weeks, played_only), order, n, per_league, rank_col="rank")
    return t.select(LEAGUE, "rank", "team_name", "week", round_ref("points").alias("points"),
                    result_letter(F.col("won")).alias("result"))


def consistency(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Average and population standard deviation of weekly points."""
    s = summarise(played(m, weeks, played_only), TEAM, "points", spread=True)
    return s.select(*TEAM, round_ref(average()).alias("avg_pts"), round_ref("std").alias("std_dev"))


def high_week_counts(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """How often each team had the league's highest completed-week score."""
    lead = _week_leaders(played(m, weeks, played_only), highest=True)
    return lead.groupBy(LEAGUE, "team_name").agg(F.count(F.lit(1)).alias("times_highest"))


def low_week_counts(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """How often each team had the league's lowest completed-week score."""
    lead = _week_leaders(played(m, weeks, played_only), highest=False)
    return lead.groupBy(LEAGUE, "team_name").agg(F.count(F.lit(1)).alias("times_lowest"))


def avg_points_in_wins(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Average points in completed-week wins."""
    s = summarise(played(m, weeks, played_only).filter(F.col("won") == 1), TEAM, "points")
    return s.select(*TEAM, round_ref(average()).alias("avg_pts_in_win"))


def avg_points_in_losses(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Average points in completed-week losses (ties included)."""
    s = summarise(played(m, weeks, played_only).filter(F.col("won") == 0), TEAM, "points")
    return s.select(*TEAM, round_ref(average()).alias("avg_pts_in_loss"))
