"""Reports that compare a team with its opponent.

All read ``scoreboard.contests``: the team's own row passes the
completed-week filter, the opponent row is taken as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.exact import average
from huddle.functions.numeric import round_ref
from huddle.operators.common import LEAGUE, place, summarise, top_n
from huddle.operators.scoreboard import contests


def _vs_opponent_extreme(m: DataFrame, lowest: bool, won: int, count_name: str,
                         weeks, played_only) -> DataFrame:
    c = contests(m, weeks, played_only)
    w = Window.partitionBy(*place(c, "week"))
    ext = F.min("opp_points").over(w) if lowest else F.max("opp_points").over(w)
    rows = c.withColumn("_ext", ext).filter(
        (F.col("opp_points") == F.col("_ext")) & (F.col("won") == won))
    s = summarise(rows, [LEAGUE, "team_name"], "opp_points", {count_name: ("count", F.lit(1))})
    return s.select(LEAGUE, "team_name", count_name, round_ref(average()).alias("avg_opp_score"))


def wins_vs_low_opp(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Wins against the week's lowest opponent score (lowest among the
    opponents of the filtered rows)."""
    return _vs_opponent_extreme(m, True, 1, "wins_vs_low_opp", weeks, played_only)


def losses_vs_high_opp(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Losses against the week's highest opponent score."""
    return _vs_opponent_extreme(m, False, 0, "losses_vs_high_opp", weeks, played_only)


def avg_margin(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Average of own points minus opponent points (no opponent -> 0)."""
    c = contests(m, weeks, played_only, how="left")
    s = summarise(c, [LEAGUE, "team_name"], F.col("points") - F.coalesce(F.col("opp_points"), F.lit(0.0)))
    return s.select(LEAGUE, "team_name", round_ref(average()).alias("avg_margin"))


def dominant_wins(m: DataFrame, n: int = 10, per_league: bool = True, weeks=(1, 14),
                  played_only=True) -> DataFrame:
    """Largest winning margins."""
    c = contests(m, weeks, played_only).filter(F.col("won") == 1).select(
        *place(m), "team_name", "week", "roster_id", "opp_roster_id",
        round_ref(F.col("points") - F.col("opp_points")).alias("margin"),
        round_ref("points").alias("pts_for"), round_ref("opp_points").alias("pts_against"))
    order = [F.col("margin").desc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc(),
             F.col("opp_roster_id").asc()]
    return top_n(c, order, n, per_league).select(
        LEAGUE, "team_name", "week", "margin", "pts_for", "pts_against")


def closest_matchups(m: DataFrame, n: int = 10, per_league: bool = True, weeks=(1, 14),
                     played_only=True) -> DataFrame:
    """Smallest margins; each game appears once per side, a tie reads ``L``."""
    c = contests(m, weeks, played_only).select(
        *place(m), "team_name", "opponent", "week", "roster_id", "opp_roster_id",
        round_ref(F.abs(F.col("points") - F.col("opp_points"))).alias("margin"),
        F.when(F.col("points") > F.col("opp_points"), F.lit("W")).otherwise(F.lit("L"))
         .alias("result"))
    order = [F.col("margin").asc_nulls_last(), F.col("week").asc(), F.col("roster_id").asc(),
             F.col("opp_roster_id").asc()]
    return top_n(c, order, n, per_league).select(
        LEAGUE, "team_name", "opponent", "week", "margin", "result")


def volatility(m: DataFrame, weeks=(1, 14)) -> DataFrame:
    """Week-to-week swings of a team name's score between adjacent weeks where
    both weeks were played; swings are rounded before averaging.

    Pairs a row with every played row of the same team name exactly one week
    later (the ``RANGE 1 FOLLOWING .. 1 FOLLOWING`` frame), which is the
    equi-join ``t1.week + 1 = t2.week`` including its fan-out on repeated
    names, in one pass over the input.
    """
    lo, hi = weeks
    nxt = Window.partitionBy(LEAGUE, "team_name").orderBy("week").rangeBetween(1, 1)
    next_points = F.collect_list(F.when(F.col("points") > 0, F.col("points"))).over(nxt)
    # An equi-join never matches a NULL name; the window must not pair them either.
    rows = (m.filter(F.col("team_name").isNotNull())
            .select(LEAGUE, "team_name", "week", "points")
            .withColumn("_next", next_points)
            .filter((F.col("week") >= lo) & (F.col("week") < hi) & (F.col("points") > 0)))
    pairs = rows.select(LEAGUE, "team_name", "points", F.explode("_next").alias("_p2"))
    swing = pairs.select(LEAGUE, "team_name",
                         round_ref(F.abs(F.col("points") - F.col("_p2"))).alias("swing"))
    s = summarise(swing, [LEAGUE, "team_name"], "swing", {"biggest_swing": ("max", F.col("swing"))})
    return s.select(LEAGUE, "team_name", round_ref(average()).alias("avg_swing"), "biggest_swing")


def head_to_head(m: DataFrame, weeks=(1, 14), played_only=True) -> DataFrame:
    """Record of each team against each opponent name."""
    c = contests(m, weeks, played_only)
    wins = F.sum(F.when(F.col("points") > F.col("opp_points"), 1).otherwise(0)).cast("bigint")
    games = F.count(F.lit(1))
    return c.groupBy(LEAGUE, "team_name", "opponent").agg(
        wins.alias("wins"), games.alias("games"), (games - wins).alias("losses"))
