"""Presentation columns and result orderings of the printed report.

Reports return unordered DataFrames (a global sort of a large result is a
shuffle nobody needs when the output goes to a table). For display, ``ordered``
sorts a report the way the surveyed report prints it, league first, with a
deterministic tie-break, and ``with_position`` adds the printed 1-based
position within each league.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAGUE = "league_id"

# Fixed order of the bracket report's positions.
BRACKET_ORDER = ["QB", "RB", "WR", "TE", "K", "DEF"]


# report -> sort keys after league_id (the surveyed ORDER BY plus a tie-break);
# "-" marks descending.
ORDERS: dict[str, list[str]] = {
    "most_high_weeks_list": ["-count_of_highest_scores", "team_name"],
    "top_scores_all": ["rank"],
    "most_low_weeks_list": ["-count_of_lowest_scores", "team_name"],
    "low_scores_all": ["rank"],
    "own_low_wins": ["-wins_with_lowest_score", "team_name"],
    "own_high_losses": ["-losses_with_highest_score", "team_name"],
    "win_points_profile": ["-avg_points_in_win", "team_name"],
    "loss_points_profile": ["-avg_points_in_loss", "team_name"],
    "standings": ["-wins", "-avg_pts", "team_name"],
    "top_scores": ["rank"],
    "low_scores": ["rank"],
    "consistency": ["std_dev", "team_name"],
    "high_week_counts": ["-times_highest", "team_name"],
    "low_week_counts": ["-times_lowest", "team_name"],
    "wins_vs_low_opp": ["-wins_vs_low_opp", "team_name"],
    "losses_vs_high_opp": ["-losses_vs_high_opp", "team_name"],
    "avg_points_in_wins": ["-avg_pts_in_win", "team_name"],
    "avg_points_in_losses": ["-avg_pts_in_loss", "team_name"],
    "avg_margin": ["-avg_margin", "team_name"],
    "dominant_wins": ["-margin", "week", "team_name"],
    "closest_matchups": ["margin", "week", "team_name"],
    "volatility": ["-biggest_swing", "team_name"],
    "head_to_head": ["team_name", "-wins", "opponent"],
    "luck": ["-luck", "team_name"],
    "late_round_steals": ["-total_points", "pick_no"],
    "skill_steals": ["-total_points", "pick_no"],
    "worst_value_picks": ["-miss", "pick_no"],
    "biggest_busts": ["total_points", "pick_no"],
    "positional_performance": ["position"],
    "bracket_averages": ["@bracket"],
}


def _key(spec: str) -> Column:
    if spec == "@bracket":
        return F.array_position(F.array(*[F.lit(p) for p in BRACKET_ORDER]),
                                F.col("position")).asc()
    if spec.startswith("-"):
        return F.col(spec[1:]).desc_nulls_last()
    return F.col(spec).asc_nulls_last()


def sort_keys(name: str) -> list[Column]:
    """The printed order of a report, inside a league."""
    return [_key(k) for k in ORDERS[name]]


def ordered(df: DataFrame, name: str) -> DataFrame:
    """The report sorted for printing (league first)."""
    return df.orderBy(F.col(LEAGUE).asc(), *sort_keys(name))


def with_position(df: DataFrame, name: str, col: str = "pos_no") -> DataFrame:
    """Adds the printed 1-based position of each row within its league."""
    w = Window.partitionBy(LEAGUE).orderBy(*sort_keys(name))
    return df.withColumn(col, F.row_number().over(w))


def record_text(wins: Column, losses: Column) -> Column:
    """``"7-3"``: wins and losses as printed."""
    return F.concat_ws("-", wins.cast("string"), losses.cast("string"))


def margin_sign(margin: Column) -> Column:
    """``"+"`` for a positive margin, otherwise empty."""
    return F.when(margin > 0, F.lit("+")).otherwise(F.lit(""))
