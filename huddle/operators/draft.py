"""Draft value reports.

Inputs (canonical frames, see ``sources.schemas``): ``picks`` with its list
order ``ord``, the player catalog ``players(player_id, attrs)``, player-week
scores ``player_points(league_id, player_id, points)``, and the draft rosters
and users for the drafting team's name.

Which tests apply to a pick differs per report and follows the surveyed
code: ``pick_no`` and ``player_id`` count as absent when NULL, 0 or empty.
Sorted reports keep list order among equal values (a stable sort), so
``ord`` is the last sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.functions.exact import average, summarise, with_average
from huddle.functions.names import drafting_team_name, player_name, player_position
from huddle.operators.common import LEAGUE, top_n
from huddle.operators.scoreboard import roster_names

TEAMS_PER_ROUND = 10                  # round = (pick_no - 1) div 10 + 1
EARLY_MAX, MID_MAX = 50, 100          # brackets: <= 50 early, 51..100 mid, > 100 late
# Fixed values of the surveyed report.
BRACKET_POSITIONS = ["QB", "RB", "WR", "TE", "K", "DEF"]
NON_SKILL_POSITIONS = ["QB", "DEF", "K"]

PICK_REPORT_COLUMNS = [LEAGUE, "pick_no", "round", "player_name", "pos", "total_points",
                       "team_name"]


def player_totals(player_points: DataFrame) -> DataFrame:
    """Season total (``total_points``) per (league, player) over positive player-week
    scores, summed exactly. Map-side partial sums run before the shuffle."""
    s = summarise(player_points.filter(F.col("points") > 0), [LEAGUE, "player_id"], "points")
    return s.select(LEAGUE, "player_id", F.col("total").alias("total_points"))


def player_points_from_weekly(weekly: DataFrame) -> DataFrame:
    """Player-week scores of every roster's score map (all weeks)."""
    return weekly.select(LEAGUE, F.explode("players_points").alias("player_id", "points"))


def _pick_no_set(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def _player_id_set(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def enrich_picks(picks: DataFrame, players: DataFrame, totals: DataFrame,
                 draft_rosters: DataFrame, users: DataFrame) -> DataFrame:
    """Picks with catalog entry, season total, round and drafting team: the
    input of every draft report (``*_from`` functions). Built once, it can be
    written bucketed by league so all six reports run without a shuffle."""
    # only what the reports show is joined, not the whole attribute map
    cat = players.select("player_id", player_name(F.col("attrs"), F.col("player_id")).alias("_name"),
                         player_position(F.col("attrs")).alias("_pos"),
                         F.try_element_at(F.col("attrs"), F.lit("position")).alias("position"),
                         F.lit(True).alias("in_catalog"))
    p = (picks
         .join(cat, "player_id", "left")
         .join(totals, [LEAGUE, "player_id"], "left")
         .join(roster_names(draft_rosters, users).withColumn("roster_found", F.lit(True)), [LEAGUE, "roster_id"], "left"))
    listed = F.coalesce(F.col("in_catalog"), F.lit(False))
    unlisted = F.lit(None).cast("map<string,string>")
    return p.select(
        LEAGUE, "ord", "pick_no", "player_id", "roster_id",
        listed.alias("in_catalog"),
        F.when(listed, F.col("_name")).otherwise(player_name(unlisted, F.col("player_id"))).alias("player_name"),
        F.when(listed, F.col("_pos")).otherwise(player_position(unlisted)).alias("pos"),
        "position",
        F.coalesce(F.col("total_points"), F.lit(0.0)).alias("total_points"),
        F.expr(f"(pick_no - 1) div {TEAMS_PER_ROUND} + 1").cast("int").alias("round"),
        drafting_team_name(F.col("roster_id"), F.col("roster_found"), F.col("user_found"),
                           F.col("metadata")).alias("team_name"),
    )


def steals_from(e: DataFrame, n: int = 10, per_league: bool = True,
                skill_only: bool = False) -> DataFrame:
    """Most productive picks after pick 100 (``skill_only``: catalog players
    outside QB, DEF and K)."""
    rows = e.filter(_pick_no_set(F.col("pick_no")) & (F.col("pick_no") > MID_MAX))
    if skill_only:
        rows = rows.filter(F.col("in_catalog") & ~F.coalesce(
            F.col("pos").isin(NON_SKILL_POSITIONS), F.lit(False)))
    rows = rows.filter(F.col("total_points") > 0)
    order = [F.col("total_points").desc(), F.col("ord").asc()]
    return top_n(rows, order, n, per_league).select(*PICK_REPORT_COLUMNS)


def late_round_steals(picks: DataFrame, players: DataFrame, totals: DataFrame,
                      draft_rosters: DataFrame, users: DataFrame, n: int = 10,
                      per_league: bool = True) -> DataFrame:
    """Most productive picks after pick 100; players missing from the catalog
    show as ``Player <id>`` / ``UNK``."""
    return steals_from(enrich_picks(picks, players, totals, draft_rosters, users), n, per_league,
                       False)


def skill_steals(picks: DataFrame, players: DataFrame, totals: DataFrame,
                 draft_rosters: DataFrame, users: DataFrame, n: int = 10,
                 per_league: bool = True) -> DataFrame:
    """As ``late_round_steals`` for catalog players outside QB, DEF and K."""
    return steals_from(enrich_picks(picks, players, totals, draft_rosters, users), n, per_league,
                       True)


def bracket_averages_from(e: DataFrame) -> DataFrame:
    """Per position of the fixed list: average season total and count of
    early (<= 50), mid (51-100) and late (> 100) picks; an empty bracket gives
    0 and 0. Positions without catalog picks are left out."""
    p = e.filter(_player_id_set(F.col("player_id")) & F.col("in_catalog")
                 & F.col("position").isin(BRACKET_POSITIONS))
    has = _pick_no_set(F.col("pick_no"))
    bracket = F.when(has & (F.col("pick_no") <= EARLY_MAX), "early").when(
        has & (F.col("pick_no") <= MID_MAX), "mid").when(has, "late")
    s = summarise(p.withColumn("bracket", bracket), [LEAGUE, "position", "bracket"], "total_points")
    aggs = []
    for name in ("early", "mid", "late"):
        here = F.col("bracket") == name
        aggs.append(F.coalesce(F.max(F.when(here, average())), F.lit(0.0)).alias(f"{name}_avg"))
        aggs.append(F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0).cast("bigint")).alias(f"{name}_n"))
    return s.groupBy(LEAGUE, "position").agg(*aggs)


def positional_performance_from(e: DataFrame) -> DataFrame:
    """Per catalog position: number of drafted players and their average total."""
    p = e.filter(_player_id_set(F.col("player_id")) & F.col("in_catalog"))
    s = summarise(p.withColumn("position", F.col("pos")), [LEAGUE, "position"], "total_points")
    return s.select(LEAGUE, "position", F.col("n").alias("count"), average().alias("avg_pts"))


def bracket_averages(picks: DataFrame, players: DataFrame, totals: DataFrame) -> DataFrame:
    """``bracket_averages_from`` on picks joined to the catalog and totals."""
    cat = players.select("player_id", F.try_element_at("attrs", F.lit("position")).alias(
        "position"))
    p = (picks.filter(_player_id_set(F.col("player_id")))
         .join(cat, "player_id", "inner")
         .filter(F.col("position").isin(BRACKET_POSITIONS))
         .join(totals, [LEAGUE, "player_id"], "left")
         .select(LEAGUE, "player_id", "pick_no", "position", F.lit(True).alias("in_catalog"),
                 F.coalesce(F.col("total_points"), F.lit(0.0)).alias("total_points")))
    return bracket_averages_from(p)


def positional_performance(picks: DataFrame, players: DataFrame,
                           totals: DataFrame) -> DataFrame:
    """``positional_performance_from`` on picks joined to the catalog and totals."""
    cat = players.select("player_id", player_position(F.col("attrs")).alias("pos"))
    p = (picks.filter(_player_id_set(F.col("player_id")))
         .join(cat, "player_id", "inner")
         .join(totals, [LEAGUE, "player_id"], "left")
         .select(LEAGUE, "player_id", "pos", F.lit(True).alias("in_catalog"),
                 F.coalesce(F.col("total_points"), F.lit(0.0)).alias("total_points")))
    return positional_performance_from(p)


def worst_value_picks(picks: DataFrame, players: DataFrame, totals: DataFrame,
                      draft_rosters: DataFrame, users: DataFrame, n: int = 10,
                      per_league: bool = True, min_miss: float = 10.0) -> DataFrame:
    """Top-100 picks whose total fell furthest below the average of their
    (position, early/mid) group; the group average includes the pick itself."""
    return worst_value_picks_from(enrich_picks(picks, players, totals, draft_rosters, users),
                                  n, per_league, min_miss)


def worst_value_picks_from(e: DataFrame, n: int = 10, per_league: bool = True,
                           min_miss: float = 10.0) -> DataFrame:
    e = e.filter(
        _player_id_set(F.col("player_id")) & F.col("in_catalog")
        & _pick_no_set(F.col("pick_no")) & (F.col("pick_no") <= MID_MAX))
    e = e.withColumn("bracket", F.when(F.col("pick_no") <= EARLY_MAX, F.lit("early"))
                     .otherwise(F.lit("mid")))
    rows = (with_average(e, [LEAGUE, "pos", "bracket"], "total_points", "expected")
            .withColumnRenamed("total_points", "actual")
            .withColumn("miss", F.col("expected") - F.col("actual"))
            .filter(F.col("miss") > min_miss))
    order = [F.col("miss").desc(), F.col("ord").asc()]
    return top_n(rows, order, n, per_league).select(
        LEAGUE, "pick_no", "round", "player_name", "pos", "actual", "expected", "miss",
        "team_name")


def biggest_busts(picks: DataFrame, players: DataFrame, totals: DataFrame,
                  draft_rosters: DataFrame, users: DataFrame, n: int = 10,
                  per_league: bool = True) -> DataFrame:
    """Top-100 catalog picks with the lowest season totals (zeros included)."""
    return biggest_busts_from(enrich_picks(picks, players, totals, draft_rosters, users),
                              n, per_league)


def biggest_busts_from(e: DataFrame, n: int = 10, per_league: bool = True) -> DataFrame:
    e = e.filter(
        _pick_no_set(F.col("pick_no")) & (F.col("pick_no") <= MID_MAX)
        & _player_id_set(F.col("player_id")) & F.col("in_catalog"))
    order = [F.col("total_points").asc(), F.col("ord").asc()]
    return top_n(e, order, n, per_league).select(*PICK_REPORT_COLUMNS)
