"""The scoreboard: one row per team-week with its team name, top player and
win flag, plus the opponent pairing every head-to-head report reads.

Two win rules exist:

* ``beats`` (default): a team wins when its points exceed its opponent's; a
  missing opponent counts as 0, a tie is a loss for both, and rows with a
  NULL matchup id never find an opponent.
* ``rank``: the highest score of each (league, week, matchup_id) group wins;
  all NULL-matchup rows of a week form one group; ties go to the lower
  roster id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.jsontext import dumps_entries
from huddle.functions.names import matchup_team_name
from huddle.operators.common import LEAGUE, SLICE, place, slices

MATCHUP_COLUMNS = [LEAGUE, "week", "roster_id", "team_name", "matchup_id", "points",
                   "top_player_id", "top_player_score", "players_json"]


LARGE_LEAGUE = 10_000      # rosters; a larger league is spread by week


def roster_names(rosters: DataFrame, users: DataFrame) -> DataFrame:
    """(league_id, roster_id, metadata, user_found): each roster with its owner's metadata.

    Joins on (league, user) and then, by the caller, on (league, roster): work is in
    proportion to rosters and users, however many a league has. Spark broadcasts the
    result where it is small; else it is moved to rows that are partitioned by league
    already (see ``session.tuned``).
    """
    r = rosters.filter(F.col("roster_id").isNotNull()).select(
        LEAGUE, F.col("roster_id").cast("int").alias("roster_id"), F.col("owner_id").cast("string").alias("owner_id"))
    u = users.filter(F.col("user_id").isNotNull()).select(
        LEAGUE, F.col("user_id").cast("string").alias("owner_id"), F.col("metadata").cast("map<string,string>").alias("metadata"),
        F.lit(True).alias("user_found"))
    return r.join(u, [LEAGUE, "owner_id"], "left").select(
        LEAGUE, "roster_id", "metadata", F.coalesce("user_found", F.lit(False)).alias("user_found"))


def large_leagues(rosters: DataFrame, limit: int = LARGE_LEAGUE) -> DataFrame:
    """(league_id) of the leagues with more rosters than ``limit``: few by definition."""
    return rosters.groupBy(LEAGUE).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select(LEAGUE)


def sliced(weekly: DataFrame, large: DataFrame) -> DataFrame:
    """Spreads the rows by (league, slice): the slice is the week in the leagues of ``large``, else 0.

    Everything keyed by league and week then works on the slices of a large league in
    many tasks; reports per team add up inside the slices first and move only those sums.
    """
    marked = weekly.join(large.select(LEAGUE, F.lit(True).alias("_large")), LEAGUE, "left")
    marked = marked.withColumn(SLICE, F.when(F.col("_large"), F.col("week")).otherwise(0).cast("int")).drop("_large")
    return marked.repartition(LEAGUE, SLICE)


def player_scores(players: Column, players_points: Column) -> Column:
    """Positive scores of the listed players, in list order, as
    ``array<struct<id, score>>``. A listed player without a score counts 0;
    scores of players not listed are ignored."""
    ids = F.array_distinct(F.coalesce(players, F.array().cast("array<string>")))
    scored = F.transform(ids, lambda p: F.struct(
        p.alias("id"),
        F.coalesce(F.try_element_at(players_points, p), F.lit(0.0)).alias("score")))
    return F.filter(scored, lambda e: e["score"] > 0)


def top_of(scores: Column) -> Column:
    """Highest score; on a tie the first in list order; none -> (NULL, 0)."""
    init = F.struct(F.lit(None).cast("string").alias("id"), F.lit(0.0).alias("score"))
    return F.aggregate(scores, init,
                       lambda acc, e: F.when(e["score"] > acc["score"], e).otherwise(acc))


def with_top_player(weekly: DataFrame) -> DataFrame:
    """Adds ``top_player_id``, ``top_player_score`` and ``players_json``."""
    scored = weekly.select("*", player_scores(F.col("players"), F.col("players_points"))
                           .alias("_scores"))
    top = scored.select("*", top_of(F.col("_scores")).alias("_top"),
                        dumps_entries("_scores").alias("players_json"))
    return top.select(*weekly.columns, F.col("_top.id").alias("top_player_id"),
                      F.col("_top.score").alias("top_player_score"), "players_json")


def matchups_raw(weekly: DataFrame, rosters: DataFrame, users: DataFrame,
                 extra: tuple[str, ...] = ()) -> DataFrame:
    """Team-week records with team names and top players (no win flag yet);
    ``extra`` columns of ``weekly`` are kept.

    Rows partitioned by league (or by league and slice) stay so when the names are
    joined; every later window and aggregate is keyed by league plus more and
    reuses that without another shuffle.
    """
    w = with_top_player(weekly)
    joined = w.join(roster_names(rosters, users), [LEAGUE, "roster_id"], "left")
    return joined.select(
        *place(weekly), "week", "roster_id",
        matchup_team_name(F.col("metadata"), F.col("roster_id")).alias("team_name"),
        "matchup_id", "points", "top_player_id", "top_player_score", "players_json", *extra)


def _matchup_window(df: DataFrame) -> Window:
    """Rows of one (league, week, matchup) group."""
    return Window.partitionBy(*place(df, "week", "matchup_id"))


def with_opponents(df: DataFrame, keep_unmatched: bool) -> DataFrame:
    """Each row next to each *other* row of its matchup (``opp_roster_id``,
    ``opponent``, ``opp_points``).

    Same rows as a self-join on (league, week, matchup_id) with
    ``roster_id <> opp_roster_id``, but computed with one window over the
    group: the input is evaluated and shuffled once, not once per join side.
    A group holds the rosters of one matchup (two in head-to-head play; at most
    a league's rosters), so the per-row opponent list is bounded.
    ``keep_unmatched`` keeps rows without an opponent, with NULL opponent
    columns (left-join semantics).
    """
    entry = F.struct(F.col("roster_id").alias("opp_roster_id"),
                     F.col("team_name").alias("opponent"),
                     F.col("points").alias("opp_points"))
    # A NULL matchup id pairs with nothing: those rows contribute no entries,
    # so their (possibly larger) group yields empty lists.
    group = F.collect_list(F.when(F.col("matchup_id").isNotNull(), entry)).over(
        _matchup_window(df))
    others = F.filter(F.col("_group"), lambda e: e["opp_roster_id"] != F.col("roster_id"))
    exploded = F.explode_outer(others) if keep_unmatched else F.explode(others)
    cols = df.columns
    return (df.select(*cols, group.alias("_group"))
            .select(*cols, exploded.alias("_opp"))
            .select(*cols, F.col("_opp.opp_roster_id"), F.col("_opp.opponent"),
                    F.col("_opp.opp_points")))


def matchups(raw: DataFrame, rule: str = "beats") -> DataFrame:
    """The scoreboard table: ``raw`` plus ``won`` (and ``rank_in_matchup``
    under the ``rank`` rule).

    Under ``beats`` each row is paired with the other rows of its matchup; a
    matchup of three rosters therefore gives each roster two rows.
    """
    if rule == "beats":
        j = with_opponents(raw, keep_unmatched=True)
        won = F.when(F.col("points") > F.coalesce(F.col("opp_points"), F.lit(0.0)), 1).otherwise(0)
        return j.select(*MATCHUP_COLUMNS, *slices(raw), won.alias("won"))
    if rule == "rank":
        w = _matchup_window(raw).orderBy(
            F.col("points").desc_nulls_last(), F.col("roster_id").asc_nulls_last())
        rk = F.row_number().over(w).cast("bigint")
        ranked = raw.withColumn("rank_in_matchup", rk)
        return ranked.select(*MATCHUP_COLUMNS, *slices(raw),
                             F.when(F.col("rank_in_matchup") == 1, 1).otherwise(0).alias("won"),
                             "rank_in_matchup")
    raise ValueError(f"unknown win rule: {rule!r}")


def played(df: DataFrame, weeks: tuple[int, int] | None = (1, 14), played_only: bool = True,
           week_col: str = "week", points_col: str = "points") -> DataFrame:
    """Completed-week filter: week within ``weeks`` and points above zero."""
    cond = F.lit(True)
    if weeks is not None:
        cond = cond & F.col(week_col).between(weeks[0], weeks[1])
    if played_only:
        cond = cond & (F.col(points_col) > 0)
    return df.filter(cond)


def contests(m: DataFrame, weeks: tuple[int, int] | None = (1, 14), played_only: bool = True,
             how: str = "inner") -> DataFrame:
    """Each scoreboard row next to each other row of its matchup.

    The week/played filter applies to the team's own row only; the opponent
    side is unfiltered (the pairing is formed first, the filter applied
    after). ``how="left"`` keeps rows without an opponent (``opp_points``
    NULL).
    """
    pairs = with_opponents(m, keep_unmatched=(how == "left"))
    return played(pairs, weeks, played_only)


def opponent_names(weekly: DataFrame, rosters: DataFrame, users: DataFrame) -> DataFrame:
    """(league, week, matchup_id, roster_id) -> name of the first *other*
    roster of the same matchup in payload order; NULL matchup ids match each
    other; no other roster -> NULL.

    Computed with one window over each matchup group, never by pairing rows:
    the first entry of the group, and the first entry whose roster differs from
    it, are enough to answer for every roster of the group.
    """
    named = weekly.select(*place(weekly), "week", "ord", "roster_id", "matchup_id").join(
        roster_names(rosters, users), [LEAGUE, "roster_id"], "left")
    named = named.select(
        *place(weekly), "week", "ord", "roster_id", "matchup_id",
        matchup_team_name(F.col("metadata"), F.col("roster_id")).alias("name"))
    grp = _matchup_window(named).orderBy("ord", "roster_id")
    whole = grp.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct(F.col("roster_id").alias("r"), F.col("name").alias("n"))
    first = F.first(entry).over(whole)
    with_first = named.withColumn("_first", first)
    other = F.when(~F.col("roster_id").eqNullSafe(F.col("_first.r")), F.struct(
        F.col("roster_id").alias("r"), F.col("name").alias("n")))
    second = F.first(other, ignorenulls=True).over(whole)
    both = with_first.withColumn("_second", second)
    opp = F.when(~F.col("roster_id").eqNullSafe(F.col("_first.r")), F.col("_first.n")).otherwise(
        F.col("_second.n"))
    # One answer per key; repeated keys of a payload give the same answer.
    return (both.select(*place(weekly), "week", "matchup_id", "roster_id", opp.alias("opponent_name"))
            .groupBy(*place(weekly, "week", "matchup_id", "roster_id"))
            .agg(F.first("opponent_name").alias("opponent_name")).drop(SLICE))
