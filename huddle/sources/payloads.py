"""The driver's tables as JSON payload text, for the parsers of ``landing``.

Each frame has the columns that landed files have (``value`` and the keys of the
path), made in the plan from the whole tables: rows of a league, or of a league's
week, become one JSON list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.sources import fixture as fx

EMPTY_WEEK = 7          # an empty list in every odd league
BROKEN_WEEK = 19        # text that isn't JSON in every third league


def as_lists(df: DataFrame, keys: list[str], order: Column, element: Column) -> DataFrame:
    """``keys`` and ``value``: the elements of a key as a JSON list, in order. A list has
    the rows of one league (or its week), as a payload has."""
    text = F.to_json(element, {"ignoreNullFields": "false"})
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("e"))))
    joined = F.array_join(F.transform(rows, lambda x: x["e"]), ",")
    return df.groupBy(*keys).agg(F.concat(F.lit("["), joined, F.lit("]")).alias("value"))


def leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """League objects: with a name, without one, with an explicit null."""
    ids = fx.rosters(spark, sf_dir).select("league_id").distinct()
    name = F.concat(F.lit('{"name": "League '), F.col("league_id").cast("string"), F.lit('"}'))
    return ids.withColumn("value", F.when(F.col("league_id") % 3 == 0, name).when(
        F.col("league_id") % 3 == 1, "{}").otherwise('{"name": null}'))


def draft_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lists(drafts(spark, sf_dir), ["league_id"], F.col("ord"), F.struct("draft_id"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of each league; every third user is listed twice, first under an old name."""
    now = fx.users(spark, sf_dir).withColumn("at", F.col("user_id").cast("long") * 2 + 1)
    old = now.filter(F.col("user_id").cast("long") % 3 == 0).withColumn(
        "metadata", F.create_map(F.lit("team_name"), F.lit("old"))).withColumn("at", F.col("at") - 1)
    return as_lists(now.unionByName(old), ["league_id"], F.col("at"), F.struct("user_id", "metadata"))


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_lists(fx.rosters(spark, sf_dir), ["league_id"], F.col("roster_id"), F.struct("roster_id", "owner_id"))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly payloads; roster 3 has an explicit null for its points in every fifth week,
    and ``EMPTY_WEEK`` and ``BROKEN_WEEK`` replace payloads of some leagues."""
    w = fx.weekly(spark, sf_dir).withColumn(
        "points", F.when(~((F.col("roster_id") == 3) & (F.col("week") % 5 == 0)), F.col("points")))
    lists = as_lists(w, ["league_id", "week"], F.col("ord"),
                     F.struct("roster_id", "matchup_id", "points", "players", "players_points"))
    return lists.withColumn("value", F.when((F.col("week") == EMPTY_WEEK) & (F.col("league_id") % 2 == 1), "[]")
                            .when((F.col("week") == BROKEN_WEEK) & (F.col("league_id") % 3 == 0), "[{")
                            .otherwise(F.col("value")))


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(league_id, ord, draft_id): each league's drafts, the first one is reported."""
    leagues = fx.picks(spark, sf_dir).select("league_id").distinct()
    return leagues.select("league_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ord")).withColumn(
        "draft_id", F.concat(F.lit("d"), F.col("ord").cast("string")))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pick lists of two drafts; the second one's picks are numbered from 1,000."""
    p = fx.picks(spark, sf_dir)
    both = p.withColumn("draft_id", F.lit("d0")).unionByName(
        p.withColumn("draft_id", F.lit("d1")).withColumn("pick_no", F.col("pick_no") + 1000))
    return as_lists(both, ["league_id", "draft_id"], F.col("ord"), F.struct("pick_no", "player_id", "roster_id"))
