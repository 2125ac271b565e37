"""The driver's test tables mapped onto the canonical frames.

The mapping is the one written down in FIXTURES.md part B: ``events`` become
team-weeks (ten teams per league, day of the season as week, event types as players),
``customer`` gives owners and team names, ``part`` the draft board and player
catalog, ``lineitem`` the player points. Every frame is derived by Spark from
the whole tables, so the work grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEASON_START = date(2024, 1, 1)  # week 1; a day of events is a week
PENALISED = 11             # players whose number it divides score negatively
TEAMS_PER_LEAGUE = 10      # league_id = user_id div 10
PICKS_PER_LEAGUE = 200     # draft league_id = p_partkey div 200
UNLISTED_SIZE = 50         # parts of this size are missing from the catalog
ROSTER_MISSING_BELOW = -500.0  # customer balance at or below: no draft roster

# Fixed values of the fixture mapping (FIXTURES.md part B): part type -> position.
POSITION_OF_TYPE = {
    "STANDARD": "QB",
    "LARGE": "RB",
    "MEDIUM": "WR",
    "SMALL": "TE",
    "ECONOMY": "K",
    "PROMO": "DEF",
}
NAMELESS_POSITION = "DEF"  # catalog entries of this position carry no full_name


UNITS = 1e6                # of a score; the tables' values have two decimals, an eighth of one five


def _units(value):
    """A value of the tables as a whole number of millionths."""
    return F.rint(value * UNITS).cast("bigint")


def _score(units):
    """The score nearest to a sum of millionths."""
    return units.cast("double") / UNITS


# The columns that are used. With a schema at hand no job reads the files' footers for it.
SCHEMAS = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "customer": "c_custkey long, c_name string, c_acctbal double",
    "part": "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_partkey long, l_quantity double, l_returnflag string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _in_weeks(ts, weeks: tuple[int, int]):
    """The time range of ``weeks``: a plain comparison, which the scan can use to skip data."""
    day = lambda n: F.lit(SEASON_START + timedelta(days=n))
    return (ts >= day(weeks[0] - 1).cast("timestamp")) & (ts < day(weeks[1]).cast("timestamp"))


def weekly(spark: SparkSession, sf_dir: str, coarse: bool = False,
           weeks: tuple[int, int] | None = None, eighths: bool = False,
           spread: bool = False) -> DataFrame:
    """Team-week records: one row per (league, week, roster) with events.

    ``players_points`` sums each event type's values exactly (integer
    units); ``players`` lists
    the types alphabetically. ``coarse`` floors points to hundreds, which gives
    many ties and zero weeks. ``weeks`` reads only the events of those weeks.
    ``eighths`` divides every value by 8, which gives scores of up to five decimals.
    ``spread`` partitions by league and week, for leagues too large for one task.
    """
    raw = _read(spark, sf_dir, "events")
    if weeks is not None:
        raw = raw.filter(_in_weeks(F.col("ts"), weeks))
    ev = raw.select(
        F.expr(f"user_id div {TEAMS_PER_LEAGUE}").alias("league_id"),
        (F.datediff(F.col("ts"), F.lit(SEASON_START)) + 1).alias("week"),
        (F.col("user_id") % TEAMS_PER_LEAGUE).cast("int").alias("roster_id"),
        F.col("event_type").alias("player_id"),
        _units(F.col("value") / 8 if eighths else F.col("value")).alias("v"),
    )
    # Partial aggregation runs before the shuffle, so a user with a huge share
    # of the events sends at most one row per (day, type) per map task.
    per_player = ev.groupBy("league_id", "week", "roster_id", "player_id").agg(
        F.sum("v").alias("s"))
    # From here on a league is the unit of work: hash-partition the (small)
    # per-player sums by league once; the team-week aggregate and every later
    # window and aggregate keyed by league reuse that partitioning.
    tw = per_player.repartition("league_id", *(["week"] if spread else [])).groupBy("league_id", "week", "roster_id").agg(
        F.sum("s").alias("total"),
        # at most one entry per distinct player of the team-week
        F.sort_array(F.collect_list(F.struct(
            F.col("player_id").alias("key"), _score(F.col("s")).alias("value")))
        ).alias("entries"),
    )
    points = _score(F.col("total"))
    if coarse:
        points = (F.floor(points / F.lit(100.0)) * F.lit(100)).cast("double")
    r, w = F.col("roster_id"), F.col("week")
    matchup_id = F.when(F.pmod(r * 2 - w, F.lit(TEAMS_PER_LEAGUE)) == 0, F.lit(None)).otherwise(
        F.least(r, F.pmod(w - r, F.lit(TEAMS_PER_LEAGUE)))).cast("int")
    return tw.select(
        "league_id", "week",
        F.col("roster_id").alias("ord"),
        "roster_id",
        matchup_id.alias("matchup_id"),
        points.alias("points"),
        F.transform("entries", lambda e: e["key"]).alias("players"),
        F.map_from_entries("entries").alias("players_points"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a score of its roster: (league_id, roster_id, event_id, value)."""
    return _read(spark, sf_dir, "events").select(
        F.expr(f"user_id div {TEAMS_PER_LEAGUE}").alias("league_id"),
        (F.col("user_id") % TEAMS_PER_LEAGUE).cast("int").alias("roster_id"), "event_id", "value")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per customer; a positive balance means the metadata carries a
    team name, otherwise the key is missing."""
    c = _read(spark, sf_dir, "customer")
    empty = F.create_map().cast("map<string,string>")
    return c.select(
        F.expr(f"c_custkey div {TEAMS_PER_LEAGUE}").alias("league_id"),
        F.col("c_custkey").cast("string").alias("user_id"),
        F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("team_name"), F.col("c_name")))
         .otherwise(empty).alias("metadata"),
    )


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchup rosters 0..9 of each league, owned by the customer of the same key."""
    c = _read(spark, sf_dir, "customer")
    return c.select(
        F.expr(f"c_custkey div {TEAMS_PER_LEAGUE}").alias("league_id"),
        (F.col("c_custkey") % TEAMS_PER_LEAGUE).cast("int").alias("roster_id"),
        F.col("c_custkey").cast("string").alias("owner_id"),
    )


def draft_rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft rosters 1..10 (0 would read as "no roster"); a balance at or below
    -500 means the roster is missing."""
    c = _read(spark, sf_dir, "customer").filter(F.col("c_acctbal") > ROSTER_MISSING_BELOW)
    return c.select(
        F.expr(f"c_custkey div {TEAMS_PER_LEAGUE}").alias("league_id"),
        ((F.col("c_custkey") % TEAMS_PER_LEAGUE) + 1).cast("int").alias("roster_id"),
        F.col("c_custkey").cast("string").alias("owner_id"),
    )


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft picks: parts of a league in order of price (ties by key)."""
    p = _read(spark, sf_dir, "part").select(
        F.expr(f"p_partkey div {PICKS_PER_LEAGUE}").alias("league_id"), "p_partkey",
        "p_retailprice")
    w = Window.partitionBy("league_id").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    numbered = p.select("league_id", "p_partkey", F.row_number().over(w).cast("int").alias("pick_no"))
    pick_no = F.col("pick_no")
    return numbered.select(
        "league_id",
        (pick_no - 1).alias("ord"),
        pick_no,
        F.col("p_partkey").cast("string").alias("player_id"),
        (((pick_no - 1) % TEAMS_PER_LEAGUE) + 1).cast("int").alias("roster_id"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player catalog: parts not of the unlisted size."""
    p = _read(spark, sf_dir, "part").filter(F.col("p_size") != UNLISTED_SIZE)
    pos_map = F.create_map(*[x for kv in POSITION_OF_TYPE.items() for x in map(F.lit, kv)])
    pos = F.try_element_at(pos_map, F.col("p_type"))
    with_name = F.create_map(F.lit("full_name"), F.col("p_name"), F.lit("position"), pos)
    without_name = F.create_map(F.lit("position"), pos)
    return p.select(
        F.col("p_partkey").cast("string").alias("player_id"),
        F.when(F.coalesce(pos == NAMELESS_POSITION, F.lit(False)), without_name)
         .otherwise(with_name).alias("attrs"),
    )


def player_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-week scores: every order line; negative for returns and for every
    ``PENALISED``-th player, who so has no positive score at all."""
    li = _read(spark, sf_dir, "lineitem")
    negative = (F.col("l_returnflag") == "R") | (F.col("l_partkey") % PENALISED == 0)
    sign = F.when(negative, F.lit(-1.0)).otherwise(F.lit(1.0))
    return li.select(
        F.expr(f"l_partkey div {PICKS_PER_LEAGUE}").alias("league_id"),
        F.col("l_partkey").cast("string").alias("player_id"),
        (F.col("l_quantity") * sign).alias("points"),
    )


@dataclass
class Tables:
    weekly: DataFrame
    users: DataFrame
    rosters: DataFrame
    draft_rosters: DataFrame
    picks: DataFrame
    players: DataFrame
    player_points: DataFrame


def load(spark: SparkSession, sf_dir: str, coarse: bool = False, spread: bool = False) -> Tables:
    return Tables(
        weekly=weekly(spark, sf_dir, coarse=coarse, spread=spread),
        users=users(spark, sf_dir),
        rosters=rosters(spark, sf_dir),
        draft_rosters=draft_rosters(spark, sf_dir),
        picks=picks(spark, sf_dir),
        players=players(spark, sf_dir),
        player_points=player_points(spark, sf_dir),
    )
