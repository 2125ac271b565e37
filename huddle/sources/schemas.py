"""Canonical frames every operator reads.

``league_id`` is part of every key: one job covers many leagues. ``ord`` is
the position of a record in its payload list; it decides "first" and
"last wins" wherever the order of a list matters.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, MapType, StringType,
                               StructField, StructType)

# One element of a weekly matchups payload.
MATCHUP_ELEMENT = StructType([
    StructField("roster_id", IntegerType()),
    StructField("matchup_id", IntegerType()),
    StructField("points", DoubleType()),
    StructField("players", ArrayType(StringType())),
    StructField("players_points", MapType(StringType(), DoubleType())),
])

USER_ELEMENT = StructType([
    StructField("user_id", StringType()),
    StructField("metadata", MapType(StringType(), StringType())),
])

ROSTER_ELEMENT = StructType([
    StructField("roster_id", IntegerType()),
    StructField("owner_id", StringType()),
])

DRAFT_ELEMENT = StructType([StructField("draft_id", StringType())])

PICK_ELEMENT = StructType([
    StructField("pick_no", IntegerType()),
    StructField("player_id", StringType()),
    StructField("roster_id", IntegerType()),
])

LEAGUE_OBJECT = StructType([StructField("name", StringType())])

# player id -> attributes; values kept as text so that a missing key and a
# null value stay different.
PLAYER_CATALOG = MapType(StringType(), MapType(StringType(), StringType()))

# Column lists of the canonical frames.
WEEKLY_COLUMNS = ["league_id", "week", "ord", "roster_id", "matchup_id", "points",
                  "players", "players_points"]
USERS_COLUMNS = ["league_id", "user_id", "metadata"]
ROSTERS_COLUMNS = ["league_id", "roster_id", "owner_id"]
PICKS_COLUMNS = ["league_id", "ord", "pick_no", "player_id", "roster_id"]
PLAYERS_COLUMNS = ["player_id", "attrs"]
PLAYER_POINTS_COLUMNS = ["league_id", "player_id", "points"]

# Rows and markers of ``landing.weekly_rows`` with the file they come from.
WEEKLY_ROWS = ("league_id string, week int, source_file string, landed_at timestamp, ord int, roster_id int, matchup_id int, "
               "points double, players array<string>, players_points map<string,double>, broken boolean")
