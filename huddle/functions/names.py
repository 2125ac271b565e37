"""Display-name fallbacks.

A dictionary ``get(key, default)`` returns the default only when the key is
missing; a key present with a null value stays null. Maps keep that
distinction, so names are looked up in ``map<string,string>`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the surveyed report exactly.
TEAM_PREFIX = "Team_"          # team without a team_name in its metadata
UNKNOWN_TEAM = "Unknown"       # drafting team whose roster or owner is missing
PLAYER_PREFIX = "Player "      # catalog entry without a full_name
UNKNOWN_POSITION = "UNK"       # catalog entry without a position
NAME_KEY = "team_name"
FULL_NAME_KEY = "full_name"
POSITION_KEY = "position"


def map_get_or(m: Column, key: str, default: Column) -> Column:
    """``m.get(key, default)``: the default only when the key is absent.

    A null map counts as an empty one.
    """
    return F.when(F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False)),
                  F.try_element_at(m, F.lit(key))).otherwise(default)


def _text(c: Column) -> Column:
    """A value as Python formats it in an f-string (``None`` for NULL)."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def team_label(roster_id: Column) -> Column:
    return F.concat(F.lit(TEAM_PREFIX), _text(roster_id))


def matchup_team_name(metadata: Column, roster_id: Column) -> Column:
    """Team of a weekly row: a missing roster, owner, user or key all give
    ``Team_<roster_id>``."""
    return map_get_or(metadata, NAME_KEY, team_label(roster_id))


def drafting_team_name(roster_id: Column, roster_found: Column, user_found: Column,
                       metadata: Column) -> Column:
    """Team of a draft pick: ``Unknown`` unless the roster id is set, the
    roster exists and its owner is a known user."""
    known = (roster_id.isNotNull() & (roster_id != 0) & F.coalesce(roster_found, F.lit(False))
             & F.coalesce(user_found, F.lit(False)))
    return F.when(known, map_get_or(metadata, NAME_KEY, team_label(roster_id))).otherwise(
        F.lit(UNKNOWN_TEAM))


def player_name(attrs: Column, player_id: Column) -> Column:
    return map_get_or(attrs, FULL_NAME_KEY, F.concat(F.lit(PLAYER_PREFIX), _text(player_id)))


def player_position(attrs: Column) -> Column:
    return map_get_or(attrs, POSITION_KEY, F.lit(UNKNOWN_POSITION))
