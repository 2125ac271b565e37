"""Shared building blocks for the reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions import exact

LEAGUE = "league_id"

# Two-level partitioning: rows of a very large league carry their week here, those of
# all others 0. Rows are spread by (league, slice), so a league of a third of all rows
# is many tasks' work and a usual one a single task's. Absent where no league is large.
SLICE = "_slice"


def slices(df: DataFrame) -> list[str]:
    return [SLICE] if SLICE in df.columns else []


def place(df: DataFrame, *more: str) -> list[str]:
    """Keys of work inside a league: (league, more), beginning with what the rows are spread by.

    Only for keys that include the week, or where each slice is worked on by itself.
    """
    return [LEAGUE, *slices(df), *more]


def summarise(df: DataFrame, keys, value, plain=None, spread: bool = False) -> DataFrame:
    """``exact.summarise``, a league's slices added up where they are first."""
    return exact.summarise(df, list(keys), value, plain, spread, tuple(slices(df)))


def top_n(df: DataFrame, order: Sequence[Column], n: int = 10, per_league: bool = True,
          rank_col: str | None = None, keys: Sequence[str] = (LEAGUE,)) -> DataFrame:
    """Keep the first ``n`` rows by ``order`` (which must end in a unique
    tie-break).

    ``per_league=True`` ranks within each league: Spark plans the rank filter
    as a WindowGroupLimit. On input already partitioned by league it runs in
    place; otherwise a partial limit runs before the shuffle, so each map task
    ships at most ``n`` rows per league. ``per_league=False`` is one global
    top-n, planned as TakeOrderedAndProject (no single-partition sort of the
    whole input); only those ``n`` rows are then numbered.
    """
    name = rank_col or "_rn"
    if per_league:
        if slices(df):
            # the first rows of each slice where they are, then of the league
            w = Window.partitionBy(*keys, SLICE).orderBy(*order)
            df = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n).drop(name)
        w = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= n)
    else:
        order = [*order, *[F.col(k).asc() for k in keys]]  # unique across leagues too
        limited = df.orderBy(*order).limit(n)
        w = Window.orderBy(*order)  # over at most n rows
        out = limited.withColumn(name, F.row_number().over(w).cast("bigint"))
    return out if rank_col else out.drop(name)


def week_list(week_col: str = "week") -> Column:
    """``'1, 4, 9'``: the weeks of a group in ascending order."""
    return F.expr(f"listagg(cast({week_col} as string), ', ') within group (order by {week_col})")


def result_letter(won: Column) -> Column:
    return F.when(won == 1, F.lit("W")).otherwise(F.lit("L"))
