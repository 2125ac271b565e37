"""Reports in their printed order, sorted by many tasks.

A report is range-partitioned on (league, its sort keys) and sorted inside the partitions.
A row's place in its league is its place in its partition, less that of the league's
first row there, plus the league's rows in the partitions before: one row per partition
and border is added up, never the rows of a league in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.display import LEAGUE, sort_keys
from huddle.session import scratch_path


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, name: str, col: str = "pos_no") -> DataFrame:
    """The report ``name`` with the 1-based place of each row in its league, as printed.

    Rows that are equal in all sort keys get places in any order. The report is
    written, so that the range's sample does not compute it twice.
    """
    keys = [F.col(LEAGUE).asc_nulls_first(), *sort_keys(name)]
    rows = _written(df, f"report-{name}")
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    # the partition is above 33 bits of the number, the place in it below
    placed = _written(placed, f"sorted-{name}").withColumns(
        {"_part": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    before = Window.partitionBy("_league").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col(LEAGUE).alias("_league"), F.col("_part").alias("_in")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_low")).select(
        "_league", "_in", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"))
    joined = placed.join(starts, F.col(LEAGUE).eqNullSafe(F.col("_league")) & (F.col("_part") == F.col("_in")))
    return joined.select(*df.columns, (F.col("_place") + F.col("_shift") + 1).cast("long").alias(col))


def write_sorted(df: DataFrame, name: str, path: str, col: str = "pos_no") -> None:
    """Writes the report as parquet files that, read in name order, are sorted by league and place."""
    keys = [F.col(LEAGUE).asc_nulls_first(), F.col(col).asc()]
    positions(df, name, col).repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
