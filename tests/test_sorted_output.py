"""Sorted reports: places from per-partition counts, files sorted in name order."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from huddle.functions.display import with_position
from huddle.plans.sorted_output import positions, write_sorted


@pytest.fixture(scope="module")
def standings(spark):
    """A league of most teams, many small ones, a null name."""
    big = spark.range(3000).select(F.lit("big").alias("league_id"), F.concat(F.lit("t"), "id").alias("team_name"), (F.col("id") % 17).alias("wins"),
                                   F.lit(5).cast("long").alias("losses"), (F.col("id") * 37 % 1009 / 7).alias("avg_pts"))
    small = spark.range(400).select(F.concat(F.lit("L"), F.col("id") % 90).alias("league_id"), F.when(F.col("id") != 3, F.concat(F.lit("t"), "id")).alias("team_name"),
                                    (F.col("id") % 5).alias("wins"), F.lit(5).cast("long").alias("losses"), F.col("id").cast("double").alias("avg_pts"))
    return big.unionByName(small).repartition(11)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_equal_those_of_a_window(spark, standings, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = positions(standings, "standings")
        assert got.columns == [*standings.columns, "pos_no"] and dict(got.dtypes)["pos_no"] == "bigint"
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, with_position(standings, "standings").collect()), key=repr)
        assert positions(standings.filter("false"), "standings").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_files_in_name_order_are_sorted(spark, standings, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_sorted(standings, "standings", str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    files = sorted(glob.glob(f"{tmp_path}/out/part-*.parquet"))
    rows = [(r["league_id"], r["pos_no"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert rows == sorted(rows) and len(rows) == 3400
    sizes = [pq.read_metadata(f).num_rows for f in files]
    assert len(sizes) > 1 and max(sizes) < 3400 / 3     # the large league is many tasks' work
