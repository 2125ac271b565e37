"""Incremental ingest of weekly payloads as they land.

The surveyed tool fetched every week again on each run. Here a fetcher lands
each response as a new file, ``league_id=<id>/week=<n>/matchups*.json`` (a
re-fetch of a week lands another file), and a Structured Streaming query:

* picks up only files it has not seen (the file source's own log),
* parses them with the batch parser (``landing.weekly_rows``),
* appends the rows, tagged with the file path and landing time, through the
  parquet file sink, which commits each micro-batch exactly once (a retried
  batch after a lost executor does not duplicate rows).

``current_weekly`` turns that append-only table into the weekly frame the
reports read: for each (league, week) only the newest landed payload counts
(a later fetch replaces the week, as the dictionary update of the surveyed
code did; a broken one never does), and optionally weeks from the first empty payload on are dropped.
Run it with ``trigger="availableNow"`` after each fetch, or continuously.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from huddle.session import checkpoint_root
from huddle.sources import landing

PATTERN = "league_id=*/week=*/matchups*.json"
SOURCE_COLUMNS = ["source_file", "landed_at"]


def landed_files(spark: SparkSession, root: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of newly landed weekly files: league_id, week, value, source_file, landed_at."""
    root = root.rstrip("/")
    r = (spark.readStream.schema("value string, league_id string, week int")
         .option("basePath", root).option("wholetext", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.text(f"{root}/{PATTERN}").select(
        "league_id", "week", "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("landed_at"))


def weekly_stream(spark: SparkSession, root: str, max_files_per_trigger: int | None = None
                  ) -> DataFrame:
    """Streaming DataFrame of parsed weekly rows from newly landed files; an
    empty payload yields one marker row with ``ord`` NULL."""
    files = landed_files(spark, root, max_files_per_trigger)
    return landing.weekly_rows(files, extra=SOURCE_COLUMNS, keep_empty=True)


def start_weekly_ingest(spark: SparkSession, root: str, table_path: str,
                        checkpoint: str | None = None, trigger: str = "availableNow",
                        interval: str = "5 minutes",
                        max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the ingest query; ``trigger`` is ``"availableNow"`` (process what
    has landed, then stop) or ``"processingTime"`` (every ``interval``)."""
    ck = checkpoint or f"{checkpoint_root(spark)}/huddle/streams/weekly-ingest"
    w = (weekly_stream(spark, root, max_files_per_trigger).writeStream
         .format("parquet").option("path", table_path).option("checkpointLocation", ck)
         .outputMode("append"))
    if trigger == "availableNow":
        w = w.trigger(availableNow=True)
    else:
        w = w.trigger(processingTime=interval)
    return w.start()


def current_rows(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows (and markers) of each (league, week)'s newest payload that isn't broken;
    of a broken one only if the week has no other.

    The newest version is a partially aggregated maximum, joined back: the rows
    themselves, with their lists, are moved once and never windowed.
    """
    t = spark.read.parquet(table_path)
    version = F.struct((~F.col("broken")).alias("good"), "landed_at", "source_file")
    newest = t.groupBy("league_id", "week").agg(F.max(version).alias("_v")).select(
        "league_id", "week", F.col("_v.source_file").alias("source_file"))
    return t.join(newest, ["league_id", "week", "source_file"], "left_semi")


def current_weekly(spark: SparkSession, table_path: str, weeks: tuple[int, int] | None = None,
                   stop_at_empty: bool = False) -> DataFrame:
    """Weekly frame from the ingested table: the newest payload per
    (league, week); with ``stop_at_empty`` only the weeks before each league's
    first empty or broken payload (the weekly report's rule)."""
    latest = current_rows(spark, table_path)
    if weeks is not None:
        latest = latest.filter(F.col("week").between(*weeks))
    if stop_at_empty:
        latest = landing.report_weeks(latest, weeks or landing.REPORT_WEEKS)
    return latest.filter(F.col("ord").isNotNull()).select(
        "league_id", "week", "ord", "roster_id", "matchup_id", "points", "players",
        "players_points")


def compact_weekly(spark: SparkSession, table_path: str, out_path: str) -> None:
    """Writes the newest version of every week, markers too, as a new table of the
    same columns, without the versions that later fetches replaced."""
    current_rows(spark, table_path).write.mode("errorifexists").parquet(out_path)
