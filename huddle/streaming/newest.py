"""The newest payload of every (league, week), chosen while the files arrive.

``ingest`` keeps every fetch and looks for the newest one over the whole history when it is
read. Here the stream itself decides: its state holds, by (league, week), which payload was
taken last (whether it was whole, when it landed, its path), and a new file is passed on only
if it beats that one. A file that lands late, or again, or broken after a whole one changes nothing,
as in ``ingest.current_rows``. State is three values a week, however often a week is fetched.

Each micro-batch becomes a folder of its own:

    <table>/batch=<id>/        parsed rows of the payloads taken in this batch
    <table>/_done/<id>         made once the folder is whole
    <table>/_checkpoint/       the stream's log and state: they belong to the table

A batch that is tried again after a failure writes the same folder anew, so it counts once (a finished one
is left as it is); readers look at finished batches only. Of a week taken in several batches the last one holds. So a reader that knows
up to which batch it has read needs the later folders only (``batch_rows``), and no others are listed.

Defined results: an empty payload and a broken one leave one marker row (``ord`` NULL), the broken one
only as long as the week has no whole one; files that land at the same time are ordered by path; a
table without a finished batch has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from huddle.files import Folder
from huddle.session import importable
from huddle.sources import landing, schemas
from huddle.streaming.ingest import SOURCE_COLUMNS, landed_files

_TAKEN = "league_id string, week int, value string, source_file string, landed_us long"
_STATE = "good boolean, landed_us long, source_file string"


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one (league, week): the newest of the new files, if it beats what was taken before."""
    best, value = (state.get if state.exists else None), None
    for files in batches:
        for good, landed, path, text in zip(files["good"], files["landed_us"], files["source_file"], files["value"]):
            version = (bool(good), int(landed), path)
            if best is None or version > best:
                best, value = version, (text,)
    if value is not None:
        state.update(best)
        yield pd.DataFrame({"league_id": [key[0]], "week": [key[1]], "value": list(value),
                            "source_file": [best[2]], "landed_us": [best[1]]})


def newest_payloads(files: DataFrame) -> DataFrame:
    """Of a stream of landed files (league_id, week, value, source_file, landed_at) those that are the
    newest of their week when they arrive."""
    told = files.select("league_id", "week", "value", (~landing.is_broken(F.col("value"))).alias("good"),
                        F.unix_micros("landed_at").alias("landed_us"), "source_file")
    taken = told.groupBy("league_id", "week").applyInPandasWithState(
        _take, _TAKEN, _STATE, "append", GroupStateTimeout.NoTimeout)
    return taken.select("league_id", "week", "value", "source_file",
                        F.timestamp_micros("landed_us").alias("landed_at"))


def start_newest_ingest(spark: SparkSession, root: str, table: str, trigger: str = "availableNow",
                        interval: str = "5 minutes", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Starts the stream; ``trigger`` as for ``ingest.start_weekly_ingest``."""
    importable(spark)
    table = table.rstrip("/")
    rows = landing.weekly_rows(newest_payloads(landed_files(spark, root, max_files_per_trigger)),
                               extra=SOURCE_COLUMNS, keep_empty=True)

    def add(batch: DataFrame, number: int) -> None:
        folder = Folder(spark, table)
        if str(number) in folder.names("_done"):
            # tried again after it was finished: the folder is whole, but the state must still move on
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        folder.claim(f"_done/{number}")

    w = rows.writeStream.foreachBatch(add).option("checkpointLocation", f"{table}/_checkpoint")
    w = w.trigger(availableNow=True) if trigger == "availableNow" else w.trigger(processingTime=interval)
    return w.start()


def finished_batches(spark: SparkSession, table: str, after: int = -1) -> list[int]:
    """Numbers of the finished batches above ``after``, ascending."""
    return sorted(n for n in map(int, Folder(spark, table).names("_done")) if n > after)


def batch_rows(spark: SparkSession, table: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Rows and markers of the weeks taken in the finished batches above ``after`` (and not above ``upto``),
    each week as its last such batch has it. Reads the folders of these batches alone."""
    table = table.rstrip("/")
    numbers = [n for n in finished_batches(spark, table, after) if upto is None or n <= upto]
    if not numbers:
        return spark.createDataFrame([], schemas.WEEKLY_ROWS)
    rows = spark.read.schema(f"{schemas.WEEKLY_ROWS}, batch int").option("basePath", table).parquet(
        *[f"{table}/batch={n}" for n in numbers])
    last = rows.groupBy("league_id", "week").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["league_id", "week", "batch"], "left_semi").drop("batch")
