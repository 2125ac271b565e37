"""Lucky / unlucky record.

Listed as a stat without a formula, so this is our definition: a team's
expected wins are the sum over its played weeks of the share of the other
teams of the league it outscored that week (``percent_rank`` by points within
(league, week)); luck is actual minus expected wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huddle.functions.numeric import round_ref
from huddle.operators.common import LEAGUE, place, summarise
from huddle.operators.scoreboard import played


def luck(m: DataFrame, weeks=(1, 14), played_only: bool = True, digits: int = 4) -> DataFrame:
    w = Window.partitionBy(*place(m, "week")).orderBy(F.col("points").asc_nulls_first())
    rows = played(m, weeks, played_only).withColumn("_share", F.percent_rank().over(w))
    s = summarise(rows, [LEAGUE, "team_name"], "_share", {"actual_wins": ("sum", F.col("won").cast("bigint"))})
    return s.select(LEAGUE, "team_name", "actual_wins", round_ref("total", digits).alias("expected_wins"),
                    round_ref(F.col("actual_wins") - F.col("total"), digits).alias("luck"))
