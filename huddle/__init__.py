"""huddle — head-to-head league scoring analytics on Spark.

Reads league, roster, weekly matchup and draft records for many leagues at
once, builds a win/loss scoreboard and computes standings, leaderboards,
head-to-head, volatility and draft-value reports. Everything is written with
the DataFrame API; no Python UDF runs on the data path.

Layout:
  sources/    landed JSON payloads and the driver test tables -> canonical frames
  functions/  column helpers (rounding, exact averages, name fallbacks, JSON text)
  operators/  scoreboard, leaderboards, contests, draft, luck
  plans/      report runners, ad-hoc SQL, materialization, query registry
  streaming/  incremental ingest of newly landed weekly payloads
"""

from huddle.session import get_spark, checkpoint_root

__all__ = ["get_spark", "checkpoint_root"]
