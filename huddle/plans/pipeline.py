"""End-to-end report runs: scan the inputs once, write the shared tables,
then run every report on them.

    outputs = fixture_pipeline(spark, "/root/testdata/sf0.1")
    outputs["standings"].write.parquet(...)

Plan of a run:
  1. events (or parsed weekly payloads, written bucketed by league) ->
     team-weeks with names and top players (partial aggregation before every
     shuffle) -> written once, bucketed by league (``matchups_raw``);
  2. the two scoreboards (``beats`` and ``rank`` rule) from that table ->
     written once, bucketed by league (no shuffle: the input already is);
  3. player totals from the player-week scores -> written once; the picks
     enriched with catalog, totals and drafting team -> written once,
     bucketed by league (all six draft reports read that);
  4. every report reads the written tables (column-pruned parquet scans);
     the reports over the scoreboards run without any shuffle, since each
     is keyed by league and the tables are bucketed by league.
Written tables live under ``spark.checkpoint.dir`` (shared storage on a
cluster), which also cuts the lineage: a lost executor re-reads files instead
of recomputing the event aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from huddle.operators import draft as dr
from huddle.operators.common import place, slices
from huddle.operators import scoreboard as sb
from huddle.plans.report import run_draft_report, run_report, run_season_stats
from huddle.plans.versions import Build, Versions, buckets_for
from huddle.session import tuned
from huddle.sources import fixture as fx
from huddle.sources import landing
from huddle.streaming.ingest import SOURCE_COLUMNS, current_rows


class Reports(dict):
    """Reports and shared tables by name, and the ``build`` that holds the written tables.

    The frames read them: ``close`` when done. It deletes the files unless they are a version."""

    build: Build | None = None

    def close(self) -> None:
        if self.build:
            self.build.close()


def _new_build(spark: SparkSession, versions: Versions | None) -> Build:
    return versions.build() if versions else Build(spark)


def build_scoreboards(weekly: DataFrame, rosters: DataFrame, users: DataFrame,
                      build: Build | None, buckets: int | None = None):
    """Written by ``build`` if given: (beats scoreboard over the report weeks, rank scoreboard over the season
    weeks, team-weeks of the report). Names and top players are found once; with the
    flags of ``landing.flagged_weeks`` each scoreboard takes its own weeks."""
    def keep(df: DataFrame, name: str, exchange: bool = False) -> DataFrame:
        return build.materialize(df, name, place(df), buckets, exchange) if build else df

    flags = tuple(c for c in ("in_report", "in_season") if c in weekly.columns)
    raw = sb.matchups_raw(weekly, rosters, users, flags)
    raw = keep(raw, "matchups_raw", exchange=bool(slices(raw)))
    of = lambda flag: (raw.filter(flag) if flags else raw).drop(*flags)
    beats = keep(sb.matchups(of("in_report"), "beats"), "scoreboard_beats")
    rank = keep(sb.matchups(of("in_season"), "rank"), "scoreboard_rank")
    return beats, rank, of("in_report")


def all_reports(beats: DataFrame, rank: DataFrame, picks: DataFrame, players: DataFrame,
                totals: DataFrame, draft_rosters: DataFrame, users: DataFrame,
                weeks=(1, 14), n: int = 10, per_league: bool = True,
                build: Build | None = None, buckets: int | None = None) -> Reports:
    """Every report. With a ``build`` the picks are enriched once (catalog,
    totals, drafting team) and written bucketed by league, so the six draft
    reports run without a shuffle, like the scoreboard reports."""
    enriched = None
    if build:
        enriched = build.materialize(dr.enrich_picks(picks, players, totals, draft_rosters, users),
                                     "picks_enriched", "league_id", buckets, exchange=buckets is not None)
    out = Reports()
    out.build = build
    out.update(run_season_stats(rank, n, per_league))
    out.update(run_report(beats, weeks, n, per_league))
    out.update(run_draft_report(picks, players, totals, draft_rosters, users, n, per_league,
                                enriched=enriched))
    return out


def fixture_pipeline(spark: SparkSession, sf_dir: str, write: bool = True,
                     large_league: int = sb.LARGE_LEAGUE, versions: Versions | None = None) -> Reports:
    """All reports over the driver tables (one weekly source for both rules)."""
    tuned(spark)
    build = _new_build(spark, versions) if write else None
    large = sb.large_leagues(fx.rosters(spark, sf_dir), large_league)
    hot = not large.isEmpty()
    t = fx.load(spark, sf_dir, spread=hot)
    beats, rank, _ = build_scoreboards(sb.sliced(t.weekly, large) if hot else t.weekly, t.rosters, t.users, build)
    totals = dr.player_totals(t.player_points)
    if build:
        totals = build.materialize(totals, "player_totals")
    out = all_reports(beats, rank, t.picks, t.players, totals, t.draft_rosters, t.users,
                      build=build)
    out["scoreboard"] = beats
    out["scoreboard_rank"] = rank
    out["player_totals"] = totals
    if versions:
        build.commit()
    return out


def landing_pipeline(spark: SparkSession, root: str, out_dir: str,
                     weeks: tuple[int, int] = (1, 14), per_league: bool = True,
                     n: int = 10, table: str | None = None,
                     large_league: int = sb.LARGE_LEAGUE, versions: Versions | None = None) -> Reports:
    """All reports over landed JSON: parse once into parquet, then report.
    ``weeks`` is the completed-week range of the weekly report; top-n lists
    rank within each league, or across all leagues with ``per_league=False``.

    The parsed weekly rows, the largest input, are exchanged by league once and
    written bucketed (in the checkpoint folder), so the windows over a league and
    the roster join of both scoreboards read them without a shuffle.

    Leagues of more than ``large_league`` rosters are spread by week as well.

    ``versions``: the written tables become its next version, once all are whole.

    ``table``: weekly rows come from the table of the incremental ingest, not from
    the landed files. ``broken`` lists the payloads that can't be read.
    """
    tuned(spark)
    build = _new_build(spark, versions)
    paths = landing.compact(spark, root, out_dir, weekly=False)
    read = spark.read.parquet
    users, rosters = read(paths["users"]), read(paths["rosters"])
    buckets = buckets_for(spark, table or root)
    parsed = current_rows(spark, table).drop(*SOURCE_COLUMNS) if table else landing.weekly_parsed(spark, root)
    large = sb.large_leagues(rosters, large_league)
    if not large.isEmpty():
        parsed = sb.sliced(parsed, large)
    weekly = build.materialize(parsed, "weekly", place(parsed), buckets, exchange=True)
    flagged = landing.flagged_weeks(weekly)
    weekly_report = flagged.filter("in_report")
    beats, rank, raw = build_scoreboards(flagged, rosters, users, build, buckets)
    totals = build.materialize(dr.player_totals(dr.player_points_from_weekly(weekly_report)), "player_totals")
    out = all_reports(beats, rank, read(paths["picks"]), read(paths["players"]), totals,
                      rosters, users, weeks=weeks, n=n, per_league=per_league, build=build, buckets=buckets)
    out["broken"] = landing.broken_payloads(spark, root)
    out["scoreboard"] = beats
    out["scoreboard_rank"] = rank
    out["matchups_raw"] = raw
    out["league"] = read(paths["league"])
    if versions:
        build.commit()
    return out
