"""Reports after new weeks: only leagues whose data changed are worked on.

    store = Versions(spark, "/shared/store")
    start_newest_ingest(spark, landing, table).awaitTermination()
    out = refresh(spark, landing, compacted, table, store)      # a full build where nothing was built before

A version notes up to which batch of ``streaming.newest`` it has read. The next build
reads the batches after that alone; the leagues in them, and those whose users, rosters or
picks differ from the version's (by a digest a league), are *changed*. All tables are keyed by
league, so the rows of the changed leagues are computed from their weeks and replace the old ones in the
parts that hold them (``Build.replace``); every other part is referred to where it lies.

Everything is built anew where that is not enough: without a version, where the player catalog
or the layout (number of buckets, leagues large enough to be spread) differs, or if the version has read batches
that the table doesn't have.

Defined results: the reports are those of a full build over the same payloads; with nothing new
no version is added and the reports are the last one's; a league that lost its rosters or
users is changed, and keeps its weeks; a league without weeks has no scoreboard rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huddle.operators import draft as dr
from huddle.operators import scoreboard as sb
from huddle.operators.common import LEAGUE, place
from huddle.plans.pipeline import Reports
from huddle.plans.report import run_draft_report, run_report, run_season_stats
from huddle.plans.versions import Build, Versions, buckets_for
from huddle.session import tuned
from huddle.sources import landing
from huddle.streaming.ingest import SOURCE_COLUMNS
from huddle.streaming.newest import batch_rows, finished_batches


def _digest(df: DataFrame, keys: list[str], maps: tuple[str, ...] = ()) -> DataFrame:
    """How many rows there are for each key and what they add up to, in any order of rows and map entries."""
    plain = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in df.columns]
    # as JSON with nulls written out: a hash of columns leaves nulls out
    row = F.xxhash64(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("digest"))


def league_digests(users: DataFrame, rosters: DataFrame, picks: DataFrame) -> DataFrame:
    """(league_id, kind, n, digest) of what the scoreboard and the draft reports take beside the weeks."""
    kinds = {"users": _digest(users, [LEAGUE], ("metadata",)), "rosters": _digest(rosters, [LEAGUE]),
             "picks": _digest(picks, [LEAGUE])}
    out = None
    for kind, df in kinds.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


def changed_leagues(new: DataFrame, now: DataFrame, before: DataFrame) -> DataFrame:
    """(league_id): leagues with new weekly rows, or with digests that are in one of ``now`` and ``before`` only."""
    columns = [LEAGUE, "kind", "n", "digest"]
    a, b = now.select(columns), before.select(columns)
    differ = a.join(b, columns, "left_anti").unionByName(b.join(a, columns, "left_anti"))
    return new.select(LEAGUE).unionByName(differ.select(LEAGUE)).distinct()


def _weeks(versions: Versions, old: int, changed: DataFrame, new: DataFrame) -> DataFrame:
    """All weeks of the changed leagues: the version's, but for those that were taken anew."""
    held = versions.read("weekly", old).select(new.columns).join(changed, LEAGUE, "left_semi")
    return landing.merge_weeks(held, new)


def update(spark: SparkSession, root: str, out_dir: str, table: str, versions: Versions,
           large_league: int = sb.LARGE_LEAGUE) -> tuple[int, DataFrame | None]:
    """Brings the tables of ``versions`` up to the newest payloads.

    ``root``: landed users, rosters, drafts, picks and catalog, compacted to ``out_dir``;
    ``table``: weekly rows of ``streaming.newest``. Returns the current version and the leagues
    worked on (None after a full build).
    """
    tuned(spark)
    paths = landing.compact(spark, root, out_dir, weekly=False)
    users, rosters, picks, players = (spark.read.parquet(paths[k]) for k in ("users", "rosters", "picks", "players"))
    catalog = list(_digest(players, [], ("attrs",)).first())
    batches = finished_batches(spark, table)
    upto = batches[-1] if batches else -1
    large = sb.large_leagues(rosters, large_league)
    spread = not large.isEmpty()
    old = versions.current()
    last = versions.notes(old) if old is not None else {}
    layout = {"buckets": last.get("buckets") or buckets_for(spark, table), "spread": spread, "catalog": catalog}
    if any(last.get(k) != v for k, v in layout.items()) or last["batch"] > upto:
        old, layout["buckets"] = None, buckets_for(spark, table)
    digests = league_digests(users, rosters, picks)

    with versions.build() as build:
        new = batch_rows(spark, table, last["batch"] if old is not None else -1, upto).drop(*SOURCE_COLUMNS)
        changed = None
        if old is not None:
            # read by every table's replacement, so written once
            changed = build.materialize(changed_leagues(new, digests, versions.read("digests", old)), "changed")
            if not build.row_counts()["changed"]:
                return old, spark.createDataFrame([], changed.schema)
            new = _weeks(versions, old, changed, new)
        _write(build, new, users, rosters, picks, players, digests, large if spread else None, layout["buckets"], changed, old)
        build.notes = {**layout, "batch": upto}
        number = build.commit()
    return number, None if changed is None else versions.read("changed", number)


def refresh(spark: SparkSession, root: str, out_dir: str, table: str, versions: Versions,
            weeks: tuple[int, int] = (1, 14), n: int = 10, per_league: bool = True,
            large_league: int = sb.LARGE_LEAGUE) -> Reports:
    """``update``, and all reports over its tables; ``changed`` lists the leagues worked on (None after a full build)."""
    number, changed = update(spark, root, out_dir, table, versions, large_league)
    return _reports(versions, number, weeks, n, per_league, changed)


def _write(build: Build, rows: DataFrame, users: DataFrame, rosters: DataFrame, picks: DataFrame, players: DataFrame,
           digests: DataFrame, large: DataFrame | None, buckets: int, changed: DataFrame | None, old: int | None) -> None:
    """Every table, of the changed leagues or of all."""
    def keep(df: DataFrame, name: str, exchange: bool = True) -> DataFrame:
        return build.replace(df, name, place(df), buckets, changed, old, exchange=exchange)

    def own(df: DataFrame) -> DataFrame:
        return df if changed is None else df.join(changed, LEAGUE, "left_semi")

    users, rosters, picks = own(users), own(rosters), own(picks)
    weekly = keep(sb.sliced(rows, large) if large is not None else rows, "weekly")
    flags = ("in_report", "in_season")
    flagged = landing.flagged_weeks(weekly)
    raw = keep(sb.matchups_raw(flagged, rosters, users, flags), "matchups_raw", exchange=large is not None)
    keep(sb.matchups(raw.filter("in_report").drop(*flags), "beats"), "scoreboard_beats", exchange=False)
    keep(sb.matchups(raw.filter("in_season").drop(*flags), "rank"), "scoreboard_rank", exchange=False)
    totals = keep(dr.player_totals(dr.player_points_from_weekly(flagged.filter("in_report"))), "player_totals")
    keep(dr.enrich_picks(picks, players, totals, rosters, users), "picks_enriched")
    keep(own(digests), "digests")


def _reports(versions: Versions, number: int, weeks, n: int, per_league: bool, changed: DataFrame | None) -> Reports:
    beats, rank = versions.read("scoreboard_beats", number), versions.read("scoreboard_rank", number)
    totals, enriched = versions.read("player_totals", number), versions.read("picks_enriched", number)
    out = Reports()
    out.update(run_season_stats(rank, n, per_league))
    out.update(run_report(beats, weeks, n, per_league))
    out.update(run_draft_report(None, None, None, None, None, n, per_league, enriched=enriched))
    out.update({"scoreboard": beats, "scoreboard_rank": rank, "player_totals": totals})
    out["changed"] = changed
    return out
