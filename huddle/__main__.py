"""Command line: run every report over landed payloads, or ad-hoc SQL.

    spark-submit -m huddle report --landing /shared/landing --out /shared/reports
    python -m huddle report --landing DIR --out DIR --show standings
    python -m huddle sql --landing DIR --out DIR "SELECT ... FROM matchups ..."
    python -m huddle ingest --landing DIR --table DIR   (new weekly files only)
    python -m huddle report --landing DIR --out DIR --table DIR   (weeks from the ingest's table)
    python -m huddle tables --sf-dir DIR --out DIR      (the driver's test tables)

``report`` compacts the payloads, builds the scoreboards once and writes each
report as a parquet table under ``--out/reports/<name>``. ``sql`` runs one
statement over the scoreboard view ``matchups``, writes its whole result to
``--out/sql`` and prints a sample of it.
"""

from __future__ import annotations

import argparse
import sys

from huddle.functions.display import ORDERS, ordered
from huddle.plans.pipeline import landing_pipeline
from huddle.plans.report import RAW_VIEW, SCOREBOARD_VIEW, adhoc
from huddle.plans.versions import Versions
from huddle.session import get_spark


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="huddle")
    sub = ap.add_subparsers(dest="cmd", required=True)
    rep = sub.add_parser("report", help="write every report as parquet")
    sql = sub.add_parser("sql", help="ad-hoc SQL over the scoreboard view 'matchups'")
    tab = sub.add_parser("tables", help="every report over the test tables (FIXTURES.md part B)")
    tab.add_argument("--sf-dir", required=True, help="folder with events/customer/part/lineitem")
    tab.add_argument("--out", required=True, help="output folder for the reports")
    tab.add_argument("--show", nargs="*", default=[], help="reports to print (a sample)")
    ing = sub.add_parser("ingest", help="append newly landed weekly payloads to a table")
    ing.add_argument("--landing", required=True, help="root of the landed payloads")
    ing.add_argument("--table", required=True, help="append-only weekly table (parquet)")
    ing.add_argument("--newest", action="store_true",
                     help="keep only payloads that are the newest of their week (for report --refresh)")
    ing.add_argument("--checkpoint", default=None,
                     help="stream checkpoint (default: under spark.checkpoint.dir)")
    for p in (rep, sql):
        p.add_argument("--landing", required=True, help="root of the landed payloads")
        p.add_argument("--out", required=True, help="output folder (compacted tables, reports)")
        p.add_argument("--table", default=None,
                       help="weekly table of the ingest command, read in place of landed weekly files")
    rep.add_argument("--refresh", action="store_true",
                     help="with --store and a --table of ingest --newest: work on the leagues that changed only")
    for p in (rep, sql):
        p.add_argument("--store", default=None, help="folder of versions: the written tables become the next one")
    rep.add_argument("--show", nargs="*", default=[], help="reports to print (a sample)")
    rep.add_argument("--weeks", nargs=2, type=int, default=[1, 14], metavar=("FIRST", "LAST"),
                     help="completed-week range of the weekly report (default 1 14)")
    rep.add_argument("--top", type=int, default=10, help="size of the top-n lists")
    rep.add_argument("--across-leagues", action="store_true",
                     help="top-n lists over all leagues instead of within each league")
    sql.add_argument("statement")
    args = ap.parse_args(argv)

    spark = get_spark()
    if args.cmd == "ingest":
        from huddle.streaming.ingest import start_weekly_ingest
        from huddle.streaming.newest import start_newest_ingest
        if args.newest:
            q = start_newest_ingest(spark, args.landing, args.table)
        else:
            q = start_weekly_ingest(spark, args.landing, args.table, checkpoint=args.checkpoint)
        q.awaitTermination()
        print(q.lastProgress and {"rows": q.lastProgress.get("numInputRows")})
        return 0 if q.exception() is None else 1
    if args.cmd == "tables":
        from huddle.plans.pipeline import fixture_pipeline
        reports = fixture_pipeline(spark, args.sf_dir, write=True)
        try:
            for name, df in reports.items():
                df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/reports/{name}")
            print(reports.build.row_counts())
            for name in args.show:
                df = reports[name]
                (ordered(df, name) if name in ORDERS else df).show(50, truncate=False)
            return 0
        finally:
            reports.close()
    if getattr(args, "refresh", False) and not (args.store and args.table):
        ap.error("--refresh needs --store and --table")
    out = args.out.rstrip("/")
    store = Versions(spark, args.store) if args.store else None
    reports = None
    try:
        weeks = tuple(getattr(args, "weeks", (1, 14)))
        if getattr(args, "refresh", False):
            from huddle.plans.refresh import refresh
            reports = refresh(spark, args.landing, f"{out}/compacted", args.table, store, weeks, args.top, not args.across_leagues)
            changed = reports.pop("changed")
            for name, df in reports.items():
                df.write.mode("overwrite").parquet(f"{out}/reports/{name}")
            print({"version": store.current(), "leagues": "all" if changed is None else changed.count()})
            for name in args.show:
                df = reports[name]
                (ordered(df, name) if name in ORDERS else df).show(50, truncate=False)
            return 0
        reports = landing_pipeline(spark, args.landing, f"{out}/compacted", weeks=weeks,
                                   n=getattr(args, "top", 10),
                                   per_league=not getattr(args, "across_leagues", False),
                                   table=getattr(args, "table", None), versions=store)
        if args.cmd == "report":
            for name, df in reports.items():
                df.write.mode("overwrite").parquet(f"{out}/reports/{name}")
            print(reports.build.row_counts())
            for name in args.show:
                df = reports[name]
                (ordered(df, name) if name in ORDERS else df).show(50, truncate=False)
        else:
            res = adhoc(spark, args.statement, reports["scoreboard"], reports["matchups_raw"])
            if res is None:
                return 1
            # the whole result is written; what is printed is a preview
            res.write.mode("overwrite").parquet(f"{out}/sql")
            spark.read.schema(res.schema).parquet(f"{out}/sql").show(50, truncate=False)
            print(f"whole result: {out}/sql")
        return 0
    finally:
        if reports:
            reports.close()
        if store:
            store.close()
        spark.catalog.dropTempView(SCOREBOARD_VIEW)
        spark.catalog.dropTempView(RAW_VIEW)


if __name__ == "__main__":
    sys.exit(main())
