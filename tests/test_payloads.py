"""Null and broken payloads, exact scores, whole results, fresh reads."""

import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from huddle.functions.exact import average, summarise
from huddle.operators import leaderboards as lb
from huddle.operators import scoreboard as sb
from huddle.plans.pipeline import landing_pipeline
from huddle.sources import fixture as fx
from huddle.sources import landing
from huddle.streaming.ingest import compact_weekly, current_weekly, start_weekly_ingest


def land(root, league, name, value):
    path = os.path.join(root, f"league_id={league}", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


def base(root, league="A"):
    land(root, league, "users.json", [{"user_id": "u1"}, {"user_id": "u2", "metadata": {"team_name": "Two"}}])
    land(root, league, "rosters.json", [{"roster_id": 1, "owner_id": "u1"}, {"roster_id": 2, "owner_id": "u2"}])
    land(root, league, "league.json", {"name": league})
    land(root, league, "drafts.json", [{"draft_id": "d"}])
    land(root, league, "draft_id=d/picks.json", [{"pick_no": 1, "player_id": "p", "roster_id": 1}])
    with open(os.path.join(root, "players.json"), "w") as f:
        f.write(json.dumps({"p": {"full_name": "P", "position": "QB"}}))


def week(points, other=99.0):
    one = {"roster_id": 1, "matchup_id": 1}
    if points != "missing":
        one["points"] = points
    return [one, {"roster_id": 2, "matchup_id": 1, "points": other}]


def test_null_points_stay_null_and_missing_ones_are_zero(spark, tmp_path):
    root = str(tmp_path)
    base(root)
    for w, p in enumerate([71.0, None, 73.0, 75.0, "missing"], 1):
        land(root, "A", f"week={w}/matchups.json", week(p))
    rows = landing.weekly_season(spark, root)
    assert [r.points for r in rows.filter("roster_id = 1").orderBy("week").collect()] == [71.0, None, 73.0, 75.0, 0.0]
    m = sb.matchups(sb.matchups_raw(rows, landing.rosters(spark, root), landing.users(spark, root)), "rank")
    loss = lb.loss_points_profile(m.filter("week < 5")).filter("team_name = 'Team_1'").first()
    assert (loss.losses, loss.avg_points_in_loss, loss.min_loss) == (4, 73.0, 71.0)


def test_a_broken_week_stops_and_is_listed(spark, tmp_path):
    root = str(tmp_path / "in")
    base(root)
    for w in range(1, 7):
        land(root, "A", f"week={w}/matchups.json", week(50.0 + w))
    land(root, "A", "week=4/matchups.json", "[{\"roster_id\": 1,")
    land(root, "A", "week=18/matchups.json", week(60.0))
    weeks = lambda df: sorted({r.week for r in df.collect()})
    assert weeks(landing.weekly_season(spark, root)) == [1, 2, 3, 18]
    assert weeks(landing.weekly_report(spark, root)) == [1, 2, 3]
    bad = landing.broken_payloads(spark, root).collect()
    assert [(r.kind, r.league_id) for r in bad] == [("weekly", "A")] and bad[0].path.endswith("week=4/matchups.json")
    out = landing_pipeline(spark, root, str(tmp_path / "out"))
    assert out["broken"].count() == 1 and weeks(out["scoreboard"]) == [1, 2, 3]


def test_a_broken_fetch_never_replaces_a_good_one(spark, tmp_path):
    root, table, ck = (str(tmp_path / x) for x in ("in", "t", "ck"))
    base(root)

    def run():
        q = start_weekly_ingest(spark, root, table, checkpoint=ck)
        q.awaitTermination(300)
        assert q.exception() is None
    for w in (1, 2, 3):
        land(root, "A", f"week={w}/matchups-1.json", week(50.0 + w))
    run()
    time.sleep(1.1)
    land(root, "A", "week=2/matchups-2.json", "<html>error</html>")
    land(root, "A", "week=3/matchups-2.json", week(80.0))
    run()
    points = lambda df: [(r.week, r.points) for r in df.filter("roster_id = 1").orderBy("week").collect()]
    assert points(current_weekly(spark, table, stop_at_empty=True)) == [(1, 51.0), (2, 52.0), (3, 80.0)]
    compact_weekly(spark, table, str(tmp_path / "small"))
    assert points(current_weekly(spark, str(tmp_path / "small"))) == [(1, 51.0), (2, 52.0), (3, 80.0)]

    # the reports over the table are those over the final payloads
    final = str(tmp_path / "final")
    base(final)
    for w, p in ((1, 51.0), (2, 52.0), (3, 80.0)):
        land(final, "A", f"week={w}/matchups.json", week(p))
    a = landing_pipeline(spark, root, str(tmp_path / "o1"), table=table)
    b = landing_pipeline(spark, final, str(tmp_path / "o2"))
    for name in ("standings", "head_to_head", "top_scores", "win_points_profile", "scoreboard_rank"):
        assert sorted(map(repr, a[name].collect())) == sorted(map(repr, b[name].collect())), name


def test_scores_are_never_rounded(spark):
    df = spark.createDataFrame([(1, 1.005), (1, 1.005), (2, 0.125), (2, 0.125), (3, 0.004), (3, None), (4, 1.0 / 3)], "g int, x double")
    got = {r.g: r.a for r in summarise(df, ["g"], "x").select("g", average().alias("a")).collect()}
    assert got == {1: 1.005, 2: 0.125, 3: 0.004, 4: 1.0 / 3}


def test_a_noisy_score_does_not_end_the_run(spark, tmp_path):
    root = str(tmp_path / "in")
    base(root)
    noisy = [101.30000000000001, 1e-9, 0.1 + 0.2]
    for w, p in enumerate(noisy, 1):
        land(root, "A", f"week={w}/matchups.json", week(p))
    out = landing_pipeline(spark, root, str(tmp_path / "out"))
    loss = out["loss_points_profile"].filter("team_name = 'Team_1'").first()
    assert loss.avg_points_in_loss == math.fsum([noisy[1], noisy[2]]) / 2 and loss.min_loss == 1e-9


def test_few_files_from_many_tasks(spark, tmp_path):
    from huddle.plans.versions import Build
    df = spark.range(0, 4000, numPartitions=60).select((F.col("id") % 97).alias("league_id"), "id")
    out = Build(spark).materialize(df, "many", "league_id", 8, exchange=True)
    assert len({r[0] for r in out.select(F.input_file_name()).distinct().collect()}) <= 8 and out.count() == 4000


def test_top_players_are_found_once(spark, tmp_path):
    root = str(tmp_path / "in")
    base(root)
    land(root, "A", "week=1/matchups.json", week(50.0))
    out = landing_pipeline(spark, root, str(tmp_path / "out"))
    for name in ("scoreboard", "scoreboard_rank"):
        plan = out[name]._jdf.queryExecution().toString()
        assert "players_points" not in plan


def test_sql_writes_its_whole_result(spark, tmp_path):
    from huddle.__main__ import main
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    base(root)
    land(root, "A", "week=1/matchups.json", week(50.0))
    assert main(["sql", "--landing", root, "--out", out, "SELECT x.id, m.week FROM (SELECT explode(sequence(1, 1000)) AS id) x "
                 "JOIN matchups m ON m.roster_id = 1"]) == 0
    assert spark.read.parquet(f"{out}/sql").count() == 1000


def test_reads_see_appended_rows(spark, tmp_path):
    path = str(tmp_path / "part.parquet")
    cols = "p_partkey long, p_retailprice double"
    spark.createDataFrame([(i, 1.0) for i in range(10)], cols).write.parquet(path)
    assert fx.picks(spark, str(tmp_path)).count() == 10
    spark.createDataFrame([(i, 1.0) for i in range(10, 15)], cols).write.mode("append").parquet(path)
    assert fx.picks(spark, str(tmp_path)).count() == 15


def test_weekly_reports_read_their_weeks_only(spark):
    from huddle.plans.registry import QUERIES
    plan = QUERIES["q09_standings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
