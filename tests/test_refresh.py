"""The stream of newest payloads, and builds that work on changed leagues only."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from huddle.plans import versions as vs
from huddle.plans.pipeline import landing_pipeline
from huddle.plans.refresh import changed_leagues, league_digests, refresh, update
from huddle.plans.versions import PART, Versions
from huddle.streaming.ingest import current_rows, start_weekly_ingest
from huddle.streaming.newest import batch_rows, finished_batches, start_newest_ingest

LEAGUES = [f"L{i}" for i in range(12)]
CLOCK = 1_700_000_000


def land(root, league, name, value, at=None):
    path = os.path.join(root, f"league_id={league}", name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))
    if at is not None:
        os.utime(path, (CLOCK + at, CLOCK + at))


def week(rng):
    return [{"roster_id": r, "matchup_id": (r + 1) // 2, "points": rng.randint(50, 150) / 2, "players": ["p1", "p2"],
             "players_points": {"p1": rng.randint(0, 40) / 2, "p2": rng.randint(0, 40) / 2}} for r in (1, 2, 3, 4)]


def base(root, leagues=LEAGUES):
    for league in leagues:
        land(root, league, "users.json", [{"user_id": f"u{r}", "metadata": {"team_name": f"{league}-{r}"}} for r in (1, 2, 3)])
        land(root, league, "rosters.json", [{"roster_id": r, "owner_id": f"u{r}"} for r in (1, 2, 3, 4)])
        land(root, league, "league.json", {"name": league})
        land(root, league, "drafts.json", [{"draft_id": "d"}])
        land(root, league, "draft_id=d/picks.json", [{"pick_no": k, "player_id": f"p{k}", "roster_id": k} for k in (1, 2, 120)])
    with open(os.path.join(root, "players.json"), "w") as f:
        json.dump({f"p{k}": {"full_name": f"P{k}", "position": "RB"} for k in (1, 2, 120)}, f)


def take(spark, root, table, **kw):
    q = start_newest_ingest(spark, root, table, **kw)
    q.awaitTermination(300)
    assert q.exception() is None


def content(df):
    return sorted(repr(r) for r in df.select(sorted(df.columns)).collect())


def test_the_stream_takes_what_the_whole_history_gives(spark, tmp_path):
    root, table, every, ck = (str(tmp_path / x) for x in ("in", "newest", "every", "ck"))
    rng, clock = random.Random(5), list(range(1, 200))
    rng.shuffle(clock)                                   # files arrive in another order than they were fetched
    n = 0
    for _ in range(2):
        for _ in range(24):
            kind = rng.random()
            value = "<html>" if kind < 0.25 else [] if kind < 0.4 else week(rng)
            # every fourth file has the time of another one
            land(root, rng.choice("AB"), f"week={rng.randint(1, 4)}/matchups-{n}.json", value, clock[n - n % 4])
            n += 1
        take(spark, root, table, max_files_per_trigger=12)
        q = start_weekly_ingest(spark, root, every, checkpoint=ck)
        q.awaitTermination(300)
        want = current_rows(spark, every)
        assert content(batch_rows(spark, table).select(want.columns)) == content(want)
    # fewer rows were passed on than landed, and the last batches alone hold the last changes
    assert sum(spark.read.parquet(f"{table}/batch={b}").count() for b in finished_batches(spark, table)) < spark.read.parquet(every).count()
    last = finished_batches(spark, table)[-1]
    assert content(batch_rows(spark, table, after=last - 1)) == content(
        spark.read.schema(batch_rows(spark, table).schema).parquet(f"{table}/batch={last}"))
    assert batch_rows(spark, table, after=last).isEmpty()


def test_an_unfinished_batch_is_not_read(spark, tmp_path):
    root, table = str(tmp_path / "in"), str(tmp_path / "t")
    assert batch_rows(spark, table).isEmpty()
    land(root, "A", "week=1/matchups-1.json", week(random.Random(1)))
    take(spark, root, table)
    assert batch_rows(spark, table).count() == 4
    shutil.copytree(f"{table}/batch=0", f"{table}/batch=1")     # written, but not marked
    assert finished_batches(spark, table) == [0] and batch_rows(spark, table).count() == 4


def test_changed_leagues_by_digests(spark):
    users = spark.createDataFrame([("A", "u", {"x": None, "y": "1"}), ("B", "u", {"x": "y"}), ("C", "u", None)],
                                  "league_id string, user_id string, metadata map<string,string>")
    rosters = spark.createDataFrame([(x, 1, None) for x in "ABC"], "league_id string, roster_id int, owner_id string")
    picks = spark.createDataFrame([], "league_id string, ord int, pick_no int, player_id string, roster_id int")
    none = spark.createDataFrame([], "league_id string")
    before = league_digests(users, rosters, picks)
    same = users.withColumn("metadata", F.map_from_entries(F.reverse(F.map_entries("metadata"))))
    assert changed_leagues(none, league_digests(same, rosters, picks), before).isEmpty()
    other = users.filter("league_id <> 'C'").withColumn(
        "metadata", F.when(F.col("league_id") == "A", F.create_map(F.lit("x"), F.lit("y"), F.lit("1"), F.lit(None))).otherwise(F.col("metadata")))
    now = league_digests(other, rosters, picks)
    assert {r[0] for r in changed_leagues(none, now, before).collect()} == {"A", "C"}
    assert {r[0] for r in changed_leagues(spark.createDataFrame([("Z",)], "league_id string"), before, before).collect()} == {"Z"}


TABLES = ("weekly", "matchups_raw", "scoreboard_beats", "scoreboard_rank", "player_totals", "picks_enriched", "digests")


def ids(df):
    return sorted(r[0] for r in df.collect())


def same_tables(spark, v, root, table, tmp_path, large):
    """Every table is what a full build over all that was ever taken gives."""
    whole = Versions(spark, str(tmp_path))
    assert update(spark, root, f"{tmp_path}-c", table, whole, large) == (1, None)
    for name in TABLES:
        assert content(v.read(name)) == content(whole.read(name)), name
    whole.close()


@pytest.mark.parametrize("large", [10_000, 3])          # 3: every league is spread by week
def test_a_refetched_week_rebuilds_its_league_only(spark, tmp_path, large):
    root, table, store = (str(tmp_path / x) for x in ("in", "t", "store"))
    rng = random.Random(large)
    base(root)
    for league in LEAGUES:
        for w in (1, 2):
            land(root, league, f"week={w}/matchups-1.json", week(rng), at=w)
    take(spark, root, table)
    v = Versions(spark, store, keep=1)
    step = lambda: update(spark, root, str(tmp_path / "c"), table, v, large)
    assert step() == (1, None) and v.read("scoreboard_rank").count() == 4 * 2 * len(LEAGUES)

    land(root, "L5", "week=2/matchups-2.json", week(rng), at=9)
    take(spark, root, table)
    number, changed = step()
    assert ids(changed) == ["L5"] and v.numbers() == [number] == [2]
    # what was read of the weekly rows: one file's payload; what was written: the parts of L5
    assert {(r.league_id, r.week) for r in batch_rows(spark, table, after=0).collect()} == {("L5", 2)}
    for name, t in v.tables().items():
        if "parts" in t:
            new = {int(p) for p, at in t["parts"].items() if at == 2}
            mine = ids(v.read(name, with_part=True).filter("league_id = 'L5'").select(PART).distinct())
            assert sorted(new) == mine and len(new) < len(t["parts"]), name
    # the older version is gone but for the parts that are still referred to
    assert os.listdir(f"{store}/manifests") and not os.path.exists(f"{store}/manifests/000000000001.json")
    left = {p for p in os.listdir(f"{store}/data/000000000001/weekly") if p.startswith(PART)}
    assert left == {f"{PART}={p}" for p, at in v.tables()["weekly"]["parts"].items() if at == 1}

    # nothing new: no version
    number, changed = step()
    assert number == 2 and changed.isEmpty() and v.numbers() == [2]

    # a new league, one whose names changed, one that lost its rosters, and an emptied week
    base(root, ["NEW"])
    land(root, "NEW", "week=1/matchups-1.json", week(rng), at=10)
    land(root, "L1", "users.json", [{"user_id": "u1", "metadata": {"team_name": "renamed"}}])
    os.remove(f"{root}/league_id=L2/rosters.json")
    land(root, "L3", "week=2/matchups-3.json", [], at=11)
    take(spark, root, table)
    assert ids(step()[1]) == ["L1", "L2", "L3", "NEW"]
    same_tables(spark, v, root, table, tmp_path / "whole", large)
    v.close()


def test_a_killed_refresh_leaves_the_version_and_its_parts(spark, tmp_path, monkeypatch):
    root, table, store = (str(tmp_path / x) for x in ("in", "t", "store"))
    rng = random.Random(2)
    base(root, ["A", "B"])
    for league in "AB":
        land(root, league, "week=1/matchups.json", week(rng), at=1)
    take(spark, root, table)
    v = Versions(spark, store, keep=1)
    compacted = str(tmp_path / "c")
    out = refresh(spark, root, compacted, table, v)
    landed = landing_pipeline(spark, root, str(tmp_path / "lc"))     # the same payloads, without stream and versions
    for name in ("standings", "head_to_head", "late_round_steals", "win_points_profile"):
        assert content(out[name]) == content(landed[name]), name
    landed.close()
    land(root, "A", "week=2/matchups.json", week(rng), at=2)
    take(spark, root, table)

    def ended(self):
        raise KeyboardInterrupt
    monkeypatch.setattr(vs.Build, "commit", ended)
    with pytest.raises(KeyboardInterrupt):
        update(spark, root, compacted, table, v)
    monkeypatch.undo()
    assert v.numbers() == [1] and v.read("scoreboard_beats").count() == 8
    _, changed = update(spark, root, compacted, table, v)
    assert ids(changed) == ["A"] and v.read("scoreboard_beats").count() == 12
    # another catalog concerns every league
    with open(os.path.join(root, "players.json"), "w") as f:
        json.dump({"p1": {"full_name": "Other", "position": "WR"}}, f)
    assert update(spark, root, compacted, table, v)[1] is None
    v.close()


def test_scans_of_a_version_in_parts_keep_the_buckets(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "s"))
    df = spark.range(200).select((F.col("id") % 40).cast("string").alias("league_id"), "id")
    with v.build() as build:
        build.replace(df, "board", ["league_id"], 8)
        build.commit()
    with v.build() as build:
        one = df.filter("league_id = '7'")
        build.replace(one.withColumn("id", F.col("id") + 1000), "board", ["league_id"], 8, one.select("league_id").distinct(), 1)
        build.commit()
    got = v.read("board")
    assert got.count() == 200 and got.filter("id >= 1000").count() == 5 and set(v.tables()["board"]["parts"].values()) == {1, 2}
    plan = got.groupBy("league_id").count()
    assert plan.count() == 40 and "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    v.close()
