"""Versions of written tables: all or nothing, killed runs, what is deleted."""

import os

import pytest
from pyspark.sql import functions as F

from huddle.plans.pipeline import fixture_pipeline
from huddle.plans.versions import Build, Versions

SF_DIR = os.environ.get("HUDDLE_TEST_SF", "/root/testdata/sf0.001")


def frame(spark, n, tag):
    return spark.range(n).select((F.col("id") % 5).alias("league_id"), F.col("id"), F.lit(tag).alias("tag"))


def add(v, n, tag, commit=True):
    build = v.build()
    build.materialize(frame(v.spark, n, tag), "board", "league_id", 4, exchange=True)
    build.materialize(frame(v.spark, n, tag), "plain")
    if commit:
        build.commit()
        build.close()
    return build


def tags(v, number=None):
    return {(r.tag, t) for t in ("board", "plain") for r in v.read(t, number).select("tag").distinct().collect()}


def files(root):
    return sorted(os.listdir(f"{root}/data"))


def test_a_killed_build_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "store")
    v = Versions(spark, root, keep=1)
    assert v.current() is None
    with pytest.raises(LookupError):
        v.read("board")
    add(v, 100, "one")
    killed = add(v, 50, "half", commit=False)          # ended between write and switch: no close either
    later = Versions(spark, root, keep=1)              # another session
    assert later.current() == 1 and tags(later) == {("one", "board"), ("one", "plain")}
    assert len(files(root)) == 2
    third = add(later, 70, "three")
    assert third.number == 3 > killed.number and tags(v) == {("three", "board"), ("three", "plain")}
    assert files(root) == ["000000000003"] and [n for n in os.listdir(f"{root}/manifests") if n[0] != "."] == ["000000000003.json"]
    assert later.read("board").count() == later.tables()["board"]["rows"] == 70


def test_a_half_written_manifest_is_not_a_version(spark, tmp_path):
    root = str(tmp_path / "store")
    v = Versions(spark, root)
    add(v, 10, "one")
    with open(f"{root}/manifests/000000000002.json.0badcafe.tmp", "w") as f:
        f.write('{"tables"')
    assert v.numbers() == [1] and tags(v) == {("one", "board"), ("one", "plain")}


def test_kept_versions_stay_readable(spark, tmp_path):
    root = str(tmp_path / "store")
    v = Versions(spark, root, keep=2)
    for i in range(1, 5):
        add(v, 10 * i, f"v{i}")
    assert v.numbers() == [3, 4] and files(root) == ["000000000003", "000000000004"]
    assert tags(v, 3) == {("v3", "board"), ("v3", "plain")} and v.read("plain", 3).count() == 30


def test_numbers_are_never_given_twice(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    a, b = v.build(), v.build()
    assert (a.number, b.number) == (1, 2) and not v.root.claim("claims/000000000002")
    for build, tag in ((b, "later"), (a, "earlier")):      # the one that began first ends last
        build.materialize(frame(spark, 5, tag), "plain")
        build.commit()
    assert v.current() == 2 and {r.tag for r in v.read("plain").collect()} == {"later"}


def test_read_back_tables_are_bucketed(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "store"))
    add(v, 1000, "one")
    df = Versions(spark, str(tmp_path / "store")).read("board").groupBy("league_id", "id").count()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1000
    v.close()


def test_a_run_leaves_nothing_behind(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    with Build(spark, str(tmp_path / "run")) as build:
        build.materialize(frame(spark, 10, "x"), "board", "league_id", 2, exchange=True)
        build.materialize(frame(spark, 0, "x"), "empty")
        assert build.row_counts() == {"board": 10, "empty": 0}
        with pytest.raises(ValueError):
            build.commit()
    assert {t.name for t in spark.catalog.listTables()} == before and not os.path.exists(tmp_path / "run")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables missing")
def test_reports_from_a_version_equal_those_of_the_run(spark, tmp_path):
    from huddle.plans.report import run_report
    v = Versions(spark, str(tmp_path / "store"))
    out = fixture_pipeline(spark, SF_DIR, versions=v)
    want = sorted(map(repr, out["head_to_head"].collect()))
    out.close()
    again = Versions(spark, str(tmp_path / "store"))
    got = run_report(again.read("scoreboard_beats"))["head_to_head"]
    assert sorted(map(repr, got.collect())) == want and want
    again.close()
