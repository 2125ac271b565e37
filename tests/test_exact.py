"""Exact sums, averages and standard deviations of any doubles, against whole fractions."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from huddle.functions import exact


def groups(seed=11):
    r = random.Random(seed)
    out = {
        "noise": [0.1 + 0.2, 1e-9, 1e12, -1e12, 0.1] * 40,
        "cancels": [1e300, 1.0, -1e300] * 7,
        "tiny": [5e-324, 2.5e-310, -5e-324, 1e-320],
        "wide": [r.choice([-1, 1]) * r.random() * 10.0 ** r.randint(-300, 300) for _ in range(400)],
        "scores": [round(r.random() * 200, 2) for _ in range(500)],
        "feed": [101.30000000000001, 98.7, 1 / 3, 2 / 3, 1e-7] * 9,
        "borders": [s * 2.0 ** (28 * k + d) * f for s in (1, -1) for k in (-30, -2, -1, 0, 1, 30) for d in (-1, 0, 1)
                    for f in (1.0, 1 - 2 ** -53, 1 + 2 ** -52)],
        "ties": [9007199254740992.0, 1.0, 9007199254740994.0, 1.0],
        "zero": [0.0, -0.0, 0.0], "one": [-7.25], "nulls": [None, None], "some": [None, 1.5, None, 2.25],
        "huge": [1.7e308, 1e308],
    }
    return out


def exact_sum(values):
    total = sum(map(Fraction, values))
    try:
        return total.numerator / total.denominator
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def exact_std(values):
    n = len(values)
    top = n * sum(Fraction(v) ** 2 for v in values) - sum(map(Fraction, values)) ** 2
    try:
        top = top.numerator / top.denominator
    except OverflowError:
        top = math.inf
    return math.sqrt(top / (float(n) * float(n)))


@pytest.mark.parametrize("parts", [1, 211])
def test_totals_equal_fsum_at_any_partitioning(spark, parts):
    data = groups()
    rows = [(k, v) for k, vs in data.items() for v in vs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.g: r for r in exact.summarise(df, ["g"], "x", spread=True).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g, values in data.items():
        known = [v for v in values if v is not None]
        assert got[g].n == len(known), g
        if not known:
            assert got[g].total is None and got[g].std is None
            continue
        assert got[g].total == exact_sum(known), g
        if g != "huge":
            assert got[g].total == math.fsum(known), g
        assert got[g].std == exact_std(known), g


def test_spread_far_from_its_mean(spark):
    r = random.Random(4)
    values = [1e6 + r.random() for _ in range(300)]
    got = exact.summarise(spark.createDataFrame([(v,) for v in values], "x double"), [], "x", spread=True).first()
    assert got.std == exact_std(values) and abs(got.std - 0.29) < 0.03


def test_what_is_not_finite(spark):
    inf, nan = math.inf, math.nan
    rows = [("a", inf), ("a", 1.0), ("b", inf), ("b", -inf), ("c", nan), ("c", 2.0), ("d", -inf), ("d", 1e300)]
    got = {r.g: r.total for r in exact.summarise(spark.createDataFrame(rows, "g string, x double"), ["g"], "x").collect()}
    assert got["a"] == inf and math.isnan(got["b"]) and math.isnan(got["c"]) and got["d"] == -inf


def test_plain_aggregates_beside_the_sum(spark):
    rows = [(1, 3, 0.5, 1), (1, 1, 1e-12, 0), (1, 2, None, 1), (None, 7, 4.0, 1), (None, None, 4.0, None)]
    df = spark.createDataFrame(rows, "g int, week int, x double, won int")
    got = exact.summarise(df, ["g"], "x", {"games": ("count", F.lit(1)), "won": ("sum", F.col("won")), "least": ("min", F.col("x")),
                                           "most": ("max", F.col("x")), "weeks": ("texts", F.col("week"))}).collect()
    assert {tuple(r) for r in got} == {(1, 2, 0.500000000001, 3, 2, 1e-12, 0.5, "1, 2, 3"), (None, 2, 8.0, 2, 1, 4.0, 4.0, "7")}
    empty = exact.summarise(df.filter("false"), ["g"], "x", spread=True)
    assert empty.count() == 0


def test_window_average_equals_grouped_average(spark):
    data = {k: v for k, v in groups(5).items() if k != "huge"}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "g string, x double").repartition(7)
    got = {(r.g, r.a) for r in exact.with_average(df, ["g"], "x", "a").collect()}
    want = {(k, exact_sum(known) / len(known) if (known := [v for v in vs if v is not None]) else None) for k, vs in data.items()}
    assert got == want
