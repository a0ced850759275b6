"""Exact values of the scalar functions and aggregates."""

import math

import pytest
from pyspark.sql import functions as F

from roadtrace.functions import geo, signals, stats, vectors


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def test_geo_round_trips(spark):
    e, n = geo.to_enu(28.6149, 77.2100, 28.6139, 77.2090)
    la, lo = geo.from_enu(e, n, 28.6139, 77.2090)
    assert one(spark, la, lo) == pytest.approx((28.6149, 77.2100), abs=1e-9)
    la, lo, al = geo.from_ned(100.0, 50.0, -10.0, 28.6139, 77.2090, 200.0)
    assert one(spark, *geo.to_ned(la, lo, al, 28.6139, 77.2090, 200.0)) == pytest.approx((100, 50, -10), abs=1e-6)


def test_angles(spark):
    b, c, d, w = one(spark, geo.bearing(1.0, 0.0), F.abs(geo.bearing(0.0, -1.0)), geo.wrap_deg(-10.0), geo.ang_diff(3.1, -3.1))
    assert (b, c, d) == pytest.approx((math.pi / 2, math.pi, 350))
    assert w == pytest.approx(2 * math.pi - 6.2)


@pytest.mark.parametrize("fix,want", [((1.0, 12, "3D", 40.0), ("GOOD", 1.0)), ((6.0, 6, "3D", 30.0), ("DEGRADED", 9.0)), ((99.0, 2, "none", 10.0), ("DENIED", 1e6))])
def test_gnss_quality(spark, fix, want):
    q = signals.gnss_quality(*[F.lit(x) for x in fix])
    assert one(spark, q["health"], q["scale"]) == want


def test_deadband_and_nulls(spark):
    got = one(spark, *[vectors.soft_deadband(F.lit(x), 0.15) for x in (0.1, 0.5, -0.5)], vectors.soft_deadband(F.lit(None).cast("double"), 0.15))
    assert got[:3] == pytest.approx((0, 0.35, -0.35))
    assert got[3] is None


@pytest.mark.parametrize("pitch,roll,yaw", [(30, 10, 45), (-20, 5, -120), (0, 0, 0), (60, -40, 170)])
def test_mount_angles_recovered(spark, pitch, roll, yaw):
    p, r, y = map(math.radians, (pitch, roll, yaw))
    forward = (math.cos(y) * math.cos(p), math.sin(y) * math.cos(p), -math.sin(p))
    up = (
        math.cos(y) * math.sin(p) * math.cos(r) + math.sin(y) * math.sin(r),
        math.sin(y) * math.sin(p) * math.cos(r) - math.cos(y) * math.sin(r),
        math.cos(p) * math.cos(r),
    )
    got = vectors.mount_angles(tuple(map(F.lit, up)), tuple(map(F.lit, forward)))
    assert one(spark, got["pitch"], got["roll"], got["yaw"]) == pytest.approx((pitch, roll, yaw), abs=1e-6)


def test_safe_corr_edges(spark):
    rows = [(float(i), float(i), float(-i), 5.0, None if i % 2 else float(i), float("nan")) for i in range(10)]
    df = spark.createDataFrame(rows, "x double, a double, b double, c double, h double, n double")
    got = df.agg(
        stats.safe_corr("x", "a"), stats.safe_corr("x", "b"), stats.safe_corr("x", "c"), stats.safe_corr("x", "h", 5), stats.safe_corr("x", "h", 6), stats.safe_corr("x", stats.finite("n"))
    ).head()
    assert got[:2] == pytest.approx((1, -1))
    assert got[2] is None and got[3] == pytest.approx(1) and got[4] is None and got[5] is None


def test_circular(spark):
    df = spark.createDataFrame([(3.1, 0.5), (-3.1, 0.5)], "a double, b double")
    m, r = df.agg(stats.circular_mean("a"), stats.circular_r("b")).head()
    assert abs(abs(m) - math.pi) < 0.01 and r == pytest.approx(1)


def test_nearest_rank_rounds_half_to_even(spark):
    df = spark.range(1, 7).withColumn("n", F.lit(6))
    got = [r["id"] for r in df.where(stats.nearest_rank(F.col("id"), F.col("n"), 0.5)).collect()]
    assert got == [3]  # 2.5 rounds to 2, counted from 0


def test_bad_text_is_null(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("x",), ("inf",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(stats.finite_number("t")).collect()] == [1.5, None, None, None, None]
    assert one(spark, signals.parse_phone_timestamp(F.lit("2020-01-01 10:00:00:5")))[0].microsecond == 500_000
    assert one(spark, signals.parse_phone_timestamp(F.lit("bad")))[0] is None


@pytest.mark.parametrize("path,want", [("a/(Driver B) x/S-1.csv", "B"), ("a/(Driver  )/S-1.csv", "unknown"), ("a/b.csv", "unknown")])
def test_driver_of(spark, path, want):
    assert one(spark, signals.driver_of(F.lit(path))) == (want,)


def test_a_variance_on_the_threshold_is_rounded_as_in_the_sql(spark):
    import duckdb

    from roadtrace.operators import features

    # each two values differ by 40, so their variance is 400 up to its last bit
    pairs = [(1.51, 41.51), (40.55, 0.55), (2.98, 42.98), (6.73, 46.73), (16.12, 56.12), (5.0, 45.0)]
    rows = [(str(i), t, x) for i, p in enumerate(pairs) for t, x in enumerate(p)]
    df = spark.createDataFrame(rows, "key string, row int, x double").withColumns({"t": F.col("row").cast("double"), "g": F.lit(0.0)})
    out = features.stationary(df, ["key"], "t", "x", "g", 10.0, 0.0, 2, 400.0, 100.0, 1.0).where("row = 1")
    want = duckdb.sql("SELECT key, var_pop(x) < 400 FROM (VALUES " + ", ".join(f"('{k}', {x}::DOUBLE)" for k, _, x in rows) + ") v(key, x) GROUP BY key").fetchall()
    assert {r["key"]: r["quiet"] for r in out.collect()} == dict(want) and len(set(dict(want).values())) == 2
