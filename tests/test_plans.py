"""The three workloads end to end on a small made-up fleet."""

import math

import pytest
from pyspark.sql import functions as F

from roadtrace.plans import prepare, score, stream
from roadtrace.sources import sinks


@pytest.fixture(scope="module")
def fleet(spark):
    rows = []
    for driver, key, n in (("A", "1", 120), ("A", "2", 80), ("B", "3", 90), ("C", "4", 60)):
        for i in range(n):
            t = i * 0.1 + (5.0 if i >= 50 else 0.0)  # a gap in every drive
            rows.append((driver, key, i, t, 36 + 3 * math.sin(i / 7), 52.0 + i * 1e-5, -1.5))
    phone = spark.createDataFrame(rows, "driver_id string, session_key string, row_idx long, phone_t double, phone_speed_kmh double, lat double, lon double")
    vehicle = phone.select("driver_id", "session_key", "row_idx", F.col("phone_t").alias("vehicle_t"), F.col("phone_speed_kmh").alias("velocity_kmh"), F.col("lat").alias("vehicle_lat"), F.col("lon").alias("vehicle_lon"))
    return phone, vehicle


def test_prepare_and_score(spark, fleet, tmp_path):
    t = prepare.Thresholds(min_rows=20, history=5, horizons=(2,), blackouts=(1, 2))
    p = prepare.prepare(*fleet, t=t)
    sinks.write_sessions(p.archive, str(tmp_path / "archive"), order="archive_row")
    assert spark.read.parquet(str(tmp_path / "archive")).count() == p.archive.count() == 340  # the last run of drive 4 is too short
    assert p.segments.count() == 7 and p.failures.isEmpty()
    assert {r["driver_id"]: r["driver_holdout_split"] for r in p.sessions.collect()} == {"A": "train", "B": "validation", "C": "test"}
    assert all(r["quality"] == "strong" for r in p.audit.collect())
    found, lags = prepare.audit(*fleet, 3)
    assert all(r["best_lag"] == 0 and r["quality"] == "verified_row_alignment" for r in lags.collect()) and found.count() == 4
    archive = p.archive.withColumns({"v": F.col("velocity_kmh") / 3.6, "d": F.lit(0.0)})
    scores, samples, summary = score.score_blackouts(archive, p.segments, [1, 2], 5, 5, "v", "vehicle_t", "d")
    by = {(r["model"], r["duration"]): r for r in summary.collect()}
    assert set(by) == {(m, d) for m in ("model", "hold_last_speed") for d in (1, 2)}
    # a model without change is the baseline
    assert by["model", 1]["velocity_mae_kmh"] == pytest.approx(by["hold_last_speed", 1]["velocity_mae_kmh"])
    assert by["model", 1]["episodes"] == sum(len(range(5, n - 10, 10)) for n in (50, 70, 50, 30, 50, 40, 50))
    assert score.representative_episodes(scores).count() == 4
    from roadtrace.operators import aggregates

    pooled = {(r["model"], r["duration"]): r for r in aggregates.summarize_blackouts(scores, None, ["model", "duration"]).collect()}
    for k, r in by.items():
        assert [pooled[k][c] for c in ("velocity_mae_kmh", "velocity_rmse_kmh", "within_5_kmh_percent")] == pytest.approx([r[c] for c in ("velocity_mae_kmh", "velocity_rmse_kmh", "within_5_kmh_percent")])


def test_prepare_with_offset_reports_what_is_wrong(spark, fleet):
    phone, vehicle = fleet
    offsets = phone.select("driver_id", "session_key").distinct().withColumn("offset", F.lit(2))
    t = prepare.Thresholds(min_rows=20, history=5, horizons=(2,))
    p = prepare.prepare(phone, vehicle, offsets, t=t)
    assert p.failures.isEmpty() and {r["offset_rows"] for r in p.sessions.collect()} == {2}
    from roadtrace.operators import validate

    bad = p.archive.withColumn("velocity_kmh", F.when(F.col("archive_row") == 10, 500.0).otherwise(F.col("velocity_kmh")))
    failures = validate.validate_dataset(bad, p.sessions, p.segments, p.eligibility, prepare.KEYS, t.max_gap, t.max_jump)
    assert {r["check"] for r in failures.collect()} == {"velocity_jump"}
    assert validate.validation_status(failures).head()["status"] == "failed"


def test_live_log(spark, tmp_path):
    rows = [("d", "imu" if i % 10 else "gnss", i * 0.1, 0.0, 0.0, 0.1, 0.2, 52.0, -1.5, 5.0, 90.0, 4.0, 0.0, 0.0, 1.0) for i in range(40)]
    schema = "device string, kind string, t double, gx double, gy double, gz double, lx double, lat double, lon double, speed double, course double, acc double, ux double, uy double, uz double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "log"))
    out = stream.live(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), "device", 52.0, -1.5)
    q = out.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live")
    assert got.count() == 40 and got.where("verdict is not null").count() == 4
