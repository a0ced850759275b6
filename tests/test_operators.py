"""Operators on hand-made fixtures: edge rows, ties, and slow loops as references."""

import math

import numpy as np
import pandas as pd
import pytest
import slow_loops
from pyspark.sql import functions as F

from roadtrace.operators import align, episodes, features, joins, ranking, reckon, roads, rollout, segments, splits
from roadtrace.sources import recordings, sinks
from roadtrace.streaming import devices


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_segments_edges(spark):
    rows = [("a", i, float(t), float(v), ok) for i, (t, v, ok) in enumerate([(0, 5, False), (1, 5, True), (2, 5, True), (3, 50, True), (4, 50, True), (5, 50, True), (9, 50, True), (8, 50, True), (9, 50, False)])]
    df = segments.segment_rows(frame(spark, rows, "s string, row_idx long, t double, v double, ok boolean"), ["s"], "t", "t", "v", "ok", 2.0, 10.0)
    got = {r["row_idx"]: (r["raw_segment"], r["segment_id"]) for r in segments.renumber_segments(df, ["s"], 2).collect()}
    assert [got[i][0] for i in range(9)] == [-1, 1, 1, 2, 2, 2, 3, 4, -1]
    assert [got[i][1] for i in range(9)] == [-1, 0, 0, 1, 1, 1, -1, -1, -1]


def test_interpolate_held(spark):
    df = frame(spark, [("a", i, float(x) if x is not None else None) for i, x in enumerate([0, 0, 0, 0, 4, 4, 4, 4, 8])], "s string, row_idx long, x double")
    got = [r["y"] for r in features.interpolate_held(df, ["s"], "x", "y").orderBy("row_idx").collect()]
    assert (got[2], got[6], got[8]) == (2, 6, 8)


def test_unwrap(spark):
    df = frame(spark, [("a", i, x) for i, x in enumerate([3.0, 3.1, -3.1, -3.0])], "s string, row_idx long, x double")
    got = [r["y"] for r in features.unwrap(df, ["s"], "x", "y").orderBy("row_idx").collect()]
    assert got[2] == pytest.approx(3.1 + (2 * math.pi - 6.2)) and got[3] - got[2] == pytest.approx(0.1)


@pytest.mark.parametrize("v,g,want", [(0.05, 0.01, True), (5.0, 0.01, False), (0.05, 0.1, False)])
def test_still(spark, v, g, want):
    assert spark.range(1).select(features.is_still(F.lit(v), F.lit(g))).head()[0] is want


def test_clamped_rollout_is_the_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for e in range(20):
        v = [float(rng.uniform(0, 5))]
        for d in rng.normal(0, 3, 15):
            v.append(max(0.0, v[-1] + d))
            rows.append((e, len(v) - 1, 0.0, float(d)))
        rows.append((e, 0, v[0], 99.0))
        want[e] = v
    out = rollout.clamped_rollout(frame(spark, rows, "e int, step int, v0 double, d double"), ["e"], "v0", "d").orderBy("e", "step").collect()
    for e, v in want.items():
        assert [r["predicted"] for r in out if r["e"] == e] == pytest.approx(v)


def test_two_clamps_differ(spark):
    df = frame(spark, [(0, i, 1.0, 0.0, a, 0.0) for i, a in enumerate([-20.0, -20.0, 30.0])], "e int, step int, v double, h double, a double, y double")
    got = [r["speed"] for r in rollout.unrolled_integration(df, ["e"], "v", "h", "a", "y").orderBy("step").collect()]
    assert got == pytest.approx([0, 0, 0])


def test_as_of_takes_a_fix_of_the_same_time_first(spark):
    s, f = frame(spark, [("a", 1.0), ("a", 2.0), ("a", 5.0)], "k string, t double"), frame(spark, [("a", 2.0, 7.0), ("a", 4.0, None)], "k string, ft double, acc double")
    got = joins.as_of(s, f, ["k"], "t", "ft", ["acc"]).orderBy("t").collect()
    assert [(r["fix_t"], r["acc"], r["fix_age"]) for r in got] == [(None, None, None), (2.0, 7.0, 0.0), (4.0, None, 1.0)]


@pytest.mark.parametrize("n,want", [(1, (1, 0, 0)), (2, (1, 0, 1)), (3, (1, 1, 1)), (10, (6, 2, 2)), (30, (22, 4, 4))])
def test_drive_holdout_rounds_half_to_even(spark, n, want):
    df = splits.drive_holdout(spark.range(n).select(F.lit("A").alias("driver_id"), F.col("id").cast("string").alias("session_key")))
    got = df.groupBy("drive_holdout_split").count().collect()
    assert tuple({r[0]: r[1] for r in got}.get(s, 0) for s in splits.SPLITS) == want


def test_driver_holdout_needs_three(spark):
    two = frame(spark, [("A", "1", 5), ("B", "2", 3)], "driver_id string, session_key string, paired_rows int")
    with pytest.raises(Exception, match="three drivers"):
        splits.driver_holdout(two).collect()


def test_best_lag_ties_and_missing(spark):
    rows = [("a", -1, 0.9, 5.0, 1.0), ("a", 0, 0.5, 1.0, 1.0), ("a", 1, 0.9, 4.0, 1.0), ("b", 0, None, 3.0, 1.0), ("b", 1, None, 2.0, 1.0)]
    got = {r["s"]: r for r in ranking.best_lag(frame(spark, rows, "s string, lag int, speed_corr double, median_separation double, p95_separation double"), ["s"]).collect()}
    assert (got["a"]["best_lag"], got["b"]["best_lag"], got["b"]["gain"]) == (1, 0, None)
    assert got["a"]["gain"] == pytest.approx(0.4)


def test_lag_profile_is_direct_and_signs_agree(spark):
    rng = np.random.default_rng(5)
    x = np.convolve(rng.normal(size=640), np.ones(5) / 5, "valid")
    y = np.concatenate([np.full(3, np.nan), x[:-3]])  # the vehicle lags the phone by three rows
    got = align.profile(x, y, 10)
    ok = np.isfinite(y)
    a, b = (x[ok] - x[ok].mean()) / x[ok].std(), (y[ok] - y[ok].mean()) / y[ok].std()
    want = [sum(a[i] * b[i - k] for i in range(len(a)) if 0 <= i - k < len(a)) / len(a) for k in range(-10, 11)]
    assert got == pytest.approx(want) and int(np.argmax(got)) - 10 == -3
    assert np.isnan(align.profile(x[:400], y[:400], 10)).all() and np.isnan(align.profile(np.ones(600), x[:600], 10)).all()


def test_lowpass():
    assert reckon.lowpass(np.full(200, 3.0)) == pytest.approx(np.full(200, 3.0), abs=1e-9)
    t = np.arange(400) / 10
    assert np.abs(reckon.lowpass(np.sin(2 * np.pi * 4 * t))[20:-20]).max() < 0.05


def test_calibration_finds_the_forward_axis():
    rng = np.random.default_rng(1)
    t = np.arange(250) / 10
    speed = 12 + 3 * np.sin(0.4 * t)
    dv = np.gradient(speed) * 10
    up = np.array([0.0, 0.0, 1.0])
    forward = np.array([math.cos(0.7), math.sin(0.7), 0.0])
    left = np.cross(up, forward)
    gravity = np.tile(9.81 * up, (250, 1))
    course = 0.2 * np.sin(0.9 * t)
    turning = np.gradient(course) * 10
    # clockwise turning pushes the car to the right
    acc = gravity + dv[:, None] * forward - (speed * turning)[:, None] * left + rng.normal(0, 0.01, (250, 3))
    gyro = np.outer(turning, up)
    cal = reckon.calibrate_window(acc, gravity, gyro, speed, course, course - 0.3)
    assert float(cal["forward"] @ forward) > 0.99 and cal["yaw_sign"] == 1.0 and cal["az_offset"] == pytest.approx(0.3)
    other = reckon.calibrate_procrustes_window(t, acc, gravity, gyro, speed, course, course - 0.3)
    assert float(other["forward"] @ forward) > 0.99 and other["compass_r"] == pytest.approx(1)


def test_distance_blackouts_scan(spark):
    df = spark.range(1000).select(F.lit("a").alias("s"), F.col("id").alias("row_idx"), F.lit(10.0).alias("v"))
    got = episodes.distance_blackouts(df, ["s"], "v", [50.0]).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got[:2]] == [(250, 300), (300, 350)] or all(r["end"] - r["start"] in (50, 51) for r in got)
    slow = df.withColumn("v", F.lit(0.5))
    assert episodes.distance_blackouts(slow, ["s"], "v", [50.0]).count() == 0


# --- roads

TEE = {1: (0.0, 0.0), 2: (0.0, 500.0), 3: (0.0, 1000.0), 4: (300.0, 500.0)}
LINKS = [(1, 2), (2, 3), (2, 4)]


@pytest.fixture
def tee(spark):
    rows = [(f"{a}-{b}", str(a), str(b), *TEE[a], *TEE[b], math.dist(TEE[a], TEE[b])) for a, b in LINKS]
    return frame(spark, rows, "edge string, a string, b string, ae double, an double, be double, bn double, length double")


def test_near_edges_and_anchor(spark, tee):
    p = frame(spark, [(1, 5.0, 250.0), (2, 200.0, 200.0)], "id int, e double, n double")
    got = roads.near_edges(p, tee, ["id"], 40.0).collect()
    assert [(r["id"], r["edge"], r["distance"], r["along"]) for r in got] == [(1, "1-2", 5.0, 250.0)]
    q = frame(spark, [(1, 2.0, 100.0, 0.0), (2, 2.0, 100.0, math.pi), (3, 500.0, 500.0, 0.0)], "id int, e double, n double, h double")
    at = {r["id"]: r for r in roads.anchor(q, tee, ["id"], "h").collect()}
    assert set(at) == {1, 2} and at[1]["bearing"] == pytest.approx(0) and abs(at[2]["bearing"]) == pytest.approx(math.pi) and at[2]["along"] == pytest.approx(400)


def _near():
    near = {}
    for a, b in LINKS:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def test_walk_turns_goes_straight_and_stops():
    yaw = np.zeros(500)
    yaw[300:320] = (math.pi / 2) / 2.0
    track, passed, heading = roads.walk(TEE, _near(), 1, 2, 100.0, yaw, np.full(500, 10.0), 0.1, False)
    assert track[-1] == pytest.approx([100, 500], abs=1) and passed == 1 and heading == pytest.approx(math.pi / 2)
    track, _, _ = roads.walk(TEE, _near(), 1, 2, 100.0, np.zeros(500), np.full(500, 10.0), 0.1, False)
    assert track[-1] == pytest.approx([0, 600], abs=1e-6)
    two = {1: (0.0, 0.0), 2: (0.0, 300.0)}
    track, _, _ = roads.walk(two, {1: [2], 2: [1]}, 1, 2, 0.0, np.zeros(400), np.full(400, 10.0), 0.1, False)
    assert track[-1] == pytest.approx([0, 300])
    track, _, _ = roads.walk(two, {1: [2], 2: [1]}, 1, 2, 0.0, np.zeros(400), np.full(400, 10.0), 0.1, True)
    assert track[-1] == pytest.approx([0, 200])


def test_route_and_viterbi():
    g = pd.DataFrame([(f"{a}-{b}", str(a), str(b), *TEE[a], *TEE[b], math.dist(TEE[a], TEE[b])) for a, b in LINKS], columns=["edge", "a", "b", "ae", "an", "be", "bn", "length"])
    route = roads._Router(g, 2000.0)
    assert route("1-2", (0, 400), "2-4", (50, 500)) == pytest.approx(150) and route("1-2", (0, 10), "1-2", (0, 30)) == 20
    seen = [(1.0, 450.0), (20.0, 495.0), (60.0, 503.0)]
    cand = [[("1-2", (0.0, 450.0), 1.0)], [("1-2", (0.0, 495.0), 20.0), ("2-4", (20.0, 500.0), 5.0)], [("2-4", (60.0, 500.0), 3.0)]]
    assert roads.viterbi(cand, seen, route, 25.0, 12.0) == [0, 1, 0] and roads.viterbi([[], []], seen[:2], route, 25, 12) == [-1, -1]


# --- devices


def test_filter_predicts_learns_and_gates():
    f = slow_loops.FusionFilter()
    f.start(0, 0, math.pi / 2, 10)
    before = f.P[0, 0]
    for _ in range(200):
        f.predict(0.0, None, 0.05)
    assert f.x[0] == pytest.approx(100) and f.x[1] == pytest.approx(0, abs=1e-6) and f.P[0, 0] > before
    f = slow_loops.FusionFilter()
    f.start(0, 0, 0.0, 10)
    for i in range(1, 1201):
        f.predict(0.02, 0.2, 0.05)
        if i % 20 == 0:
            f.fix_position(0, 10 * i * 0.05, 3)
            f.fix_speed(10, 0.3)
            f.fix_course(0, 0.05)
    assert f.x[4] == pytest.approx(0.02, abs=0.004) and f.x[5] == pytest.approx(0.2, abs=0.05)
    assert f.fix_position(f.x[0] + 100, f.x[1], 3) == "rejected" and f.fix_position(f.x[0] + 1, f.x[1], 3) == "accepted"
    verdicts = [f.fix_position(f.x[0] + 200, f.x[1], 3) for _ in range(3)]
    assert verdicts == ["rejected", "rejected", "anchored"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = []
    for dev in "ab":
        for i in range(120):
            fix = i % 10 == 0 and not 40 <= i < 80
            rows.append((dev, "fix" if fix else "imu", i * 0.1, 0.01, 0.1, i * 1.0, 0.0, 10.0, math.pi / 2, 3.0))
    schema = "device string, kind string, t double, omega double, accel double, e double, n double, speed double, course double, sigma double"
    df = spark.createDataFrame(rows, schema)
    batch = devices.fusion_filter(df, ["device"]).orderBy("device", "t").toPandas()
    spark.createDataFrame([r for r in rows if r[2] < 6], schema).coalesce(1).write.parquet(str(tmp_path / "in/a"))
    spark.createDataFrame([r for r in rows if r[2] >= 6], schema).coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = devices.fusion_filter_stream(stream.withColumn("ts", F.timestamp_seconds("t")), "device", "ts", "1 hour")
    q = out.writeStream.format("memory").queryName("filtered").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("filtered").orderBy("device", "t").toPandas()
    pd.testing.assert_frame_equal(got, batch[got.columns], check_dtype=False)
    done = devices.recovery_stats(spark.createDataFrame(batch[["device", "t", "outage_s", "outage_m", "error_m", "drift_percent"]].dropna(subset=["outage_s"])), ["device"]).collect()
    assert len(done) == 2 and done[0]["outage_s"] == pytest.approx(8.0 - 3.0 - 2.0)


def test_session_windows_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 100.0), (2, 0.0), (9, 10_000.0)], "device int, s double").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = devices.device_sessions(stream, "device", "ts", "10 seconds", "1 seconds")
    q = out.writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r["device"], r["events"]) for r in spark.table("sessions").collect()}
    whole = {(r["device"], r["events"]) for r in devices.device_sessions(df, "device", "ts", "10 seconds").collect()}
    assert closed <= whole and whole == {(1, 2), (1, 1), (2, 1), (9, 1)}


def test_alignment_states_and_trail(spark):
    acc = np.tile([0.0, 0.0, 9.81], (60, 1))
    gyro = np.zeros((60, 3))
    speed = np.full(60, 0.0)
    acc[30:, 0], speed[30:] = 1.0, 5.0
    gyro[50:, 1] = np.where(np.arange(10) % 2, 3.0, -3.0)
    states = slow_loops.alignment_path(acc, gyro, speed)[0]
    assert list(devices.align_rows(acc, gyro, speed)[0]) == states
    assert states[18] == "UNCALIBRATED" and states[19] == "Z_ALIGNED" and states[30] == "FULLY_ALIGNED" and states[59] == "UNCALIBRATED"
    df = spark.createDataFrame([("a", i, float(i), 0.0) for i in range(10)], "d string, i int, e double, n double")
    assert [r["i"] for r in devices.thin_trail(df, ["d"], "e", "n", "i", 3.0).orderBy("i").collect()] == [0, 3, 6, 9]


# --- sources


def test_recordings_round_trip(spark, tmp_path):
    folder = tmp_path / "Set (Driver B)"
    folder.mkdir()
    head = ",".join(f"h{i}" for i in range(24))
    row = ["52.0", "-1.5", "90", "bad", "5", "10", "", "100", "2020-01-02 03:04:05:678", *["1.0"] * 15]
    (folder / "S-Drive1.csv").write_text("\n".join([head, ",".join(row), ",".join(["51.0", *row[1:]])]))
    (folder / "V-Drive1.csv").write_text("\n".join([",".join(f"v{i}" for i in range(29)), ",".join(["1.0"] * 29)]))
    (folder / "S-Drive2.csv").write_text(head)
    files = recordings.list_files(spark, str(tmp_path))
    pairs = recordings.discover_pairs(files).collect()
    assert [(r["key"], r["driver_id"]) for r in pairs] == [("drive1", "B")]
    phone = recordings.read_phone(spark, str(folder / "S-Drive1.csv")).orderBy("row_idx").collect()
    assert [r["lat"] for r in phone] == [52.0, 51.0] and phone[0]["gps_speed_ms"] is None and phone[0]["session_key"] == "drive1" and phone[0]["phone_ts"].microsecond == 678_000
    vehicle = recordings.read_vehicle(spark, str(folder / "V-Drive1.csv")).head()
    assert vehicle["acc_long"] == pytest.approx(9.80665) and vehicle["row_idx"] == 0


def test_reader_buffer_is_no_larger_than_a_short_recording_needs(spark, tmp_path):
    line = ",".join(["{}.5", *["1.0"] * 6, "{}", *["1.0"] * 16])
    for name, end in (("S-Unix", "\n"), ("S-Windows", "\r\n")):
        (tmp_path / f"{name}.csv").write_bytes(end.join([",".join(recordings.PHONE), *[line.format(i, i) for i in range(1_000)]]).encode())
    phone = recordings.read_phone(spark, str(tmp_path))
    # recordings longer than the buffer are read whole, in their order
    got = phone.select("session_key", "row_idx", "lat", "roll_deg", "elapsed_s").collect()
    assert {(r["session_key"], r["row_idx"], r["lat"], r["roll_deg"]) for r in got} == {(k, i, i + 0.5, 1.0) for k in ("unix", "windows") for i in range(1_000)} and len(got) == 2_000
    options = phone._jdf.queryExecution().analyzed().collectLeaves().head().relation().options()
    # without the option the reader's own default of 1,048,576 holds
    assert options.contains("inputBufferSize") and int(options.apply("inputBufferSize")) <= 65_536


def test_resolve_column():
    headers = ["GYROSCOPE X (rad/s)", "GRAVITY Y", "GYROSCOPE Y (rad/s)"]
    assert recordings.resolve_column(headers, "gyroscope", "y") == headers[2] and recordings.resolve_column(headers, "gravity", "y") == headers[1] and recordings.resolve_column(headers, "mag", "y") is None


def test_drive_log(spark, tmp_path):
    cells = lambda **v: ",".join(str(v.get(c, "")) for c in recordings.LOG)
    (tmp_path / "log.csv").write_text("\n".join([",".join(recordings.LOG), cells(kind="imu", t=0.1, ax=1.0), cells(kind="imu", t=0.2), cells(kind="gnss", t=0.3, lat=52.0)]))
    imu, fixes = recordings.split_log(recordings.read_drive_log(spark, str(tmp_path / "log.csv")))
    assert imu.count() == 2 and fixes.head()["lat"] == 52.0 and imu.orderBy("t").head()["ay"] is None


# --- helpers against slow loops


def test_distance_blackouts_against_a_loop(spark):
    rng = np.random.default_rng(8)
    v = np.abs(rng.normal(8, 5, 900)) + 0.2
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "s string, row_idx long, v double")
    got = [(r["start"], r["end"]) for r in episodes.distance_blackouts(df.repartition(3), ["s"], "v", [60.0], history=50, min_history=0.3).orderBy("start").collect()]
    cum, want, s = np.cumsum(v) / 10, [], 50
    while s < len(v) - 5:
        e = next((i for i in range(len(v)) if cum[i] >= cum[s] + 60.0), len(v))
        if e < len(v) and e - s >= 5 and v[s:e].mean() >= 3 and v[s - 50 : s].min() >= 0.3:
            want.append((s, e))
            s = e
        else:
            s += 50
    assert got == want and want


def test_straightest_segment_is_the_least_turning(spark):
    turn = np.cumsum([0.5 if 300 < i < 500 else 0.01 for i in range(1000)])
    df = spark.createDataFrame([("a", i, 10.0, float(t)) for i, t in enumerate(turn)], "s string, row_idx long, v double, turn double")
    r = episodes.straightest_segment(df, ["s"], "v", "turn", 100.0).head()
    assert (r["start"] >= 500 or r["end"] <= 301) and r["turning"] == pytest.approx(0.01 * (r["end"] - 1 - r["start"]), abs=0.02)


def _slow_speed(a, c, g, v0, p):
    def smooth(x, tau):
        if tau <= 0:
            return list(x)
        out, state = [], x[0]
        for y in x:
            state += (1 - math.exp(-0.1 / tau)) * (y - state)
            out.append(state)
        return out

    total, out, limit = 0.0, [], p["limit_kmh"] / 3.6
    quiet = [abs(x) < 0.18 and y < 0.04 for x, y in zip(smooth(c, 0.5), smooth(g, 0.5), strict=True)]
    for i, x in enumerate(smooth(a, p["smoothing"])):
        total += x * 0.1
        change = min(max(total, -limit), limit)
        decay = 1.0 if math.isinf(p["decay"]) else math.exp(-(i + 1) * 0.1 / p["decay"])
        v = max(0.0, v0 + p["gain"] * decay * change)
        out.append(0.0 if p["stationary"] and v0 < 0.75 and quiet[i] else v)
    return out


@pytest.mark.parametrize("v0", [0.5, 9.0])
def test_control_speeds_are_the_loop(v0):
    rng = np.random.default_rng(2)
    a, c, g = rng.normal(0, 2, 60), rng.normal(0, 0.2, 60), np.abs(rng.normal(0, 0.04, 60))
    grid = rollout.speed_grid()
    assert len(grid) == 385 and len(rollout.yaw_grid()) == 16
    got = rollout.control_speeds(a, c, g, v0, grid)
    for i in range(0, 385, 7):
        assert got[i] == pytest.approx(_slow_speed(a, c, g, v0, grid[i]))


def test_control_search_finds_the_setting_that_made_the_truth(spark):
    rng = np.random.default_rng(4)
    grid, rows = rollout.speed_grid()[:60], []
    for e in range(6):
        a = rng.normal(0.5, 1, 40)
        truth = rollout.control_speeds(a, a, np.abs(a), 8.0, [grid[17]])[0]
        rows += [(e, 4, i, float(x), float(x), 1.0, 8.0, float(t)) for i, (x, t) in enumerate(zip(a, truth, strict=True))]
    df = spark.createDataFrame(rows, "e int, duration int, step int, acceleration double, calibrated double, gyro double, v0 double, true_speed double")
    scores = rollout.control_search(df, ["e"], grid)
    best = ranking.select_parameters(scores, ["setting"], "score").head()
    assert best["score"] == pytest.approx(0, abs=1e-9) and scores.where(f"setting = {17} and score < 1e-9").count() == 1


def test_reckon_track_modes():
    n = 30
    gravity, gyro = np.tile([0.0, 0.0, 9.81], (n, 1)), np.tile([0.0, 0.0, 0.1], (n, 1))
    cal = {"forward": np.array([1.0, 0, 0]), "accel_bias": 0.0, "yaw_sign": 1.0, "yaw_bias": 0.0, "az_offset": 0.0}
    course = 0.1 * np.arange(n) * 0.1
    speed = np.full(n, 10.0)
    for heading in ("gyro", "fused", "oracle", "compass"):
        e, north, v, h = reckon.reckon_track(gravity, gravity, gyro, speed, course, course, cal, "ins", heading)
        assert h == pytest.approx(course) and v == pytest.approx(speed) and e[0] == north[0] == 0
        assert e[-1] == pytest.approx(sum(math.sin(x) for x in course[1:])) and north[-1] == pytest.approx(sum(math.cos(x) for x in course[1:]))
    _, _, v, h = reckon.reckon_track(gravity + np.array([-30.0, 0, 0]), gravity, gyro, speed, course, course, cal, "ins", "hold")
    assert v.min() == 0 and set(h) == {0.0}


def test_ridge_from_moments_is_the_solve(spark):
    rng = np.random.default_rng(6)
    x, rows = rng.normal(3, 2, (50, 3)), []
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(0, 0.1, 50)
    rows = [("a", *map(float, r), float(t)) for r, t in zip(x, y, strict=True)] + [("a", None, 1.0, 1.0, 1.0)]
    out = rollout.ridge_from_moments(spark.createDataFrame(rows, "k string, p double, q double, r double, y double"), ["k"], ["p", "q", "r"], "y", 2.0).head()
    coef, intercept = rollout.ridge_solve(x, y, 2.0)
    assert out["coef"] == pytest.approx(list(coef)) and out["intercept"] == pytest.approx(intercept) and out["n"] == 50


@pytest.mark.parametrize("block", [1, 50_000])
def test_blackouts_of_long_drives_with_gaps(spark, monkeypatch, block):
    """Blocks of a few hundred rows and whole drives give what a loop over the rows with a speed gives; starts and ends are row numbers."""
    monkeypatch.setattr(episodes, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for s, n in (("a", 30_000), ("b", 4_000), (None, 700), ("short", 40), ("empty", 30)):
        v = np.abs(rng.normal(8, 5, n)) * np.where(rng.random(n) < 0.0005, 0, 1)
        v[n // 3 : n // 3 + 200] = 0.4
        gone = rng.random(n) < 0.01 if s != "empty" else np.ones(n, bool)
        rows += [(s, i, None if g and i % 2 else float("nan") if g else float(x), 1.0) for i, (x, g) in enumerate(zip(v, gone, strict=True))]
        left = np.flatnonzero(~gone)
        for d in (60.0, 150.0):
            if len(left) > 40:
                want[s, d] = [(int(left[x]), int(left[y])) for x, y in slow_loops.scan(v[left], d, 40, 10.0, 3.0, 2.0, 0, 5, 0.3)]
    df = spark.createDataFrame(rows, "s string, row_idx long, v double, start double").repartition(7)
    got = {}
    for r in episodes.distance_blackouts(df, ["s"], "v", [60.0, 150.0], 40, step_s=2.0, min_history=0.3).orderBy("start").collect():
        got.setdefault((r["s"], r["distance_m"]), []).append((r["start"], r["end"]))
    assert got == {k: w for k, w in want.items() if w} and len(got["a", 60.0]) > 200


def test_blackouts_of_many_short_drives(spark):
    """Drives of any length up to and beyond what is scanned at once, over small batches, without a call for each."""
    rng = np.random.default_rng(2)
    span = episodes._Chain([20.0, 45.0], 10, 10.0, 5.0, None, 5, 0, 11, 1.0).span
    drives = {f"d{i}" if i else None: rng.uniform(4, 15, n) for i, n in enumerate([*range(5, 120), span - 1, span, span + 1])}
    df = spark.createDataFrame([(s, i, float(x)) for s, v in drives.items() for i, x in enumerate(v)], "s string, row_idx int, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = episodes.distance_blackouts(df, ["s"], "v", [20.0, 45.0], 10, min_speed=5.0, step_s=0.5, min_rows=11)
        got = {}
        for r in out.orderBy("start").collect():
            got.setdefault((r["s"], r["distance_m"]), []).append((r["start"], r["end"]))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {(s, d): slow_loops.scan(v, d, 10, 10.0, 5.0, 0.5, 0, 11, 1.0) for s, v in drives.items() if len(v) > 10 for d in (20.0, 45.0)}
    assert got == {k: w for k, w in want.items() if w} and len(got) > 150
    assert "MapInArrow" in out._jdf.queryExecution().toString()


def test_a_million_rows_of_one_drive(spark):
    """One null among four thousand rows costs no blackout; a long drive is cut in blocks of equal work."""
    one = spark.range(4_000).select(F.lit("s").alias("s"), F.col("id").alias("row_idx"), F.when(F.col("id") != 600, 15.0).alias("v"))
    assert episodes.distance_blackouts(one, ["s"], "v", [200.0]).count() == 27
    long = spark.range(1_000_000).select(F.lit("s").alias("s"), F.col("id").alias("row_idx"), (10 + F.sin(F.col("id") / 1000)).alias("v"))
    t = np.arange(1_000_000)
    want = slow_loops.scan(10 + np.sin(t / 1000), 1000.0, 250, 10.0, 3.0, 5.0, 0, 5, 1.0)
    found = episodes.distance_blackouts(long, ["s"], "v", [1000.0])
    assert [(r["start"], r["end"]) for r in found.orderBy("start").collect()] == want
    sizes = [r["count"] for r in episodes._in_blocks(episodes._positions(long, ["s"], "row_idx", "v", []), episodes.BLOCK, 250, 6_669).groupBy("_block").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= episodes.BLOCK + 7_000


def test_blackouts_of_exact_lengths_are_the_same_in_all_blocks(spark, monkeypatch):
    """Speeds in hundredths of km/h often cover 50 m to the last bit; sums over runs from the start of the drive decide, wherever it is cut."""

    def upto(x, n):
        total, first, size = 0.0, 0, episodes.RUN**5
        while first < n:
            while first + size > n or first % size:
                size //= episodes.RUN
            total, first = total + node(x, first, size), first + size
        return total

    def node(x, first, size):
        part = size // episodes.RUN
        total = float(x[first]) if size == 1 else 0.0
        for i in range(episodes.RUN if size > 1 else 0):
            total += node(x, first + i * part, part)
        return total

    rng = np.random.default_rng(5)
    v = np.repeat(rng.integers(1, 40, 5_000) * 300 / 100 / 3.6, 6)
    cum = np.array([upto(v / 10.0, n + 1) for n in range(0, len(v), 7)])
    before = episodes._sums_before(v / 10.0, np.zeros(1), episodes.RUN**4)
    assert (before[1 :: 7][: len(cum)] == cum).all() and (np.cumsum(v / 10.0)[::7] != cum).any()
    want, s, c = [], 25, np.maximum.accumulate(before[1:])
    while s < len(v) - 5:
        e = int(np.searchsorted(c, before[1 + s] + 50.0))
        ok = e < len(v) and e - s >= 5 and (before[e] - before[1 + s] + v[s] / 10) * 10 / (e - s) >= 3
        want += [(s, e)] if ok else []
        s = e if ok else s + 50
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "s string, row_idx long, v double").repartition(5)
    for block in (1, 50_000):
        monkeypatch.setattr(episodes, "BLOCK", block)
        found = episodes.distance_blackouts(df, ["s"], "v", [50.0], 25, min_history=0.0).orderBy("start").collect()
        assert [(r["start"], r["end"]) for r in found] == want, block


def test_replays_do_not_depend_on_the_blocks_of_the_search(spark, monkeypatch):
    """Frames of blackouts whose lengths are met to the last bit."""
    rng = np.random.default_rng(7)
    v = np.repeat(rng.integers(1, 40, 2_000) * 300 / 100 / 3.6, 6)
    df = spark.createDataFrame([("s", i, float(x), 52.0, -1.5) for i, x in enumerate(v)], "s string, row_idx long, speed double, lat double, lon double").repartition(3)
    frames = []
    for block in (1, 50_000):
        monkeypatch.setattr(episodes, "BLOCK", block)
        found = episodes.distance_blackouts(df, ["s"], "speed", [50.0], 25, min_history=0.0).select("s", "start", "end")
        track = found.withColumn("row_idx", F.explode(F.expr("sequence(start, end - 1)"))).select("s", "start", "row_idx", F.lit(0.0).alias("e"), F.lit(0.0).alias("n"))
        out = sinks.replays(df, track, track, found, ["s"], 52.0, -1.5, 10, 10)
        frames.append({(r["start"], r["row_idx"], r["mode"]) for r in out.collect()})
    assert frames[0] == frames[1] and len(frames[0]) > 1_000


def test_exact_sweep_shuffles_rows_and_not_their_pairs(spark):
    from roadtrace.operators import align

    rows = [("a" if i else None, i, float(i % 7), 52.0, 0.001 * i) for i in range(30)]
    p = spark.createDataFrame(rows, "key string, row_idx int, speed_kmh double, lat double, lon double")
    v = p.where("row_idx % 5 <> 3").toDF("key", "row_idx", "velocity_kmh", "vehicle_lat", "vehicle_lon")
    out = align.lag_sweep_exact(p, v, ["key"], 4, 2)
    plan = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in line]
    assert plan and not any("lag" in line for line in plan)
    got = {r["lag"]: r["median_separation"] for r in out.collect()}
    assert sorted(got) == list(range(-4, 5)) and got[0] == 0.0


def test_recordings_are_a_file_each_and_need_no_folder_each(spark, tmp_path):
    from roadtrace.sources import sinks

    rows = [(f"S-{n}", i, None if i == 2 else f'{n} "x", {i}', "") for n in range(40) for i in range(n % 4 + 1)]
    df = spark.createDataFrame(rows, "file string, row_idx long, a string, b string").repartition(7)
    assert sinks.write_recordings(df, f"file://{tmp_path}/r", ["a", "b"]) == 40
    files = {f.stem: f for f in (tmp_path / "r").glob("*/*.csv")}
    assert set(files) == {f"S-{n}" for n in range(40)} and len(list((tmp_path / "r").iterdir())) <= 4
    assert not [f for f in (tmp_path / "r").glob("*/.*") if not f.name.endswith(".crc")]
    raw = spark.read.csv(str(tmp_path / "r"), schema="a string, b string", header=True, enforceSchema=True, multiLine=True, escape="\\")
    got = raw.selectExpr("regexp_extract(_metadata.file_path, '(S-[0-9]+).csv', 1) as file", "a", "b").collect()
    assert sorted((r["file"], r["a"] or "", r["b"] or "") for r in got) == sorted((f, a or "", b) for f, _, a, b in rows)
    assert sinks.write_recordings(df.limit(0), f"{tmp_path}/none", ["a", "b"]) == 0
