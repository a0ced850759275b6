"""Live fix health and outages: the stream says what the batch says, timers speak for idle devices."""

import itertools

import numpy as np
import pandas as pd
import pytest
import slow_loops
from pyspark.sql import functions as F

from roadtrace.streaming import devices, live

SCHEMA = "device string, kind string, t double, id long, speed double, accuracy double, accepted boolean"
#: Moves the watermark on, so that all timers speak.
CLOSING = [[("closing", "imu", t, 0, 0.0, None, None)] for t in (10_000.0, 10_001.0, 10_002.0)]


def drives(n=3, seed=1):
    rng, rows, ids = np.random.default_rng(seed), [], itertools.count()
    for d in range(n):
        for i in range(600):
            rows.append((f"d{d}", "imu", 0.05 + i * 0.1, next(ids), None if i % 97 == 5 else float(rng.uniform(0, 20)), None, None))
        for t in np.cumsum(rng.choice([0.5, 1.0, 4.0, 9.0], 12, p=[0.3, 0.3, 0.2, 0.2])):
            rows.append((f"d{d}", "fix", float(t), next(ids), None, float(rng.choice([5.0, 30.0, 90.0])), bool(rng.random() < 0.8)))
    return rows


def run_stream(spark, tmp_path, batches, stream_of, schema=SCHEMA, mode="update"):
    """Rows of the stream over one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"live_{tmp_path.name.replace('-', '_')}"
    out = stream_of(source.withColumn("ts", F.timestamp_seconds("t")))
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).toPandas()


def test_stream_is_the_batch_whatever_the_order(spark, tmp_path):
    rows = drives()
    df = spark.createDataFrame(rows, SCHEMA)
    # samples of each ten seconds come before their fixes, each file in another order
    rng = np.random.default_rng(3)
    batches = [[r for r in rows if a <= r[2] < a + 10 and (r[1] == "fix") == fix] for a in range(0, 100, 10) for fix in (False, True)]
    batches = [[b[i] for i in rng.permutation(len(b))] for b in batches if b] + CLOSING
    got = run_stream(spark, tmp_path, batches, lambda s: live.watch_fixes(s, "device", "ts", "15 seconds"))
    got = got[got["device"] != "closing"]
    imu, fix = df.where("kind = 'imu'").drop("accuracy"), df.where("kind = 'fix'").select("device", F.col("t").alias("fix_t"), "accuracy", "accepted")
    want = devices.gnss_health(imu, fix, ["device"], "t", "fix_t", "accuracy", tie="id").select("id", "health").toPandas()
    health = got[got["event"] == "sample"]
    assert dict(zip(health["id"], health["health"], strict=True)) == dict(zip(want["id"], want["health"], strict=True)) and len(health) == len(want) == 1800
    accepted = fix.where("accepted")
    want = devices.outages(imu, accepted, ["device"], "t", "fix_t", "speed").toPandas().sort_values(["device", "last_fix"]).reset_index(drop=True)
    out = got[got["event"].isin(["open", "closed"])].copy()
    out = out.sort_values("event", ascending=False, kind="stable").sort_values(["device", "last_fix", "seconds"], kind="stable")
    last = pd.concat([out[out["event"] == "closed"], out[(out["event"] == "open")].drop_duplicates(["device", "last_fix"], keep="last")]).drop_duplicates(["device", "last_fix"]).sort_values(["device", "last_fix"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(last[want.columns], want, check_dtype=False, atol=1e-9)
    assert want["end"].isna().sum() == 3 and len(want) > 8  # open ones included


def test_an_idle_device_is_told_to_be_lost(spark, tmp_path):
    rows = [("idle", "fix", 1.0, 1, None, 5.0, None), ("idle", "imu", 1.5, 2, 3.0, None, None), ("bad", "fix", 1.0, 3, None, 500.0, None)]
    got = run_stream(spark, tmp_path, [rows, *CLOSING], lambda s: live.watch_fixes(s, "device", "ts", "1 seconds"))
    own = got[got["device"] == "idle"].set_index("event")
    assert own.loc["denied", "t"] == 3.0 and own.loc["open", "start"] == 3.0 and own.loc["sample", "health"] == "good" and len(own) == 3
    assert list(got[got["device"] == "bad"]["event"]) == ["open"]  # it never had a usable fix to lose


def test_late_rows_are_left_out(spark, tmp_path):
    batches = [[("a", "imu", 100.0, 1, 1.0, None, None)], [("a", "imu", 130.0, 2, 1.0, None, None)], [("a", "imu", 131.0, 4, 1.0, None, None)], [("a", "fix", 99.5, 3, None, 5.0, None)], *CLOSING]
    got = run_stream(spark, tmp_path, batches, lambda s: live.gnss_health_stream(s, "device", "ts", watermark="5 seconds"))
    assert dict(zip(got["id"].dropna(), got["health"], strict=False)) == {1.0: "denied", 2.0: "denied", 4.0: "denied"}


@pytest.mark.parametrize("cuts", [[], [30], [10, 11, 50, 200]])
def test_watch_in_pieces_is_watch_at_once(cuts):
    rows = pd.DataFrame([r for r in drives(1, 7)], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
    rows = rows.assign(fix=rows["kind"] == "fix", accepted=rows["accepted"].fillna(True)).sort_values(["t", "fix"], ascending=[True, False])
    whole, end = live.watch(rows, {}, 60.0)
    parts, state, before = [], {}, -1.0
    for t in [*(rows["t"].iloc[c] for c in cuts), 60.0]:
        told, state = live.watch(rows[(rows["t"] > before) & (rows["t"] <= t)], state, t)
        parts.append(told)
        before = t
    parts = pd.concat(parts, ignore_index=True)
    for event in ("sample", "denied", "closed"):
        a, b = (x[x["event"] == event].dropna(axis=1, how="all").reset_index(drop=True) for x in (whole, parts))
        pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert state["distance"] == pytest.approx(end["distance"]) and state["ok_t"] == end["ok_t"]
    empty, same = live.watch(rows.iloc[:0], {}, 5.0)
    assert len(empty) == 0 and same["fix_t"] is None


def mounting(n, seed, speeds):
    """Rests, drives and knocks by turns; a speed now and then or always."""
    rng = np.random.default_rng(seed)
    acc, gyro = rng.normal(0, 0.02, (n, 3)) + [0, 0, 9.81], rng.normal(0, 0.01, (n, 3))
    for start in range(60, n, 170):
        acc[start : start + 90, 0] += rng.normal(0, 1.5, len(acc[start : start + 90]))
        if start % 3 == 0:
            gyro[start + 100 : start + 110] += rng.normal(0, 2, (len(gyro[start + 100 : start + 110]), 3))
    speed = np.where(rng.random(n) < speeds, np.where(np.abs(acc[:, 0]) > 0.3, 8.0, 0.0), np.nan)
    return acc, gyro, speed


@pytest.mark.parametrize("speeds", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("pieces", [1, 7, 400])
def test_mounting_in_pieces_is_that_of_a_row_loop(speeds, pieces):
    acc, gyro, speed = mounting(1500, 4, speeds)
    states, axes = slow_loops.alignment_path(acc, gyro, speed)
    got, found, carry = [], [], None
    for part in np.array_split(np.arange(len(acc)), pieces):
        s, x, carry = devices.align_rows(acc[part], gyro[part], speed[part], carry)
        got += list(s)
        found += x
    assert got == states and len(set(states)) == 3
    assert all((a is None) == (b is None) and (a is None or np.allclose(a, b)) for a, b in zip(found, axes, strict=True))


def test_a_hundred_thousand_rows_of_one_session(spark):
    acc, gyro, speed = mounting(100_000, 9, 0.5)
    df = spark.createDataFrame(pd.DataFrame({"d": "a", "row_idx": np.arange(100_000), **{f"a{x}": acc[:, i] for i, x in enumerate("xyz")}, **{f"g{x}": gyro[:, i] for i, x in enumerate("xyz")}, "v": speed}))
    out = devices.alignment_states(df, ["d"], ("ax", "ay", "az"), ("gx", "gy", "gz"), "v").orderBy("row_idx").toPandas()
    assert list(out["state"]) == slow_loops.alignment_path(acc, gyro, speed)[0]


def test_mounting_of_a_stream(spark, tmp_path):
    acc, gyro, speed = mounting(500, 2, 0.5)
    rows = [(d, 1 + i * 0.1, *map(float, acc[i]), *map(float, gyro[i]), None if np.isnan(speed[i]) else float(speed[i])) for d in "ab" for i in range(500)]
    schema = "device string, t double, ax double, ay double, az double, gx double, gy double, gz double, speed double"
    rng = np.random.default_rng(1)
    batches = [[r for r in rows if a <= r[1] < a + 12] for a in range(0, 60, 12)]
    batches = [[b[i] for i in rng.permutation(len(b))] for b in batches if b] + [[("closing", t, *[0.0] * 7)] for t in (1e4, 1e4 + 1, 1e4 + 2)]
    got = run_stream(spark, tmp_path, batches, lambda s: live.alignment_stream(s, "device", "ts", "3 seconds"), schema, "append")
    for d in "ab":
        own = got[got["device"] == d].sort_values("t")
        assert list(own["state"]) == slow_loops.alignment_path(acc, gyro, speed)[0]


def thin_loop(e, n, spacing):
    kept, last = [], None
    for i, p in enumerate(zip(e, n, strict=True)):
        if not np.isnan(p).any() and (last is None or np.hypot(p[0] - last[0], p[1] - last[1]) >= spacing):
            kept.append(i)
            last = p
    return kept


def space_loop(t, every):
    kept, last = [], None
    for i, x in enumerate(t):
        if last is None or x - last >= every - 1e-9:
            kept.append(i)
            last = x
    return kept


def walk_of(n, seed):
    rng = np.random.default_rng(seed)
    e, north = (np.cumsum(rng.normal(0.2, 0.8, n) * (np.arange(n) % 900 > 300)) for _ in range(2))  # at rest for hundreds of rows
    e[rng.random(n) < 0.01] = np.nan
    return np.cumsum(rng.choice([0.02, 0.05, 0.3], n)), e, north


def test_trails_in_batches_and_pieces(spark):
    t, e, n = walk_of(30_000, 5)
    df = spark.createDataFrame(pd.DataFrame({"d": "a", "i": np.arange(len(e)), "t": t, "e": e, "n": n})).repartition(5)
    assert [r["i"] for r in devices.thin_trail(df, ["d"], "e", "n", "i", 3.0).orderBy("i").collect()] == thin_loop(e, n, 3.0)
    assert [r["i"] for r in devices.emitted_rows(df, ["d"], "t", 0.1).orderBy("i").collect()] == space_loop(t, 0.1)
    assert devices.thin_trail(df.limit(0), ["d"], "e", "n", "i").isEmpty() and devices.emitted_rows(df.limit(0), ["d"], "t").isEmpty()


def test_trail_of_a_stream(spark, tmp_path):
    t, e, n = walk_of(1500, 6)
    t = t + 1
    rows = [("a", float(t[i]), None if np.isnan(e[i]) else float(e[i]), float(n[i]), i % 10 == 9) for i in range(1500)]
    batches = [rows[a : a + 300] for a in range(0, 1500, 300)] + [[("closing", x, 0.0, 0.0, False)] for x in (1e5, 1e5 + 1, 1e5 + 2)]
    got = run_stream(spark, tmp_path, batches, lambda s: live.trail_stream(s, "device", "ts", "3 seconds"), "device string, t double, e double, n double, fix boolean", "append")
    got = got[got["device"] == "a"].sort_values("t")
    shown = np.flatnonzero(np.arange(1500) % 10 != 9)
    assert list(got[got["kept"]]["t"]) == [t[shown[i]] for i in thin_loop(e[shown], n[shown], 3.0)]
    assert list(got[got["emitted"]]["t"]) == [t[shown[i]] for i in space_loop(t[shown], 0.1)]
    last = got["fixes"].dropna().iloc[-1]
    assert len(last) == 270 and last[-3] == t[1499] and last[0] == t[1499 - 890]


@pytest.mark.parametrize("flag", [False, True])
def test_filter_of_a_stream_is_the_batch_whatever_the_order(spark, tmp_path, flag):
    """Three devices with outages, rejected fixes, fixes at a sample's time and rows without an acceleration; files that come in another order."""
    rng, rows = np.random.default_rng(8), []
    for d in "abc":
        for i in range(400):
            rows.append((d, "imu", 1 + i * 0.1, float(rng.normal(0, 0.02)), None if i % 7 == 3 else float(rng.normal(0, 0.3)), 0.0, 0.0, 0.0, 0.0, 3.0, bool(i % 90 > 80)))
            if i % 10 == 0 and not 150 <= i < 230:
                away = 300.0 if 300 <= i < 350 else 0.0
                rows.append((d, "fix", 1 + i * 0.1, 0.0, None, i * 1.0 + away, float(rng.normal(0, 2)), 10.0, np.pi / 2, 3.0, None))
    schema = "device string, kind string, t double, omega double, accel double, e double, n double, speed double, course double, sigma double, stationary boolean"
    if not flag:
        rows, schema = [r[:-1] for r in rows], schema.rsplit(",", 1)[0]
    closing = [[("closing", "imu", t, 0.0, None, 0.0, 0.0, 0.0, 0.0, 3.0, None)[: len(rows[0])]] for t in (1e4, 1e4 + 1, 1e4 + 2)]
    batches = [[r for r in rows if a <= r[2] < a + 14 and (r[1] == "fix") == fix] for a in range(0, 60, 14) for fix in (False, True)]
    batches = [[b[i] for i in rng.permutation(len(b))] for b in batches if b] + closing
    got = run_stream(spark, tmp_path, batches, lambda s: live.fusion_filter_stream(s, "device", "ts", "20 seconds"), schema, "append")
    want = devices.fusion_filter(spark.createDataFrame(rows, schema), ["device"]).toPandas()
    order = lambda f: f.sort_values(["device", "t", "kind"]).reset_index(drop=True)
    got = order(got[got["device"] != "closing"])
    pd.testing.assert_frame_equal(got[want.columns], order(want), check_dtype=False)
    assert {"started", "accepted", "rejected", "anchored"} <= set(want["verdict"].dropna()) and want["outage_s"].notna().sum() >= 3


@pytest.mark.parametrize("cuts", [[], [1], [40, 41, 170, 305, 306]])
def test_filter_in_pieces_is_that_of_a_row_loop(cuts):
    rng = np.random.default_rng(2)
    fix = np.arange(360) % 9 == 0
    fix[120:190] = False
    e = np.arange(360) * 0.9 + np.where((np.arange(360) > 290) & (np.arange(360) < 330), 200.0, 0.0)
    rows = pd.DataFrame({"kind": np.where(fix, "fix", "imu"), "t": np.arange(360) * 0.1, "omega": rng.normal(0, 0.02, 360), "accel": rng.normal(0, 0.2, 360), "e": e, "n": rng.normal(0, 1, 360), "speed": 9.0, "course": 1.5, "sigma": 3.0, "stationary": rng.random(360) < 0.02})
    want, _ = slow_loops.run_filter(rows)
    parts, carry = [], None
    for part in np.split(np.arange(360), cuts):
        out, carry = devices.filter_step(rows.iloc[part], carry)
        parts.append(out)
    pd.testing.assert_frame_equal(pd.concat(parts, ignore_index=True), want, check_dtype=False)
    none, same = devices.filter_step(rows.iloc[:0], carry)
    assert len(none) == 0 and same == carry
