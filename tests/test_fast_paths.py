"""Vectorised cores against the slow loops they stand for, over whole sessions of the test tables and odd ones."""

import math
import os

import numpy as np
import pandas as pd
import pytest
import slow_loops
from pyspark.sql import functions as F

from roadtrace.operators import align, features, groups, reckon, roads, rollout
from roadtrace.queries import journeys
from roadtrace.queries.views import AXES, imu_vec, long_samples
from roadtrace.sources import sinks
from roadtrace.streaming import devices

D = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def slow_mean(x, tau, dt):
    out, state = [], None
    for v in x:
        state = v if state is None else state + (1 - math.exp(-dt / tau)) * (v - state)
        out.append(state)
    return out


@pytest.mark.parametrize("tau", [0.01, 0.5, 30.0, 1e5])
def test_exponential_mean_is_the_loop(tau):
    x = np.random.default_rng(1).normal(0, 5, (3, 9000))
    got = features.exponential_mean(x, tau)
    assert np.allclose(got, [slow_mean(r, tau, 0.1) for r in x], atol=1e-9)
    assert np.allclose(features.exponential_mean(x[0, 4000:], tau, before=got[0, 3999]), got[0, 4000:], atol=1e-9)


def test_mean_of_a_long_session(spark):
    """100,000 rows in one session beside short ones, over many batches; a NULL stays."""
    rows = spark.range(100_000).select(F.lit("long").alias("s"), F.col("id").alias("row_idx"), (F.col("id") % 97).cast("double").alias("x"))
    short = spark.createDataFrame([("a", 0, 1.0), ("a", 1, None), ("a", 2, 3.0), ("b", 0, None), (None, 0, 4.0), (None, 1, 6.0)], "s string, row_idx long, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        got = features.ema(rows.unionByName(short), ["s"], "x", "y", 0.5).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    own = got[got["s"] == "long"].sort_values("row_idx")["y"]
    assert np.allclose(own, slow_mean([i % 97 for i in range(100_000)], 0.5, 0.1)) and len(got) == 100_006
    small = {(r.s if isinstance(r.s, str) else None, r.row_idx): None if pd.isna(r.y) else r.y for r in got[got["s"] != "long"].itertuples()}
    assert small["a", 0] == 1.0 and small["a", 1] is None and small["a", 2] is None and small["b", 0] is None
    assert small[None, 0] == 4.0 and small[None, 1] == pytest.approx(4 + 2 * (1 - math.exp(-0.2)))


def test_groups_of_an_arrow_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"a": [None, None, 1, 1, 2], "b": ["x", "x", "x", "y", "y"]})
    assert groups.starts_of(batch, ["a", "b"]).tolist() == [0, 2, 3, 4] and groups.key_at(batch, ["a", "b"], 1) == (None, "x")


@pytest.mark.parametrize("size", [1, 2, 3, 5, 100])
def test_whole_groups_over_batches(size):
    import pyarrow as pa

    lengths, keys = [3, 1, 9, 2, 4, 1], [(None, 1.0), ("x", 1.0), ("x", math.nan), ("x", None), ("y", math.nan), ("y", None)]
    rows = [k for k, n in zip(keys, lengths, strict=True) for _ in range(n)]
    table = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), pa.array(range(len(rows)))], ["a", "b", "i"])
    parts, found = [table.slice(i, size) for i in range(0, len(rows), size)], []
    for batch, at in groups.whole_groups(iter([table.slice(0, 0), *parts]), ["a", "b"]):
        i = batch.column("i").to_numpy()
        found += [i[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(x) for x in found] == lengths and [x for f in found for x in f] == [*range(len(rows))]


def test_control_speeds_of_many_episodes_are_those_of_each():
    rng = np.random.default_rng(2)
    a, c, g, v0 = rng.normal(0, 2, (5, 40)), rng.normal(0, 0.2, (5, 40)), np.abs(rng.normal(0, 0.04, (5, 40))), np.array([0.1, 9, 0.5, 3, 0.7])
    grid = rollout.speed_grid()
    together = rollout.control_speeds(a, c, g, v0, grid)
    for i in range(5):
        assert np.allclose(together[:, i], rollout.control_speeds(a[i], c[i], g[i], v0[i], grid))


def test_episodes_of_one_length_come_together(monkeypatch):
    monkeypatch.setattr(rollout, "TOGETHER", 20)
    rows = pd.DataFrame([(e, 2 + e % 2, i) for e in range(30) for i in range(3 + e % 4)], columns=["e", "duration", "step"])
    seen = []
    for d, f, m, n in rollout._alike((rows.iloc[a : a + 7] for a in range(0, len(rows), 7)), ["e"]):
        assert len(f) == m * n and (f["duration"] == d).all() and (f["step"].to_numpy().reshape(m, n) == np.arange(n)).all()
        seen += f["e"].unique().tolist()
    assert sorted(seen) == list(range(30))


# --- the filter


def filter_frame(rng, n):
    fix = rng.random(n) < 0.25
    t = np.sort(np.round(rng.uniform(0, n * 0.3, n), 2))
    jump = np.where(rng.random(n) < 0.3, 400.0, 0.0)
    return pd.DataFrame({
        "kind": np.where(fix, "fix", "imu"), "t": t, "omega": rng.normal(0, 0.1, n), "accel": np.where(rng.random(n) < 0.2, np.nan, rng.normal(0, 1, n)),
        "e": 5 * t + jump + rng.normal(0, 3, n), "n": -2 * t + rng.normal(0, 3, n), "speed": np.abs(rng.normal(4, 3, n)), "course": rng.uniform(-3, 3, n), "sigma": 4.0,
        "stationary": rng.random(n) < 0.1,
    })


def test_filter_bank_is_the_filter_of_each_session():
    rng = np.random.default_rng(7)
    parts = [filter_frame(rng, n) for n in (1, 40, 3, 77, 120)]
    rows = pd.concat(parts, ignore_index=True)
    size = np.array([len(p) for p in parts])
    columns = {c: rows[c].to_numpy(float) for c in ("t", "omega", "accel", "e", "n", "speed", "course", "sigma")} | {"fix": (rows["kind"] == "fix").to_numpy(), "stationary": rows["stationary"].to_numpy()}
    got = pd.DataFrame(devices.FilterBank(len(parts)).run(columns, np.cumsum(size) - size, size))
    want = pd.concat([slow_loops.run_filter(p)[0] for p in parts], ignore_index=True)
    assert set(want["verdict"].dropna()) == {"started", "accepted", "rejected", "anchored"} and want["outage_s"].notna().any()
    for c in got.columns:
        if c == "verdict":
            assert got[c].tolist() == [None if pd.isna(v) else v for v in want[c]]
        else:
            assert np.allclose(got[c], want[c].astype(float), rtol=1e-7, atol=1e-9, equal_nan=True), c


@needs_tables
def test_filter_states_and_recovery_of_the_query(spark, monkeypatch):
    """r7 and r9 over all their rows against one scalar filter for each session, in pieces that cut sessions."""
    monkeypatch.setattr(devices, "GATHER_ROWS", 130)
    rows = journeys.filter_rows(spark, D).toPandas().sort_values(["session_key", "t", "kind"])
    want = {k: slow_loops.run_filter(f)[0] for k, f in rows.groupby("session_key")}
    got = {k: f.reset_index(drop=True) for k, f in journeys.r7_filter_states(spark, D).toPandas().sort_values(["session_key", "t", "kind"]).groupby("session_key")}
    assert set(got) == set(want)
    for k in want:
        for c in ("east", "north", "heading", "speed", "gyro_bias", "accel_bias", "pos_sigma", "error_m"):
            assert np.allclose(got[k][c].astype(float), want[k][c].astype(float), rtol=1e-7, atol=1e-9, equal_nan=True)
        assert got[k]["verdict"].fillna("").tolist() == want[k]["verdict"].fillna("").tolist()
    fewer = rows[(rows["kind"] == "imu") | ((rows["t"] / 0.2).astype(int) % 25 == 0)]
    ended = [(k, r.t, round(r.outage_s, 6), round(r.error_m, 6)) for k, f in fewer.groupby("session_key") for r in slow_loops.run_filter(f)[0].itertuples() if not pd.isna(r.outage_s)]
    found = [(r["session_key"], r["t"], round(r["outage_s"], 6), round(r["error_m"], 6)) for r in journeys.r9_recovery_stats(spark, D).collect()]
    assert sorted(found) == sorted(ended) and found


# --- queries without SQL, over their own rows


@needs_tables
def test_alignment_states_of_the_query(spark):
    v = imu_vec(spark, D).toPandas().sort_values(["session_key", "row_idx"])
    want = set()
    for key, f in v.groupby("session_key"):
        for known in (True, False):
            speed = np.where(f["row_idx"] % 2 == 0, 0.1, 5.0) if known else np.full(len(f), np.nan)
            states = slow_states(f[AXES[:3]].to_numpy(), f[AXES[6:]].to_numpy(), speed, 5, 10.0, 0.01)
            want |= {(key, known, s, states.count(s)) for s in set(states)}
    got = {(r["session_key"], r["with_speed"], r["state"], r["rows"]) for r in journeys.r10_alignment_states(spark, D).collect()}
    assert got == want


def slow_states(acc, gyro, speed, window, acc_var, gyro_var):
    state, up, straight, out = "UNCALIBRATED", None, 0, []
    spread = lambda x: sum(((x[:, j] - x[:, j].mean()) ** 2).mean() for j in range(3))
    for i in range(len(acc)):
        if i >= window - 1:
            a, g = acc[i - window + 1 : i + 1], gyro[i - window + 1 : i + 1]
            known = not math.isnan(speed[i])
            if state == "UNCALIBRATED":
                if spread(a) < acc_var and (speed[i] < 0.2 if known else spread(g) < gyro_var) and np.linalg.norm(a.mean(axis=0)) > 0:
                    state, up = "Z_ALIGNED", a.mean(axis=0) / np.linalg.norm(a.mean(axis=0))
            elif state == "Z_ALIGNED":
                if abs(gyro[i] @ up) < 0.05:
                    flat = acc[i] - 9.81 * up
                    flat = flat - (flat @ up) * up
                    straight += not known
                    if (known and speed[i] > 1 and np.linalg.norm(flat) > 0.5) or straight >= 100:
                        state = "FULLY_ALIGNED"
            elif spread(g) > 50 * gyro_var:
                state, straight = "UNCALIBRATED", 0
        out.append(state)
    return out


@needs_tables
def test_straightest_segments_of_the_query(spark):
    """Every start and end by hand."""
    s = long_samples(spark, D).toPandas().sort_values(["session_key", "row_idx"])
    want = {}
    for key, f in s.groupby("session_key"):
        v, h = f["speed_kmh"].to_numpy() / 3.6, np.radians(f["heading_deg"].to_numpy())
        turn = np.concatenate([[0], np.cumsum(np.abs((np.diff(h) + math.pi) % (2 * math.pi) - math.pi))])
        cum, start, best = np.cumsum(v) / 10, 1, None
        while start < len(v) - 5:
            end = next((j for j in range(len(v)) if cum[j] >= cum[start] + 200.0), len(v))
            if end >= len(v) or end - start < 5 or v[start:end].mean() < 3.0 or v[start - 1 : start].min() < 1.0:
                start += 30
                continue
            total = turn[end - 1] - turn[start]
            if best is None or total < best[2] - 1e-12:
                best = (start, end, total)
            start += 20
        if best:
            want[key] = best
    got = {r["session_key"]: (r["start"], r["end"], r["turning"]) for r in journeys.e4_straightest_segment(spark, D).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and want
    assert all(got[k][2] == pytest.approx(want[k][2]) for k in want)


@needs_tables
def test_ridge_calibration_of_the_query(spark):
    """Fit on the first half of each session, rolled through the rest, step by step."""
    v = imu_vec(spark, D).toPandas().sort_values(["session_key", "row_idx"])
    per = {"causal_ridge": [], "hold_last_speed": []}
    for _, f in v.groupby("session_key"):
        x = f[AXES].to_numpy()
        linear, gyro = x[:, 0] - x[:, 3], np.linalg.norm(x[:, 6:], axis=1)
        mean = lambda c: np.array([c[i - 4 : i + 1].mean() if i >= 4 else np.nan for i in range(len(c))])
        m, speed = np.stack([mean(linear), mean(gyro)], axis=1), 10 + x[:, 2]
        dv = np.concatenate([[np.nan], np.diff(speed)])
        half = len(f) // 2
        fit = [i for i in range(half + 1) if np.isfinite(m[i]).all() and np.isfinite(dv[i])]
        coef, intercept = rollout.ridge_solve(m[fit], dv[fit], 100.0)
        rolled = [speed[half]]
        for i in range(half + 1, len(f)):
            rolled.append(max(0.0, rolled[-1] + intercept + float(m[i] @ coef)))
        truth = speed[half:]
        for name, p in (("causal_ridge", np.array(rolled)), ("hold_last_speed", np.full(len(truth), speed[half]))):
            per[name].append(np.abs(p - truth)[1:].mean() * 3.6)
    got = {r["model"]: r.asDict() for r in journeys.e16_causal_ridge_calibration(spark, D).collect()}
    assert set(got) == set(per)
    for name, errors in per.items():
        mae = next(v for k, v in got[name].items() if "mae" in k)
        assert mae == pytest.approx(np.mean(errors), rel=1e-6)


def test_many_blackouts_are_calibrated_and_reckoned_by_one_call(spark):
    """Groups of one to thirty rows, one with a null key and one with gaps, over batches of seven rows: what each gives alone."""
    rng, rows, frames = np.random.default_rng(3), [], {}
    for g in range(40):
        n = 1 + g % 30
        f = pd.DataFrame(rng.normal(0, 1, (n, len(reckon.CHANNELS))), columns=reckon.CHANNELS).assign(gravity_z=9.81, speed=rng.uniform(5, 15, n), course_deg=rng.uniform(0, 20, n), az_deg=50.0, gt_e=np.arange(n) + 0.5, gt_n=1.0)
        if g == 29:
            f.loc[3, "speed"] = np.nan
        if g == 23:
            f.loc[2, "gravity_y"] = np.nan
        frames[None if g == 7 else g] = f
        rows += [(None if g == 7 else g, i, *[None if pd.isna(x) else x for x in r]) for i, r in enumerate(f.itertuples(index=False))]
    df = spark.createDataFrame(rows, "key long, step int, " + ", ".join(f"{c} double" for c in f)).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = reckon.calibrate(df, ["key"], "step")
        cal = {r["key"]: r for r in found.collect()}
        tracks = {m: reckon.dead_reckon(df, found, ["key"], *m) for m in (("const", "gyro"), ("ins", "fused"))}
        ends = {m: {r["key"]: r for r in t.collect()} for m, t in tracks.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for out in (found, *tracks.values()):
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert cal.keys() == {g for g, f in frames.items() if len(f) > 1} and len(cal) == 38
    for g, r in cal.items():
        f = frames[g]
        acc, gravity, gyro = reckon._arrays(f)
        course, az = np.radians(f["course_deg"].to_numpy()), np.radians(f["az_deg"].to_numpy())
        want = reckon.calibrate_window(acc, gravity, gyro, f["speed"].to_numpy(), course, az)
        if g == 29:
            assert r["accel_bias"] is None and r["yaw_bias"] == pytest.approx(want["yaw_bias"])
            continue
        if g == 23:
            assert r["up"] == r["forward"] == [None] * 3 and r["accel_bias"] is None and all(end[g]["drift_percent"] is None for end in ends.values())
            continue
        assert r["up"] == pytest.approx(want["up"]) and r["forward"] == pytest.approx(want["forward"])
        assert [r[c] for c in ("accel_bias", "yaw_sign", "yaw_bias", "corr", "az_offset")] == pytest.approx([want[c] for c in ("accel_bias", "yaw_sign", "yaw_bias", "corr", "az_offset")])
        for m, end in ends.items():
            if g is not None:
                e, n, _, _ = reckon.reckon_track(acc, gravity, gyro, f["speed"].to_numpy(), course, az, want, *m)
                assert end[g]["final_error_m"] == pytest.approx(math.hypot(e[-1] - f["gt_e"].iloc[-1], n[-1] - 1.0))
                assert end[g]["distance_m"] == pytest.approx(f["speed"].sum() / 10)
    for m, end in ends.items():
        assert end.keys() == cal.keys() - {None}
        assert (end[29]["drift_percent"] is None) and (end[29]["distance_m"] is None)


def test_calibration_of_one_row_gives_none(spark):
    row = {c: 0.0 for c in reckon.CHANNELS} | {"gravity_z": 9.81, "speed": 1.0, "course_deg": 0.0, "az_deg": 0.0, "key": "a", "row_idx": 0}
    assert reckon.calibrate(spark.createDataFrame([row]), ["key"]).count() == 0


# --- roads


def test_match_path_is_viterbi():
    """Random candidates on a small lattice, with gaps."""
    rng = np.random.default_rng(9)
    links = [((x, y), (x + a, y + b)) for x in range(5) for y in range(5) for a, b in ((1, 0), (0, 1)) if x + a < 5 and y + b < 5]
    g = pd.DataFrame([(f"{a}-{b}", str(a), str(b), 100.0 * a[0], 100.0 * a[1], 100.0 * b[0], 100.0 * b[1], 100.0) for a, b in links], columns=["edge", "a", "b", "ae", "an", "be", "bn", "length"])
    for cap in (150.0, 2000.0):
        seen = rng.uniform(0, 400, (60, 2))
        steps = []
        for p in seen:
            own = g.iloc[rng.choice(len(g), rng.integers(0, 9), replace=False)]
            feet = own[["ae", "an"]].to_numpy() + rng.random((len(own), 1)) * (own[["be", "bn"]].to_numpy() - own[["ae", "an"]].to_numpy())
            steps.append([(e, tuple(f), float(np.linalg.norm(f - p)) / 9) for e, f in zip(own["edge"], feet, strict=True)])
        want = roads.viterbi(steps, [tuple(p) for p in seen], roads._Router(g, cap), 25.0, 12.0)
        assert roads.match_path(steps, seen, roads._Router(g, cap), 25.0, 12.0) == want and -1 in want
    assert roads.match_path([[], []], seen[:2], roads._Router(g, 10.0), 25.0, 12.0) == [-1, -1]


def test_trajectories_in_one_layout_are_matched_each_for_itself():
    """Drives of 0, 1 and more rows one after the other; no route from one to the next is searched."""
    rng = np.random.default_rng(4)
    g = pd.DataFrame([(f"{x}", str(x), str(x + 1), 100.0 * x, 0.0, 100.0 * (x + 1), 0.0, 100.0) for x in range(40)], columns=["edge", "a", "b", "ae", "an", "be", "bn", "length"])
    want, steps, seen, group = [], [], [], []
    for n, (rows, start) in enumerate(((30, 0), (1, 20), (5, 35), (40, 10))):
        own_seen = np.column_stack([100.0 * start + np.cumsum(rng.uniform(0, 20, rows)), np.zeros(rows)])
        own = []
        for e, _ in own_seen:
            near = [x for x in (int(e // 100) - 1, int(e // 100)) if 0 <= x < 40][: rng.integers(0, 3)] if n != 2 else []
            own.append([(str(x), (float(np.clip(e, 100 * x, 100 * x + 100)), 0.0), float(abs(e - np.clip(e, 100 * x, 100 * x + 100))) + 1) for x in near])
        want += roads.viterbi(own, [tuple(p) for p in own_seen], roads._Router(g, 400.0), 25.0, 12.0)
        steps, seen, group = steps + own, [*seen, *own_seen], group + [n] * rows
    flat = [c for s in steps for c in s]
    route = roads._Router(g, 400.0)
    path = roads._Path(np.array([len(s) for s in steps]), np.array([c[0] for c in flat], object), np.array([c[1] for c in flat]), np.array([c[2] for c in flat]), np.array(seen), route, 25.0, 12.0, np.array(group))
    assert path.chosen().tolist() == want and -1 in want
    assert all(abs(int(u) - int(v)) < 5 for u, known in route.known.items() for v in known)


def test_search_for_targets_is_the_whole_search():
    rng = np.random.default_rng(5)
    for cap in (40.0, 120.0, 1e9):
        graph: dict = {}
        for a, b, w in zip(rng.integers(0, 60, 110).tolist(), rng.integers(0, 60, 110).tolist(), rng.uniform(1, 40, 110), strict=True):
            graph.setdefault(a, []).append((b, w))
            graph.setdefault(b, []).append((a, w))
        for u in range(62):
            targets = set(rng.integers(0, 62, 6).tolist())
            whole = roads.shortest_paths(graph, u, cap)
            assert roads.shortest_paths(graph, u, cap, targets) == {v: whole[v] for v in targets if v in whole}


@pytest.mark.parametrize("block", [7, 20, 1000])
def test_matching_in_blocks_is_viterbi(spark, block):
    """Two drives with rows without candidates, one of them for longer than a block; and a null key."""
    rng = np.random.default_rng(block)
    links = [((x, y), (x + a, y + b)) for x in range(6) for y in range(6) for a, b in ((1, 0), (0, 1)) if x + a < 6 and y + b < 6]
    g = pd.DataFrame([(f"{a}-{b}", str(a), str(b), 100.0 * a[0], 100.0 * a[1], 100.0 * b[0], 100.0 * b[1], 100.0) for a, b in links], columns=["edge", "a", "b", "ae", "an", "be", "bn", "length"])
    points, cands, want = [(None, 0, 5.0, 6.0)], [], {(None, 0): (None, 5.0, 6.0)}
    for key, silent in (("x", range(22, 65)), ("y", range(0, 9))):
        seen = np.cumsum(rng.normal(0, 40, (90, 2)), axis=0) % 500
        steps = []
        for t, p in enumerate(seen):
            own = g.iloc[rng.choice(len(g), 0 if t in silent else rng.integers(0, 7), replace=False)]
            feet = own[["ae", "an"]].to_numpy() + rng.random((len(own), 1)) * (own[["be", "bn"]].to_numpy() - own[["ae", "an"]].to_numpy())
            steps.append([(e, (float(f[0]), float(f[1])), float(np.linalg.norm(f - p)) / 9) for e, f in zip(own["edge"], feet, strict=True)])
            points.append((key, t, float(p[0]), float(p[1])))
            cands += [(key, t, i + 1, *c[:1], *c[1], c[2]) for i, c in enumerate(steps[-1])]
        for t, i in enumerate(roads.viterbi(steps, [tuple(p) for p in seen], roads._Router(g, 400.0), 25.0, 12.0)):
            want[key, t] = (steps[t][i][0], *steps[t][i][1]) if i >= 0 else (None, *map(float, seen[t]))
    p = spark.createDataFrame(points, "k string, row_idx long, e double, n double")
    c = spark.createDataFrame(cands, "k string, row_idx long, rank int, edge string, foot_e double, foot_n double, distance double")
    out = roads.hmm_match(p, c, spark.createDataFrame(g), ["k"], 800.0, cap=400.0, block=block)
    got = {(r["k"], r["row_idx"]): (r["edge"], r["match_e"], r["match_n"]) for r in out.collect()}
    assert got == want and dict(out.dtypes)["row_idx"] == "bigint"
    assert roads.hmm_match(p.limit(0), c, spark.createDataFrame(g), ["k"], 800.0, block=block).count() == 0


def test_expanding_radius_is_the_first_that_finds_an_edge(spark):
    edges = spark.createDataFrame([(f"s{i}", f"a{i}", f"b{i}", 0.0, 100.0 * i, 1000.0, 100.0 * i, 1000.0) for i in range(4)], "edge string, a string, b string, ae double, an double, be double, bn double, length double")
    points = spark.createDataFrame([(i, 500.0, float(n)) for i, n in enumerate((3, 45, 330, 399, 480, 900))], "id int, e double, n double")
    got = {(r["id"], r["edge"], r["radius"]) for r in roads.near_edges_expanding(points, edges, ["id"], 20.0, 150.0).collect()}
    want = set()
    for i, n in enumerate((3, 45, 330, 399, 480, 900)):
        for radius in (20.0, 40.0, 80.0, 160.0):
            own = {(i, f"s{j}", radius) for j in range(4) if abs(n - 100 * j) <= radius}
            if own:
                want |= own
                break
    assert got == want


# --- alignment and replays


def test_lag_profile_in_blocks_is_the_profile_of_the_whole(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, n in (("a", 900), ("b", 130), ("flat", 300), ("short", 20)):
        y = rng.normal(0, 1, n) if key != "flat" else np.ones(n)
        x = np.roll(y, 5) + rng.normal(0, 0.3, n)
        x[rng.random(n) < 0.1] = np.nan
        want[key] = align.profile(x, y, 30, 100)
        rows += [(key, i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    out = align.lag_profile(spark.createDataFrame(rows, "k string, row_idx long, x double, y double"), ["k"], ["x"], "y", 30, 100, block=64).toPandas()
    for key, w in want.items():
        own = out[out["k"] == key].sort_values("lag")
        assert own["lag"].tolist() == list(range(-30, 31)) and np.allclose(own["corr"].astype(float), w, equal_nan=True)


@pytest.mark.parametrize("block", [40, 130, 5000])
def test_lag_sweep_in_blocks_is_that_of_whole_sessions(spark, block):
    """Ties, gaps of values, a constant speed, a shorter vehicle, a missing one, a null key and a lag beyond a session."""
    rng = np.random.default_rng(block)
    phone, vehicle = [], []
    for key, n, m in (("a", 700, 700), ("b", 300, 251), ("still", 400, 400), ("alone", 200, 0), ("short", 15, 15), (None, 160, 160), ("dark", 150, 150)):
        lat, lon = 52 + np.cumsum(rng.normal(0, 1e-4, n)), -1.5 + np.cumsum(rng.normal(0, 1e-4, n))
        if key == "still":
            lat[:], lon[:] = 52.0, -1.5
        speed = np.where(rng.random(n) < 0.1, np.nan, 50 + 10 * np.sin(np.arange(n) / 9)) if key != "still" else np.full(n, 3.0)
        if key == "dark":
            lat[:] = np.nan
        value = lambda x: None if np.isnan(x) else float(x)
        phone += [(key, i, value(speed[i]), value(lat[i]), value(lon[i])) for i in range(n)]
        vehicle += [(key, i, value(speed[i - 4]) if i >= 4 else None, value(lat[i] + (rng.normal(0, 1e-4) if key != "still" else 0.0)), value(lon[i])) for i in range(m)]
    p = spark.createDataFrame(phone, "k string, row_idx int, speed_kmh double, lat double, lon double").repartition(3)
    v = spark.createDataFrame(vehicle, "k string, row_idx int, velocity_kmh double, vehicle_lat double, vehicle_lon double").repartition(3)
    order = lambda df: df.toPandas().sort_values(["k", "lag"]).reset_index(drop=True)
    want, got = (order(align.lag_sweep(p, v, ["k"], 25, block=x)) for x in (10**9, block))
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-9, atol=1e-9)
    exact = ("median_separation", "p95_separation")
    assert all((got[c].isna() | (np.abs(got[c] - want[c]) <= 1e-12 * want[c].abs())).all() for c in exact) and want["speed_corr"].notna().sum() > 100 and len(want) == 5 * 51 + 29
    assert align.lag_sweep(p.limit(0), v, ["k"], 25, block=block).isEmpty()


def test_replays_of_many_blackouts(spark):
    truth = spark.createDataFrame([(k, i, 52.0, -1.5, 10.0) for k in "ab" for i in range(60)], "k string, row_idx long, lat double, lon double, speed double")
    dark = spark.createDataFrame([("a", 4, 10), ("a", 30, 40), ("b", 20, 25)], "k string, start long, end long")
    track = dark.withColumn("row_idx", F.explode(F.expr("sequence(start, end - 1)"))).select("k", "start", "row_idx", F.lit(3.0).alias("e"), F.lit(4.0).alias("n"))
    out = sinks.replays(truth, track, track, dark, ["k"], 52.0, -1.5, 5, 6, 2).collect()
    want = {(k, s, i) for k, s, e in (("a", 4, 10), ("a", 30, 40), ("b", 20, 25)) for i in range(s - 5, e + 6, 2) if 0 <= i < 60}
    assert {(r["k"], r["start"], r["row_idx"]) for r in out} == want
    assert all((r["free_drift_m"] == 5.0) == (r["start"] <= r["row_idx"] < r["end"]) == (r["mode"] == "BLACKOUT") for r in out)


def test_blackouts_of_a_long_drive():
    """The greedy scan step by step."""
    rng = np.random.default_rng(12)
    v = np.abs(rng.normal(8, 4, 3000))
    got, cum, s = [], np.cumsum(v) / 10, 50
    while s < len(v) - 5:
        e = next((j for j in range(len(v)) if cum[j] >= cum[s] + 60.0), len(v))
        ok = e < len(v) and e - s >= 5 and v[s:e].mean() >= 3.0 and v[s - 50 : s].min() >= 0.0
        if ok:
            got.append((s, e))
        s = e if ok else s + 20
    assert slow_loops.scan(v, 60.0, 50, 10.0, 3.0, 2.0, 0, 5, 0.0) == got and len(got) > 20




def test_lag_sweep_in_blocks_computes_no_round_twice(spark):
    from roadtrace.operators import align

    p = spark.range(300).selectExpr("'a' as k", "id as row_idx", "double(id % 17) as speed_kmh", "52 + id / 1e4 as lat", "-1.5 + id % 5 / 1e3 as lon")
    v = p.selectExpr("k", "row_idx", "speed_kmh as velocity_kmh", "lat as vehicle_lat", "lon as vehicle_lon")
    out = align.lag_sweep(p, v, ["k"], 5, block=100)
    # what is left to do in Python is the sweep of sessions that are not cut
    assert out._jdf.queryExecution().optimizedPlan().toString().count("InPandas") == 1
