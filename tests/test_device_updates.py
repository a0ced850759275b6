"""Zero-velocity updates of the fusion filter and the forward axis of the mounting."""

import math

import numpy as np
import pandas as pd
import pytest
import slow_loops
from pyspark.sql import functions as F

from roadtrace.streaming import devices


def outage(still):
    """Ten seconds of driving east with fixes, one of braking that is felt as a little less than it is, then nine at rest at 52.5 m without any fix."""
    rows = []
    for i in range(200):
        fix, at_rest = i % 10 == 0 and i < 100, i > 110
        rows.append(("fix" if fix else "imu", i * 0.1, 0.0, -4.5 if 100 < i <= 110 else 0.0, min(i, 100) * 0.5, 0.0, 5.0, math.pi / 2, 3.0, at_rest if still else None))
    return pd.DataFrame(rows, columns=["kind", "t", "omega", "accel", "e", "n", "speed", "course", "sigma", "stationary"])


def test_a_device_at_rest_in_an_outage_stays_where_it_is():
    out, state = slow_loops.run_filter(outage(True))
    assert out["speed"].iloc[-1] == pytest.approx(0, abs=0.02) and out["east"].iloc[-1] == pytest.approx(52.5, abs=2) and state["walked"] < 1
    moving, _ = slow_loops.run_filter(outage(False))
    assert moving["speed"].iloc[-1] > 0.3 and moving["east"].iloc[-1] > out["east"].iloc[-1] + 3
    without, _ = slow_loops.run_filter(outage(False).drop(columns="stationary"))
    pd.testing.assert_frame_equal(moving, without)


def test_batch_and_recovery_use_the_flag(spark):
    rows = pd.concat([outage(True), pd.DataFrame([("fix", 20.0, 0.0, 0.0, 52.5, 0.0, 0.0, 0.0, 3.0, None)], columns=outage(True).columns)])
    df = spark.createDataFrame([("a", *r) for r in rows.itertuples(index=False)], "device string, kind string, t double, omega double, accel double, e double, n double, speed double, course double, sigma double, stationary boolean")
    r = devices.recovery_stats(devices.fusion_filter(df, ["device"]), ["device"]).collect()
    assert len(r) == 1 and r[0]["outage_m"] < 1 and r[0]["error_m"] < 3


def test_forward_axis_from_the_braking_spike_without_a_speed(spark):
    rng = np.random.default_rng(5)
    forward = np.array([math.cos(0.7), math.sin(0.7), 0.0])
    push = rng.normal(0, 0.6, 160)
    push[60] = -6.0
    push[:20] = 0
    acc = np.array([0, 0, 9.81]) + push[:, None] * forward
    rows = [("a", i, *map(float, acc[i]), 0.0, 0.0, 0.0) for i in range(160)]
    df = spark.createDataFrame(rows, "d string, row_idx long, ax double, ay double, az double, gx double, gy double, gz double").withColumn("v", F.lit(None).cast("double"))
    out = devices.alignment_states(df, ["d"], ("ax", "ay", "az"), ("gx", "gy", "gz"), "v").orderBy("row_idx").collect()
    assert out[118]["state"] == "Z_ALIGNED" and out[118]["axis"] is None and out[159]["state"] == "FULLY_ALIGNED"
    assert out[159]["axis"] == pytest.approx(forward.tolist(), abs=0.02)
