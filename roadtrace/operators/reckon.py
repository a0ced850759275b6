"""Calibration before a blackout and dead reckoning through it.

The numpy cores are small pure functions of one episode's arrays; Spark groups the
rows. An episode has some hundred rows, so a group is always small, and many of them are handed to Python at once.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c
from roadtrace.operators.groups import apart, apart_in_order, doubles, of_groups, whole_groups

RATE = 10.0
#: Values by which ``lowpass`` extends a series at either end.
PAD = 9


def butterworth(cutoff: float, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Second-order low-pass by the bilinear transform: numerator, denominator."""
    k = 1.0 / math.tan(math.pi * cutoff / rate)
    q = math.sqrt(2.0)
    d = 1.0 + q * k + k * k
    return np.array([1.0, 2.0, 1.0]) / d, np.array([1.0, 2.0 * (1.0 - k * k) / d, (1.0 - q * k + k * k) / d])


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    out, (z1, z2) = np.empty(x.shape), z
    for i, v in enumerate(x):
        y = b[0] * v + z1
        z1 = b[1] * v - a[1] * y + z2
        z2 = b[2] * v - a[2] * y
        out[i] = y
    return out


#: Rows up to which a series is filtered by a matrix, which takes 8 x rows x rows bytes.
SHORT = 256


@functools.lru_cache(maxsize=64)
def _lowpass_matrix(n: int, cutoff: float, rate: float) -> np.ndarray:
    """The filter of ``n`` values as a matrix: it is linear, so its columns are the filtered unit series."""
    return _lowpass(np.eye(n), cutoff, rate)


def lowpass(x: np.ndarray, cutoff: float = 0.5, rate: float = RATE) -> np.ndarray:
    """Zero-phase low-pass: forward and backward with odd extension and steady-state starts; short series are returned as they are."""
    x = np.asarray(x, float)
    if len(x) <= PAD:
        return x.copy()
    if len(x) <= SHORT and np.isfinite(x).all():
        return _lowpass_matrix(len(x), cutoff, rate) @ x
    return _lowpass(x, cutoff, rate)


def _lowpass(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    b, a = butterworth(cutoff, rate)
    pad = PAD
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    # state of a constant input of 1: the gain at rest is 1
    zi = (1.0 - b[0], b[2] - a[2])
    y = _filter(b, a, ext, [z * ext[0] for z in zi])
    y = _filter(b, a, y[::-1], [z * y[-1] for z in zi])[::-1]
    return y[pad:-pad]


def horizontal_basis(up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ref = np.array([0.0, 1.0, 0.0]) if abs(up[0]) > 0.9 else np.array([1.0, 0.0, 0.0])
    e1 = np.cross(up, ref)
    e1 /= np.linalg.norm(e1)
    return e1, np.cross(up, e1)


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    sa, sb = a.std(), b.std()
    return float(((a - a.mean()) * (b - b.mean())).mean() / (sa * sb)) if sa > 0 and sb > 0 else 0.0


def forward_axis(linear: np.ndarray, up: np.ndarray, dv: np.ndarray, angles: int = 180) -> tuple[np.ndarray, float]:
    """The horizontal axis along which the smoothed acceleration correlates best with the change of speed, and how well (-2: nothing moves).

    The correlation of every candidate direction follows from six moments of the two horizontal channels.
    """
    e1, e2 = horizontal_basis(up)
    m = np.cov(np.stack([lowpass(linear @ e1), lowpass(linear @ e2), dv]), bias=True)
    turn = np.linspace(0, 2 * np.pi, angles, endpoint=False)
    ways = np.stack([np.cos(turn), np.sin(turn)])
    spread = np.sqrt(np.maximum((ways * (m[:2, :2] @ ways)).sum(axis=0), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where((spread >= 1e-6) & (m[2, 2] > 0), (m[2, :2] @ ways) / (spread * math.sqrt(max(m[2, 2], 1e-300))), -2.0)
    best = int(np.argmax(r))
    return (ways[0, best] * e1 + ways[1, best] * e2 if r[best] > -2 else e1), float(r[best])


def turn_rate(course: np.ndarray) -> np.ndarray:
    return np.gradient(np.unwrap(course)) * RATE


def yaw_rate(gyro: np.ndarray, gravity: np.ndarray) -> np.ndarray:
    """Rotation about the vertical of each sample."""
    return (gyro * (gravity / np.maximum(np.linalg.norm(gravity, axis=1, keepdims=True), 1e-6))).sum(axis=1)


def compass_offset(course: np.ndarray, azimuth: np.ndarray) -> tuple[float, float]:
    """Mean angle from azimuth to course, and how much the samples agree (0 to 1)."""
    z = np.mean(np.exp(1j * (course - azimuth)))
    return float(np.angle(z)), float(abs(z))


def calibrate_window(acc, gravity, gyro, speed, course, azimuth, angles: int = 180) -> dict:
    """Forward axis, accelerometer bias, yaw sign and bias, and compass offset from a window with fixes."""
    mean = gravity.mean(axis=0)
    up, linear, dv = mean / np.linalg.norm(mean), acc - gravity, lowpass(np.gradient(speed) * RATE)
    forward, r = forward_axis(linear, up, dv, angles)
    yaw, turning = yaw_rate(gyro, gravity), turn_rate(course)
    sign = 1.0 if _corr(yaw, turning) >= 0 else -1.0
    bias = float(np.mean(lowpass(linear @ forward) - dv))
    return {"up": up, "forward": forward, "accel_bias": bias, "yaw_sign": sign, "yaw_bias": float(np.mean(sign * yaw - turning)), "corr": r, "az_offset": compass_offset(course, azimuth)[0]}


CALIBRATION = "up array<double>, forward array<double>, accel_bias double, yaw_sign double, yaw_bias double, corr double, az_offset double"
#: What has its NaN given back as null.
_array = functools.partial(pa.array, from_pandas=True)
CHANNELS = ["acc_x", "acc_y", "acc_z", "gravity_x", "gravity_y", "gravity_z", "gyro_x", "gyro_y", "gyro_z"]


def _channels(x: np.ndarray):
    """Accelerometer, gravity and gyro [row, axis] of an array [channel, row]."""
    return x[:3].T, x[3:6].T, x[6:9].T


def _arrays(f: pd.DataFrame):
    x = f[CHANNELS].to_numpy(float)
    return x[:, :3], x[:, 3:6], x[:, 6:9]


def calibrate(df: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """``calibrate_window`` of each group: CHANNELS, speed (m/s), course_deg, az_deg; a group of one row has no rates and gives no row."""

    columns = [*CHANNELS, "speed", "course_deg", "az_deg"]

    def run(batches):
        for batch, at in whole_groups(batches, keys):
            x, found = doubles(batch, columns), {}
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if b - a > 1:
                    f = x[:, a:b].copy()
                    found[a] = calibrate_window(*_channels(f), f[9], np.radians(f[10]), np.radians(f[11]))
            yield of_groups(batch, keys, [*found], {c: _array([f[c] for f in found.values()], pa.list_(pa.float64()) if c in ("up", "forward") else pa.float64()) for c in names})

    types = dict(df.dtypes)
    names = [c.split(" ")[0] for c in CALIBRATION.split(", ")]
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), CALIBRATION])
    rows = df.select(*keys, F.col(order).alias("_order"), *[F.col(c).cast("double").alias(c) for c in columns])
    return apart_in_order(rows, keys, "_order").mapInArrow(run, schema)


def procrustes_yaw(forward_rate: np.ndarray, lateral: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[float, float]:
    """Angle that best turns horizontal channels (h1, h2) onto (forward, lateral) acceleration, and how well they then agree (0 to 1)."""
    a = float((h1 * forward_rate + h2 * lateral).sum())
    b = float((h1 * lateral - h2 * forward_rate).sum())
    size = math.sqrt(float((h1**2 + h2**2).sum()) * float((forward_rate**2 + lateral**2).sum()))
    return math.atan2(b, a), math.hypot(a, b) / size if size > 0 else 0.0


def calibrate_procrustes_window(t, acc, gravity, gyro, speed, course, azimuth, min_seconds: float = 8.0, min_corr: float = 0.3) -> dict | None:
    """Closed-form mounting yaw from kinematics on a 10 Hz grid (values held); None where the window is too short or has no signal."""
    if len(t) < 5 or t[-1] - t[0] < min_seconds:
        return None
    grid = np.arange(t[0], t[-1] + 1e-9, 0.1)
    at = np.searchsorted(t, grid + 1e-9, side="right") - 1
    acc, gravity, gyro, speed, course, azimuth = (x[at] for x in (acc, gravity, gyro, speed, course, azimuth))
    mean = gravity.mean(axis=0)
    e1, e2 = horizontal_basis(mean / np.linalg.norm(mean))
    linear, turning = acc - gravity, turn_rate(course)
    dv, lateral = lowpass(np.gradient(speed) * RATE), lowpass(-speed * turning)
    angle, fit = procrustes_yaw(dv, lateral, lowpass(linear @ e1), lowpass(linear @ e2))
    if fit < min_corr:
        return None
    forward = math.cos(angle) * e1 - math.sin(angle) * e2
    yaw = yaw_rate(gyro, gravity)
    r = _corr(lowpass(yaw), lowpass(turning))
    sign = float(np.sign(r)) if abs(r) >= 0.5 else -1.0
    offset, agreement = compass_offset(course, azimuth)
    return {"forward": forward, "fit": fit, "accel_bias": float(np.mean(lowpass(linear @ forward) - dv)), "yaw_sign": sign, "yaw_bias": float(np.mean(sign * yaw - turning)), "az_offset": offset, "compass_r": agreement}


def calibrate_procrustes(df: DataFrame, keys: list[str], time: str = "t", min_seconds: float = 8.0, min_corr: float = 0.3) -> DataFrame:
    """``calibrate_procrustes_window`` of each group; groups without a calibration give no row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(time)
        acc, gravity, gyro = _arrays(f)
        col = lambda c: f[c].to_numpy(float)
        out = calibrate_procrustes_window(col(time), acc, gravity, gyro, col("speed"), np.radians(col("course_deg")), np.radians(col("az_deg")), min_seconds, min_corr)
        rows = {k: [frame[k].iloc[0]] for k in keys} | {k: [v] for k, v in (out or {}).items()}
        names = [*keys, "forward", "fit", "accel_bias", "yaw_sign", "yaw_bias", "az_offset", "compass_r"]
        return pd.DataFrame(rows if out else {n: np.array([], object) for n in names})[names]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "forward array<double>, fit double, accel_bias double, yaw_sign double, yaw_bias double, az_offset double, compass_r double"])
    return apart(df, keys).groupBy(*keys).applyInPandas(run, schema)


def dead_reckon_windows(df: DataFrame, keys: list[str], speed_mode: str = "const", heading_mode: str = "hold", speed: str = "speed", heading: str = "heading", yaw: str | None = None, azimuth: str | None = None, series: str | None = None, rate: float = RATE, order: str = "step") -> DataFrame:
    """Positions through a blackout by running sums alone: speed const, oracle or series; heading hold, oracle, gyro or compass (radians). Row 0 stays at the origin."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    later = F.lag(F.lit(1)).over(w).isNotNull()
    v = {"const": F.first(_c(speed)).over(upto), "oracle": _c(speed)}.get(speed_mode) if speed_mode != "series" else F.greatest(_c(series), F.lit(0.0))
    first = F.first(_c(heading)).over(upto)
    if heading_mode == "gyro":
        h = first + F.sum(F.when(later, _c(yaw) / rate).otherwise(0.0)).over(upto)
    else:
        h = {"hold": first, "oracle": _c(heading)}[heading_mode] if heading_mode != "compass" else _c(azimuth)
    df = df.withColumns({"v_est": v, "h_est": h})
    step = lambda trig: F.sum(F.when(later, F.col("v_est") * trig(F.col("h_est")) / rate).otherwise(0.0)).over(upto)
    return df.withColumns({"east_est": step(F.sin), "north_est": step(F.cos)})


def reckon_track(acc, gravity, gyro, speed, course, azimuth, cal: dict, speed_mode: str, heading_mode: str, fuse_gain: float = 0.02) -> tuple[np.ndarray, ...]:
    """East, north, speed and heading through one blackout; covers the sequential modes (ins speed, fused heading)."""
    n, dt = len(speed), 1 / RATE
    up = gravity / np.maximum(np.linalg.norm(gravity, axis=1, keepdims=True), 1e-6)
    yaw = cal["yaw_sign"] * (gyro * up).sum(axis=1) - cal["yaw_bias"]
    if speed_mode == "ins":
        a = lowpass((acc - gravity) @ np.asarray(cal["forward"]) - cal["accel_bias"])
        s = np.concatenate([[speed[0]], speed[0] + np.cumsum(a[1:] * dt)])
        v = s - np.minimum(0.0, np.minimum.accumulate(s))
    else:
        v = np.full(n, speed[0]) if speed_mode == "const" else speed.copy()
    az = azimuth + cal["az_offset"]
    if heading_mode in ("hold", "oracle", "compass"):
        h = {"hold": np.full(n, course[0]), "oracle": course, "compass": az}[heading_mode]
    else:
        h = np.empty(n)
        h[0] = course[0]
        for i in range(1, n):
            h[i] = h[i - 1] + yaw[i] * dt
            if heading_mode == "fused":
                h[i] += fuse_gain * math.atan2(math.sin(az[i] - h[i]), math.cos(az[i] - h[i]))
    step = np.stack([v * np.sin(h), v * np.cos(h)]) * dt
    step[:, 0] = 0
    east, north = np.cumsum(step, axis=1)
    return east, north, v, h


def dead_reckon(df: DataFrame, calibrations: DataFrame, keys: list[str], speed_mode: str = "ins", heading_mode: str = "fused", order: str = "step") -> DataFrame:
    """Final error, distance and drift of each blackout (CHANNELS, speed, course_deg, az_deg, gt_e, gt_n) under its calibration."""
    names = ["forward", "accel_bias", "yaw_sign", "yaw_bias", "az_offset"]
    columns = [*CHANNELS, "speed", "course_deg", "az_deg", "gt_e", "gt_n", *names[1:]]

    def run(batches):
        for batch, at in whole_groups(batches, keys):
            x, found = doubles(batch, columns), []
            forward = batch.column("forward").take(pa.array(at[:-1])).to_pylist()
            for a, b, axis in zip(at[:-1].tolist(), at[1:].tolist(), forward, strict=True):
                f = x[:, a:b].copy()
                cal, v = {"forward": axis if axis is None else np.array(axis, float)} | dict(zip(names[1:], f[14:, 0].tolist(), strict=True)), f[9]
                e, n, _, _ = reckon_track(*_channels(f), v, np.radians(f[10]), np.radians(f[11]), cal, speed_mode, heading_mode)
                error = float(np.hypot(e[-1] - f[12, -1], n[-1] - f[13, -1]))
                distance = max(float(v.sum() / RATE), 1e-6)
                found.append((error, distance, 100 * error / distance))
            yield of_groups(batch, keys, at[:-1], {c: _array(v, pa.float64()) for c, v in zip(("final_error_m", "distance_m", "drift_percent"), zip(*found, strict=True), strict=True)})

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "final_error_m double, distance_m double, drift_percent double"])
    rows = df.select(*keys, F.col(order).alias("_order"), *[F.col(c).cast("double").alias(c) for c in columns[:14]])
    known = calibrations.select(*keys, "forward", *[F.col(c).cast("double").alias(c) for c in names[1:]])
    # a row for each blackout: well packed files would look small enough to be broadcast
    return apart_in_order(rows.join(known.hint("merge"), keys), keys, "_order").mapInArrow(run, schema)


def drift_stats(df: DataFrame, keys: list[str], order: str = "step", rate: float = RATE) -> DataFrame:
    """Final error, travelled distance (sum of true speed) and drift per episode of a reckoned track."""
    error = F.max_by(F.sqrt((F.col("east_est") - F.col("gt_e")) ** 2 + (F.col("north_est") - F.col("gt_n")) ** 2), order)
    out = df.groupBy(*keys).agg(error.alias("final_error_m"), F.greatest(F.sum("speed") / rate, F.lit(1e-6)).alias("distance_m"))
    return out.withColumn("drift_percent", 100 * F.col("final_error_m") / F.col("distance_m"))


def drift_curve(drifts: DataFrame, by: list[str], limit: float = 10.0) -> DataFrame:
    """Blackouts, median, least drift and share under ``limit`` percent per group."""
    return drifts.groupBy(*by).agg(F.count("*").alias("blackouts"), F.percentile("drift_percent", 0.5).alias("median_drift"), F.min("drift_percent").alias("min_drift"), (100 * F.avg((F.col("drift_percent") < limit).cast("double"))).alias("under_limit_percent"))
