"""Rollouts through blackouts and their scores.

The non-negative rollout v_k = max(0, v_{k-1} + d_k) has the closed form
S_k - min(0, least S up to k) with S the unclamped running sum, so it needs two
window passes and no sequential code.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c
from roadtrace.operators.features import exponential_mean
from roadtrace.operators.groups import cluster


def clamped_rollout(df: DataFrame, keys: list[str], initial: str, delta: str, out: str = "predicted", order: str = "step") -> DataFrame:
    """Add the rollout of ``delta`` from ``initial`` (its value on the first row), never below 0. The first row's delta counts as 0."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    start = F.first(_c(initial)).over(upto)
    step = F.when(F.lag(F.lit(1)).over(w).isNull(), 0.0).otherwise(_c(delta))
    df = df.withColumn("_s", start + F.sum(step).over(upto))
    return df.withColumn(out, F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(upto))).drop("_s")


def hold_last(df: DataFrame, keys: list[str], initial: str, out: str = "predicted", order: str = "step") -> DataFrame:
    """The baseline without any model: the speed at the start stays."""
    return df.withColumn(out, F.first(_c(initial)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def gated_rollout(df: DataFrame, keys: list[str], initial: str, delta: str, confidence: str, threshold="threshold", shrinkage="shrinkage", limit: float = 3.0, order: str = "step") -> DataFrame:
    """Rollout of predictions that are confident enough, shrunk and limited; others count as no change."""
    used = F.least(F.greatest(_c(delta) * _c(shrinkage), F.lit(-limit)), F.lit(limit))
    gated = df.withColumn("_d", F.when(_c(confidence) >= _c(threshold), used).otherwise(0.0))
    return clamped_rollout(gated, keys, initial, "_d", order=order).drop("_d")


def trapezoid(value: str, time: str, keys: list[str], order: str = "step"):
    """Area of the step that ends at each row (NULL on the first)."""
    w = W.partitionBy(*keys).orderBy(order)
    return (_c(value) + F.lag(value).over(w)) / 2 * (_c(time) - F.lag(time).over(w))


#: How a drift's denominator is kept from 0.
DENOMINATORS = ("null_below_1", "at_least_1", "at_least_1e-6")


def drift_percent(error, distance, denominator: str = "null_below_1"):
    e, d = F.abs(_c(error)), _c(distance)
    if denominator == "null_below_1":
        return F.when(d >= 1, 100 * F.try_divide(e, d))
    return 100 * e / F.greatest(d, F.lit(1.0 if denominator == "at_least_1" else 1e-6))


def score_episodes(samples: DataFrame, keys: list[str], truth: DataFrame | None = None, distance: str = "trapezoid", period: float = 0.1, denominator: str = "null_below_1", order: str = "step") -> DataFrame:
    """Per episode from samples (true_speed, predicted in m/s, elapsed): velocity errors without the start, distances and drift.

    ``distance``: trapezoid over elapsed time, trapezoid_fixed (``period`` a row) or
    sum (value times period). ``truth`` (keys, true_distance_m) replaces the true
    distance where it was taken from denser rows.
    """
    e = (F.col("predicted") - F.col("true_speed")) * 3.6
    inner = F.col(order) > 0
    if distance == "trapezoid":
        area = lambda v: trapezoid(v, "elapsed", keys, order)
    elif distance == "trapezoid_fixed":
        w = W.partitionBy(*keys).orderBy(order)
        area = lambda v: (_c(v) + F.lag(v).over(w)) / 2 * period
    else:
        area = lambda v: _c(v) * period
    s = samples.withColumns({"_e": e, "_p": area("predicted"), "_t": area("true_speed")})
    out = s.groupBy(*keys).agg(
        F.avg(F.when(inner, F.abs("_e"))).alias("velocity_mae_kmh"), F.sqrt(F.avg(F.when(inner, F.col("_e") ** 2))).alias("velocity_rmse_kmh"),
        F.max_by("_e", order).alias("final_velocity_error_kmh"), (100 * F.avg(F.when(inner, (F.abs("_e") <= 5).cast("double")))).alias("within_5_kmh_percent"),
        F.sum("_p").alias("predicted_distance_m"), F.sum("_t").alias("true_distance_m"), F.count(F.when(inner, F.col("_e"))).alias("steps"),
    )
    if truth is not None:
        out = out.drop("true_distance_m").join(truth, keys)
    out = out.withColumn("distance_error_m", F.col("predicted_distance_m") - F.col("true_distance_m"))
    return out.withColumn("drift_percent", drift_percent("distance_error_m", "true_distance_m", denominator))


def unrolled_integration(df: DataFrame, keys: list[str], speed0: str, heading0: str, acceleration: str, yaw: str, dt: float = 0.1, order: str = "step") -> DataFrame:
    """Add speed = max(0, v0 + running sum of acceleration), heading, and running east, north and distance: the clamp does not feed back, unlike the rollout's."""
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    first = lambda c: F.first(_c(c)).over(upto)
    df = df.withColumns({"speed": F.greatest(F.lit(0.0), first(speed0) + F.sum(_c(acceleration) * dt).over(upto)), "heading": first(heading0) + F.sum(_c(yaw) * dt).over(upto)})
    return df.withColumns({
        "east": F.sum(F.col("speed") * F.sin("heading") * dt).over(upto), "north": F.sum(F.col("speed") * F.cos("heading") * dt).over(upto),
        "distance": F.sum(F.col("speed") * dt).over(upto),
    })


def control_speeds(acceleration: np.ndarray, calibrated: np.ndarray, gyro: np.ndarray, v0, grid: list[dict], dt: float = 0.1) -> np.ndarray:
    """Speeds [setting, ..., sample] under drift controls: smoothing, limited correction, decay, gain, and standing still.

    The arrays are of one episode or of several of one length, [episode, sample],
    with ``v0`` of each. Each smoothing is done once.
    """
    v0 = np.asarray(v0, float)[..., None]
    elapsed = np.arange(1, acceleration.shape[-1] + 1) * dt
    smooth = {tau: np.cumsum(exponential_mean(acceleration, tau, dt) * dt, axis=-1) for tau in {p["smoothing"] for p in grid}}
    v = np.empty((len(grid), *acceleration.shape))
    for i, p in enumerate(grid):
        limit = p["limit_kmh"] / 3.6
        change = smooth[p["smoothing"]] if math.isinf(limit) else np.clip(smooth[p["smoothing"]], -limit, limit)
        v[i] = v0 + p["gain"] * (change if math.isinf(p["decay"]) else np.exp(-elapsed / p["decay"]) * change)
    np.maximum(v, 0.0, out=v)
    stands = [i for i, p in enumerate(grid) if p["stationary"]]
    if stands and (v0 < 0.75).any():
        quiet = (v0 < 0.75) & (np.abs(exponential_mean(calibrated, 0.5, dt)) < 0.18) & (exponential_mean(gyro, 0.5, dt) < 0.04)
        v[stands] = np.where(quiet, 0.0, v[stands])
    return v


#: Samples of episodes of one length that are searched together; bounds the scratch arrays to some tens of MB.
TOGETHER = 4096


def _alike(batches, keys: list[str]):
    """Frames of episodes [frame of rows, episodes, samples of each] of one duration and one number of samples, taken from a clustered partition."""
    held = None
    for batch in itertools.chain((b for b in batches if len(b)), [None]):
        frame = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if frame is None:
            return
        values = frame[keys].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1, [len(frame)]])
        if batch is not None:  # the last episode may go on
            held, cuts = frame.iloc[cuts[-2] :], cuts[:-1]
        first, size = cuts[:-1], np.diff(cuts)
        kind = np.stack([frame["duration"].to_numpy()[first], size], axis=1)
        for duration, n in np.unique(kind, axis=0).tolist():
            own = first[(kind == (duration, n)).all(axis=1)]
            step = max(1, TOGETHER // n)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                yield duration, frame.iloc[(part[:, None] + np.arange(n)).reshape(-1)], len(part), n


def speed_grid() -> list[dict]:
    """385 settings: all combinations, but a gain of 0 only once."""
    rest = [{"gain": g, "decay": d, "limit_kmh": c, "smoothing": s, "stationary": z} for g in (0.25, 0.5, 0.75, 1.0) for d in (20.0, 40.0, 80.0, math.inf) for c in (5.0, 10.0, 20.0, math.inf) for s in (0.0, 0.5, 1.0) for z in (False, True)]
    return [{"gain": 0.0, "decay": 20.0, "limit_kmh": 5.0, "smoothing": 0.0, "stationary": False}, *rest]


def yaw_grid() -> list[dict]:
    return [{"gain": g, "smoothing": s} for g in (0.5, 0.75, 1.0, 1.25) for s in (0.0, 0.25, 0.5, 1.0)]


def control_search(episodes: DataFrame, keys: list[str], grid: list[dict] | None = None, order: str = "step", dt: float = 0.1) -> DataFrame:
    """Score of every speed setting over all episodes: setting, score, samples.

    ``episodes``: one row per sample with duration, acceleration, calibrated, gyro,
    v0 and true_speed. A task tries all settings on its episodes, those of one length
    together, and hands on nothing but sums per (setting, duration).
    """
    grid = grid or speed_grid()

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for d, f, m, t in _alike(batches, keys):
            a, c, g, truth, v0 = (f[n].to_numpy(float).reshape(m, t) for n in ("acceleration", "calibrated", "gyro", "true_speed", "v0"))
            v, distance = control_speeds(a, c, g, v0[:, 0], grid, dt), truth.sum(axis=1) * dt
            n = len(grid)
            off = np.abs(v.sum(axis=2) * dt - distance).sum(axis=1)
            v -= truth
            own = np.stack([np.abs(v, out=v).sum(axis=(1, 2)) * 3.6, np.full(n, truth.size), off, np.full(n, distance.sum())])
            sums[d] = sums.get(d, 0) + own
        for d, x in sums.items():
            yield pd.DataFrame({"setting": np.arange(len(grid)), "duration": d, "abs_kmh": x[0], "n": x[1].astype(np.int64), "distance_error": x[2], "distance": x[3]})

    rows = cluster(episodes.select(*keys, *[c for c in ("duration", order, "acceleration", "calibrated", "gyro", "v0", "true_speed") if c not in keys]), keys, order)
    sums = rows.mapInPandas(run, "setting int, duration int, abs_kmh double, n long, distance_error double, distance double")
    by = sums.groupBy("setting", "duration").agg(*[F.sum(c).alias(c) for c in ("abs_kmh", "n", "distance_error", "distance")])
    part = F.col("abs_kmh") / F.col("n") / 10 + F.col("distance_error") / F.greatest("distance", F.lit(1.0))
    return by.groupBy("setting").agg(F.avg(part).alias("score"), F.sum("n").alias("samples"))


def yaw_search(episodes: DataFrame, keys: list[str], speed: dict, grid: list[dict] | None = None, order: str = "step", dt: float = 0.1) -> DataFrame:
    """Score of every yaw setting under a chosen speed setting: aggregate endpoint drift per duration, averaged."""
    grid = grid or yaw_grid()

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for d, f, m, t in _alike(batches, keys):
            a, c, g, yaw, truth, v0, h0, te, tn = (f[n].to_numpy(float).reshape(m, t) for n in ("acceleration", "calibrated", "gyro", "yaw", "true_speed", "v0", "h0", "true_east", "true_north"))
            v = control_speeds(a, c, g, v0[:, 0], [speed], dt)[0]
            own = np.zeros((2, len(grid)))
            for i, p in enumerate(grid):
                h = h0[:, :1] + np.cumsum(exponential_mean(yaw, p["smoothing"], dt) * p["gain"] * dt, axis=1)
                own[:, i] = np.hypot((v * np.sin(h)).sum(axis=1) * dt - te[:, -1], (v * np.cos(h)).sum(axis=1) * dt - tn[:, -1]).sum(), truth.sum() * dt
            sums[d] = sums.get(d, 0) + own
        for d, x in sums.items():
            yield pd.DataFrame({"setting": np.arange(len(grid)), "duration": d, "error": x[0], "distance": x[1]})

    wanted = ("duration", order, "acceleration", "calibrated", "gyro", "yaw", "v0", "h0", "true_speed", "true_east", "true_north")
    rows = cluster(episodes.select(*keys, *[c for c in wanted if c not in keys]), keys, order)
    sums = rows.mapInPandas(run, "setting int, duration int, error double, distance double")
    by = sums.groupBy("setting", "duration").agg(F.sum("error").alias("error"), F.sum("distance").alias("distance"))
    return by.groupBy("setting").agg(F.avg(100 * F.col("error") / F.greatest("distance", F.lit(1.0))).alias("score"))


def ridge_solve(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a ridge fit from centred normal equations."""
    mx, my = x.mean(axis=0), y.mean()
    xc = x - mx
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - my))
    return coef, float(my - mx @ coef)


def ridge_from_moments(df: DataFrame, keys: list[str], features: list[str], target: str, alpha: float) -> DataFrame:
    """Ridge fit per group: Spark sums the moments, a vectorised solve makes coefficients (array) and intercept of them."""
    ok = _c(target).isNotNull()
    for f in features:
        ok = ok & _c(f).isNotNull()
    d = df.where(ok)
    k = len(features)
    # moments about the group's means: sums of raw squares would cancel
    w = W.partitionBy(*keys)
    d = d.withColumns({f"_c{i}": _c(f) - F.avg(f).over(w) for i, f in enumerate(features)} | {"_y": _c(target) - F.avg(target).over(w)})
    upper = [F.sum(F.col(f"_c{i}") * F.col(f"_c{j}")) for i in range(k) for j in range(k)]
    m = d.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*upper).alias("xx"), F.array(*[F.sum(F.col(f"_c{i}") * F.col("_y")) for i in range(k)]).alias("xy"), F.array(*[F.avg(f) for f in features]).alias("mx"), F.avg(target).alias("my"))

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.solve(np.array(a, float).reshape(k, k) + alpha * np.eye(k), np.array(b, float)) for a, b in zip(xx, xy, strict=True)])

    m = m.withColumn("coef", solve("xx", "xy"))
    dot = F.aggregate(F.zip_with("coef", "mx", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return m.select(*keys, "n", "coef", (F.col("my") - dot).alias("intercept"))


def calibrated_projection(blocks: DataFrame, samples: DataFrame, keys: list[str], axes: list[str], target: str, limit: float, scale: float, alpha: float = 1.0) -> DataFrame:
    """Project samples by a ridge fit of one-second blocks: standardised axes, output clipped to +-limit and divided by ``scale``; fewer than two usable blocks give 0.

    ``blocks`` has the block means of the axes and the change of the fix over the block.
    """
    sd = [F.stddev_pop(a) for a in axes]
    stats = blocks.groupBy(*keys).agg(F.count(target).alias("_n"), F.array(*[F.avg(a) for a in axes]).alias("_m"), F.array(*[F.when(s < 1e-4, 1.0).otherwise(s) for s in sd]).alias("_sd"))
    z = blocks.join(stats, keys).select(*keys, target, *[((F.col(a) - F.col("_m")[i]) / F.col("_sd")[i]).alias(f"_z{i}") for i, a in enumerate(axes)])
    fit = ridge_from_moments(z, keys, [f"_z{i}" for i in range(len(axes))], target, alpha).drop("n")
    out = samples.join(stats, keys, "left").join(fit, keys, "left")
    value = F.col("intercept")
    for i, a in enumerate(axes):
        value = value + (F.col(a) - F.col("_m")[i]) / F.col("_sd")[i] * F.col("coef")[i]
    clipped = F.least(F.greatest(value, F.lit(-limit)), F.lit(limit)) / scale
    return out.withColumn("projection", F.when(F.col("_n") >= 2, clipped).otherwise(0.0)).drop("_n", "_m", "_sd", "coef", "intercept")
