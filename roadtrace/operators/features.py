"""Causal window features. All windows share one partitioning and order, so Spark sorts once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import stats
from roadtrace.functions.geo import _c, wrap_pi
from roadtrace.operators.groups import cluster, key_at, starts_of
from roadtrace.operators.segments import ordered


def full_frame(value: Column, x, w, n: int) -> Column:
    """``value`` where the frame ``w`` has n rows, none of them NULL in ``x``."""
    return F.when(F.count(_c(x)).over(w) == n, value)


def rolling_features(df: DataFrame, keys: list[str], columns: list[str], windows=(5, 10, 20, 50, 100), energy: dict[str, str] | None = None, order: str = "row_idx") -> DataFrame:
    """Add c_mean_w, c_std_w, c_range_w for each column and window, and name_energy_w (mean square) for ``energy``'s columns.

    NULL until the window is full and free of NULLs. Windows of one size go in one
    projection, which keeps the generated code small.
    """
    for n in windows:
        w = ordered(keys, order).rowsBetween(-(n - 1), 0)
        new = {}
        for c in columns:
            new[f"{c}_mean_{n}"] = full_frame(F.avg(c).over(w), c, w, n)
            new[f"{c}_std_{n}"] = full_frame(F.stddev_pop(c).over(w), c, w, n)
            new[f"{c}_range_{n}"] = full_frame(F.max(c).over(w) - F.min(c).over(w), c, w, n)
        for name, c in (energy or {}).items():
            new[f"{name}_energy_{n}"] = full_frame(F.avg(_c(c) * _c(c)).over(w), c, w, n)
        df = df.withColumns(new)
    return df


def rolling_features_wide(df: DataFrame, keys: list[str], columns: list[str], windows=(5, 10, 20, 50, 100), order: str = "row_idx") -> DataFrame:
    """``rolling_features`` of many columns by one numpy pass per segment: 15 expressions a column would overflow the generated code."""
    names = [f"{c}_{s}_{n}" for n in windows for c in columns for s in ("mean", "std", "range")]

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        out = {k: frame[k].to_numpy() for k in [*keys, order]}
        for n in windows:
            for c in columns:
                x = frame[c].to_numpy(float)
                mean, std, span = (np.full(len(x), np.nan) for _ in range(3))
                if len(x) >= n:
                    v = np.lib.stride_tricks.sliding_window_view(x, n)
                    mean[n - 1 :], std[n - 1 :], span[n - 1 :] = v.mean(axis=1), v.std(axis=1), v.max(axis=1) - v.min(axis=1)
                out |= {f"{c}_mean_{n}": mean, f"{c}_std_{n}": std, f"{c}_range_{n}": span}
        return pd.DataFrame(out)

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, order]), *(f"`{n}` double" for n in names)])
    built = df.select(*keys, order, *columns).groupBy(*keys).applyInPandas(build, schema)
    return built.select(*keys, order, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def smooth_centered(x, keys: list[str], rows: int = 5, order: str = "row_idx") -> Column:
    """Centred moving mean of a full frame."""
    right = (rows - 1) // 2
    w = ordered(keys, order).rowsBetween(-(rows - 1) + right, right)
    return full_frame(F.avg(_c(x)).over(w), x, w, rows)


def causal_bias(x, keys: list[str], rows: int, order: str = "row_idx") -> Column:
    """Mean of the at most ``rows`` rows before this one, 0 on the first."""
    return F.coalesce(F.avg(_c(x)).over(ordered(keys, order).rowsBetween(-rows, -1)), F.lit(0.0))


def delta_target(x, keys: list[str], horizon: int, order: str = "row_idx") -> Column:
    """Change over the last ``horizon`` rows of the same segment."""
    return _c(x) - F.lag(_c(x), horizon).over(ordered(keys, order))


def gradient(x, keys: list[str], dt: float = 0.1, order: str = "row_idx") -> Column:
    """Central differences, one-sided at both ends; NULL for a single row."""
    w = ordered(keys, order)
    x, before, after = _c(x), F.lag(_c(x)).over(w), F.lead(_c(x)).over(w)
    return F.coalesce((after - before) / (2 * dt), (after - x) / dt, (x - before) / dt)


def course_over_ground(df: DataFrame, keys: list[str], east: str = "east", north: str = "north", order: str = "row_idx") -> DataFrame:
    """Add course_deg from positions that are smoothed by a five-row sum / 5 (missing rows at the ends count as zero)."""
    w = ordered(keys, order)
    five = w.rowsBetween(-2, 2)
    df = df.withColumns({"_e": F.sum(_c(east)).over(five) / 5, "_n": F.sum(_c(north)).over(five) / 5})
    course = F.pmod(F.degrees(F.atan2(gradient("_e", keys, 1.0, order), gradient("_n", keys, 1.0, order))), F.lit(360.0))
    return df.withColumn("course_deg", course).drop("_e", "_n")


def unwrap(df: DataFrame, keys: list[str], angle: str, out: str, order: str = "row_idx") -> DataFrame:
    """Add the angle (radians) without jumps: the first one plus the running sum of wrapped differences."""
    w = ordered(keys, order)
    df = df.withColumn("_d", F.coalesce(wrap_pi(_c(angle) - F.lag(angle).over(w)), _c(angle)))
    return df.withColumn(out, F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_d")


def _between_knots(df: DataFrame, keys: list[str], knot: Column, value: str, order: str):
    """Nearest knots at or before and after each row: positions and values."""
    w = ordered(keys, order)
    past, future = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(1, W.unboundedFollowing)
    df = df.withColumns({"_kp": F.when(knot, _c(order)), "_kv": F.when(knot, _c(value))})
    return df.withColumns({
        "_p0": F.last("_kp", ignorenulls=True).over(past), "_v0": F.last("_kv", ignorenulls=True).over(past),
        "_p1": F.first("_kp", ignorenulls=True).over(future), "_v1": F.first("_kv", ignorenulls=True).over(future),
    })


def interpolate_held(df: DataFrame, keys: list[str], x: str, out: str, order: str = "row_idx") -> DataFrame:
    """Add a sample-and-hold series made linear between the rows where its value changes.

    Gaps are filled first: linearly inside, with the nearest value at the ends.
    ``order`` numbers the rows of a group without gaps.
    """
    df = _between_knots(df, keys, _c(x).isNotNull(), x, order)
    share = F.try_divide(_c(order) - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    filled = F.coalesce(_c(x), F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share, F.col("_v0"), F.col("_v1"))
    df = df.withColumn("_f", filled)
    w = ordered(keys, order)
    before = F.lag("_f").over(w)
    df = df.withColumn("_knot", before.isNull() | (F.col("_f") != before) | F.lead("_f").over(w).isNull())
    df = _between_knots(df.drop("_p0", "_v0", "_p1", "_v1"), keys, F.col("_knot"), "_f", order)
    share = F.try_divide(_c(order) - F.col("_p0"), F.col("_p1") - F.col("_p0"))
    df = df.withColumn(out, F.when(F.col("_knot"), F.col("_f")).otherwise(F.col("_v0") + (F.col("_v1") - F.col("_v0")) * share))
    return df.drop("_kp", "_kv", "_p0", "_v0", "_p1", "_v1", "_f", "_knot")


def interval_rates(df: DataFrame, keys: list[str], x: str, mark: str, out: str, dt: float = 0.1, order: str = "row_idx") -> DataFrame:
    """Add the rate of ``x`` that is constant between arrivals (rows where ``mark`` changes); the ends take the neighbour's rate, fewer than two arrivals give 0."""
    w = ordered(keys, order)
    df = df.withColumn("_knot", F.coalesce(_c(mark) != F.lag(mark).over(w), F.lit(False)))
    df = _between_knots(df, keys, F.col("_knot"), x, order)
    df = df.withColumn("_rate", (F.col("_v1") - F.col("_v0")) / ((F.col("_p1") - F.col("_p0")) * dt))
    before = F.last("_rate", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("_rate", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return df.withColumn(out, F.coalesce("_rate", before, after, F.lit(0.0))).drop("_knot", "_kp", "_kv", "_p0", "_v0", "_p1", "_v1", "_rate")


def cumulative_distance(speed, keys: list[str], rate_hz: float = 10.0, order: str = "row_idx") -> Column:
    return F.sum(_c(speed) / rate_hz).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0))


def cumulative_turn(df: DataFrame, keys: list[str], course: str, out: str, order: str = "row_idx") -> DataFrame:
    """Add the total absolute turning (radians) since the first row."""
    w = ordered(keys, order)
    df = df.withColumn("_t", F.coalesce(F.abs(wrap_pi(_c(course) - F.lag(course).over(w))), F.lit(0.0)))
    return df.withColumn(out, F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_t")


def stationary(df: DataFrame, keys: list[str], time: str, linear_norm: str, gyro_norm: str, window: float = 1.0, hold: float = 2.0, samples: int = 5, variance: float = 0.03, mean: float = 0.6, gyro: float = 0.02) -> DataFrame:
    """Add quiet (over the last ``window`` seconds) and stationary (quiet for ``hold`` seconds without a break)."""
    w = W.partitionBy(*keys).orderBy(time)
    r = W.partitionBy(*keys).orderBy((_c(time) * 1e6).cast("long")).rangeBetween(-round(window * 1e6), 0)
    spread = stats.running_variance(F.collect_list(_c(linear_norm).cast("double")).over(r))
    quiet = (F.count("*").over(r) >= samples) & (spread < variance) & (F.avg(linear_norm).over(r) < mean) & (F.avg(gyro_norm).over(r) < gyro)
    df = df.withColumn("quiet", F.coalesce(quiet, F.lit(False)))
    loud = F.last(F.when(~F.col("quiet"), _c(time)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_loud", loud)
    since = F.min(F.when(F.col("quiet"), _c(time))).over(W.partitionBy(*keys, "_loud"))
    return df.withColumn("stationary", F.col("quiet") & (_c(time) - since >= hold)).drop("_loud")


def is_still(speed, gyro_norm) -> Column:
    """Instant rule of standing still."""
    return (_c(speed) < 0.1) & (_c(gyro_norm) < 0.02)


def shock_count(df: DataFrame, keys: list[str], linear_norm: str, threshold: float = 8.0, order: str = "row_idx") -> DataFrame:
    """Add shock and the running number of shocks."""
    df = df.withColumn("shock", F.coalesce(_c(linear_norm) > threshold, F.lit(False)))
    return df.withColumn("shocks", F.count_if("shock").over(ordered(keys, order).rowsBetween(W.unboundedPreceding, 0)))


def knock_flag(gyro: tuple[str, str, str], keys: list[str], rows: int = 20, threshold: float = 0.01, factor: float = 50.0, order: str = "row_idx") -> Column:
    """The summed variance of the last rows' rotation says that the phone was moved."""
    w = ordered(keys, order).rowsBetween(-(rows - 1), 0)
    total = sum((F.var_pop(c).over(w) for c in gyro[1:]), F.var_pop(gyro[0]).over(w))
    return (F.count("*").over(w) == rows) & (total > factor * threshold)


def exponential_mean(x: np.ndarray, tau: float, dt: float = 0.1, before=None) -> np.ndarray:
    """Exponential mean along the last axis with time constant ``tau``, from the first value or from the mean ``before`` it.

    y_i = a y_{i-1} + (1 - a) x_i has the closed form a^i (y_0 + (1 - a) sum of x_j a^-j), taken in
    blocks short enough for its powers. NaN stays from where it occurs.
    """
    out = np.array(x, float)
    if tau <= 0 or not out.shape[-1]:
        return out
    last = out[..., :1] if before is None else np.broadcast_to(np.asarray(before, float)[..., None], (*out.shape[:-1], 1))
    decay = math.exp(-dt / tau)
    block = max(1, int(min(4096, 200 * tau / dt)))
    for a in range(0, out.shape[-1], block):
        part = out[..., a : a + block]
        powers = decay ** np.arange(1, part.shape[-1] + 1)
        part[...] = powers * (last + (1 - decay) * np.cumsum(part / powers, axis=-1))
        last = part[..., -1:].copy()
    return out


def ema(df: DataFrame, keys: list[str], x: str, out: str, tau: float, dt: float = 0.1, order: str = "row_idx") -> DataFrame:
    """Add the exponential mean with time constant ``tau`` seconds that starts at the first value; tau <= 0 copies ``x``.

    Rows of a group pass one task in order, in batches that hand their last value
    on, so a group may be of any length. From a NULL on all values are NULL.
    """
    if tau <= 0:
        return df.withColumn(out, _c(x))
    rows = cluster(df.withColumn("_x", _c(x).cast("double")), keys, order)

    def run(batches):
        last = before = None
        for batch in batches:
            values = batch.column("_x").to_numpy(zero_copy_only=False).astype(float)
            starts = starts_of(batch, keys)
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(values)], strict=True)):
                goes_on = i == 0 and last is not None and last == key_at(batch, keys, 0)
                values[a:b] = exponential_mean(values[a:b], tau, dt, before if goes_on else None)
            if len(values):
                last, before = key_at(batch, keys, len(values) - 1), values[-1]
            own = [batch.column(n) for n in batch.schema.names if n != "_x"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values, from_pandas=True)], names=[*(n for n in batch.schema.names if n != "_x"), out])

    fields = [f"`{c}` {t}" for c, t in df.dtypes if c != out]
    return rows.select(*[c for c in df.columns if c != out], "_x").mapInArrow(run, ", ".join([*fields, f"`{out}` double"]))


def feature_windows(df: DataFrame, keys: list[str], columns: list[str], window: int, stride: int, label: str | None = None, order: str = "row_idx") -> DataFrame:
    """Every ``stride``-th full window as an array of arrays, with the label of its last row.

    Rows of a group pass one task in order; only windows that are kept are built,
    and window - 1 rows are all that is held from batch to batch.
    """
    own = df.select(*keys, _c(order).alias(order), *([_c(label).alias("label")] if label else []), *[_c(c).cast("double").alias(f"_w{i}") for i, c in enumerate(columns)])

    def run(batches):
        last, held = None, np.zeros((0, len(columns)))
        for batch in batches:
            values = np.stack([batch.column(f"_w{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1)
            starts, rows, windows = starts_of(batch, keys), [], []
            for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(values)], strict=True)):
                if not (i == 0 and last is not None and last == key_at(batch, keys, 0)):
                    held = held[:0]
                before = len(held)
                held = np.concatenate([held, values[a:b]])
                at = np.asarray(batch.column(order)[a:b].to_numpy(zero_copy_only=False))
                kept = np.flatnonzero((np.arange(before, len(held)) >= window - 1) & ((at - (window - 1)) % stride == 0))
                if len(kept):
                    windows.append(np.lib.stride_tricks.sliding_window_view(held, window, axis=0)[kept + before - (window - 1)].transpose(0, 2, 1))
                    rows.append(a + kept)
                held = held[max(0, len(held) - (window - 1)) :]
            if len(values):
                last = key_at(batch, keys, len(values) - 1)
            if rows:
                flat = pa.array(np.concatenate(windows).reshape(-1), from_pandas=True)
                inner = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(columns), dtype=np.int32), flat)
                outer = pa.ListArray.from_arrays(np.arange(0, len(inner) + 1, window, dtype=np.int32), inner)
                picked = batch.take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*(picked.column(n) for n in [*keys, order]), outer, *([picked.column("label")] if label else [])], names=[*keys, order, "window", *(["label"] if label else [])])

    types = dict(own.dtypes)
    schema = [*(f"`{c}` {types[c]}" for c in [*keys, order]), "window array<array<double>>", *([f"label {types['label']}"] if label else [])]
    return cluster(own, keys, order).mapInArrow(run, ", ".join(schema))


def pool_window(window="window") -> tuple[Column, Column]:
    """Mean and population deviation of each channel over a window array."""
    n = F.size(_c(window))
    channels = F.sequence(F.lit(0), F.size(F.element_at(_c(window), 1)) - 1)
    mean = F.transform(channels, lambda i: F.aggregate(_c(window), F.lit(0.0), lambda s, r: s + r[i]) / n)
    std = F.transform(channels, lambda i: F.sqrt(F.aggregate(_c(window), F.lit(0.0), lambda s, r: s + F.pow(r[i] - mean[i], 2)) / n))
    return mean, std


def imu9_windows(df: DataFrame, keys: list[str], acc: tuple, gyro: tuple, time: str, window: int = 50, stride: int = 10, order: str = "row_idx") -> DataFrame:
    """Windows of acceleration, rotation, their norms and the time step; the first step of a window repeats its second. Labels are six zeros."""
    size = lambda v: F.sqrt(sum((_c(c) * _c(c) for c in v[1:]), _c(v[0]) * _c(v[0])))
    df = df.withColumns({"_an": size(acc), "_gn": size(gyro), "_dt": _c(time) - F.lag(time).over(ordered(keys, order))})
    out = feature_windows(df, keys, [*acc, *gyro, "_an", "_gn", "_dt"], window, stride, order=order)
    fixed = F.transform("window", lambda r, i: F.when(i == 0, F.concat(F.slice(r, 1, 8), F.array(F.element_at(F.col("window"), 2)[8]))).otherwise(r))
    return out.withColumn("window", fixed).withColumn("label", F.array_repeat(F.lit(0.0), 6))


def block_layout(df: DataFrame, block_rows: int, order: str = "row_idx") -> DataFrame:
    """Add block_id and position_in_block."""
    return df.withColumns({"block_id": F.floor(_c(order) / block_rows).cast("long"), "position_in_block": F.pmod(_c(order), F.lit(block_rows)).cast("long")})


def usable_rows(df: DataFrame, keys: list[str], features: list[str], target: str, stride: int, lowest: float = 0.0, highest: float = 160.0, order: str = "row_idx") -> DataFrame:
    """Rows with all features and a target in range, then every ``stride``-th of those that remain in a group."""
    ok = _c(target).between(lowest, highest)
    for c in features:
        ok = ok & _c(c).isNotNull()
    left = df.where(ok).withColumn("_r", F.row_number().over(ordered(keys, order)) - 1)
    return left.where(F.pmod("_r", F.lit(stride)) == 0).drop("_r")
