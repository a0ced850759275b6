"""Session audits, profiles and score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo, stats
from roadtrace.functions.geo import _c


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column valid, invalid, min, max, mean and distinct values; a column without any valid value is left out."""
    long = df.select(*[stats.finite(c).alias(c) for c in columns]).unpivot([], columns, "name", "x")
    out = long.groupBy("name").agg(F.count("x").alias("valid"), F.count_if(F.col("x").isNull()).alias("invalid"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.count_distinct("x").alias("unique"))
    return out.where("valid > 0")


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.where("unique = 1").select("name")


def delta_summary(df: DataFrame, keys: list[str], time: str, period: float = 0.1, order: str = "row_idx") -> DataFrame:
    """Clock steps: start, end, span, negative, zero and large counts, the list of anomalies (row before and step), and nearest-rank quantiles."""
    w = W.partitionBy(*keys).orderBy(order)
    limit = max(1.0, period * 5)
    d = df.select(*keys, order, _c(time).alias("t"), (_c(time) - F.lag(time).over(w)).alias("d"), (F.lag(order).over(w)).alias("before"))
    d = d.withColumn("r", F.when(F.col("d").isNotNull(), F.row_number().over(W.partitionBy(*keys, F.col("d").isNull()).orderBy("d", order))))
    d = d.withColumn("n", F.count("d").over(W.partitionBy(*keys)))
    odd = F.when((F.col("d") <= 0) | (F.col("d") > limit), F.struct(F.col("before").alias("after_row"), F.col("d").alias("delta_seconds")))
    at = lambda f: F.max(F.when(stats.nearest_rank(F.col("r"), F.col("n"), f), F.col("d")))
    return d.groupBy(*keys).agg(
        F.min_by("t", order).alias("start"), F.max_by("t", order).alias("end"), (F.max_by("t", order) - F.min_by("t", order)).alias("span_seconds"),
        F.count_if(F.col("d") < 0).alias("negative_deltas"), F.count_if(F.col("d") == 0).alias("zero_deltas"), F.count_if(F.col("d") > limit).alias("large_gaps"),
        F.array_sort(F.collect_list(odd)).alias("anomalies"), at(0.0).alias("d_min"), at(0.01).alias("p01"), at(0.5).alias("p50"), at(0.99).alias("p99"), at(1.0).alias("d_max"),
    )


def audit_pairs(pairs: DataFrame, keys: list[str], phone_limit: float = 0.5, vehicle_limit: float = 1.0, min_n: int = 3, order: str = "row_idx") -> DataFrame:
    """One row per session of row-aligned pairs (phone_t, phone_speed_kmh, lat, lon, vehicle_t, velocity_kmh, vehicle_lat, vehicle_lon).

    The reported median separation ignores missing values, but the quality is
    ``strong`` only where none is missing.
    """
    w = W.partitionBy(*keys).orderBy(order)
    p = pairs.withColumns({
        "_dp": F.col("phone_t") - F.lag("phone_t").over(w), "_dv": F.col("vehicle_t") - F.lag("vehicle_t").over(w),
        "_sep": geo.haversine_m("lat", "lon", "vehicle_lat", "vehicle_lon"),
    })
    corr = stats.safe_corr("phone_speed_kmh", "velocity_kmh", min_n)
    median = F.percentile("_sep", 0.5)
    out = p.groupBy(*keys).agg(
        F.count("*").alias("paired_rows"), F.percentile("_dp", 0.5).alias("phone_period"), F.percentile("_dv", 0.5).alias("vehicle_period"),
        F.count_if((F.col("_dp") <= 0) | (F.col("_dp") > phone_limit)).alias("phone_bad_steps"), F.count_if((F.col("_dv") <= 0) | (F.col("_dv") > vehicle_limit)).alias("vehicle_bad_steps"),
        F.count_if(F.col("_dv") > vehicle_limit).alias("vehicle_large_gaps"), F.count_if(F.col("phone_speed_kmh").isNull()).alias("phone_speed_invalid"), F.count_if(F.col("velocity_kmh").isNull()).alias("velocity_invalid"),
        corr.alias("speed_corr"), F.avg("_sep").alias("separation_mean"), median.alias("separation_median"), F.percentile("_sep", 0.95).alias("separation_p95"),
        F.count_if(F.col("_sep").isNull()).alias("_missing"),
    )
    strong = (F.col("speed_corr") >= 0.8) & (F.col("separation_median") <= 100) & (F.col("_missing") == 0)
    return out.withColumn("quality", F.when(F.coalesce(strong, F.lit(False)), "strong").otherwise("review")).drop("_missing")


def best_axis_corr(df: DataFrame, keys: list[str], candidates: list[str], target: str, min_n: int = 3) -> DataFrame:
    """The candidate of the largest absolute correlation with the target (ties: the first named)."""
    corr = df.groupBy(*keys).agg(*[stats.safe_corr(c, target, min_n).alias(c) for c in candidates])
    every = F.array(*[F.struct(F.abs(c).alias("s"), F.lit(-i).alias("i"), F.lit(c).alias("feature"), F.col(c).alias("corr")) for i, c in enumerate(candidates)])
    best = F.array_max(F.filter(every, lambda x: x["s"].isNotNull()))
    return corr.select(*keys, best["feature"].alias("best_feature"), best["corr"].alias("best_corr"))


def driver_summary(audit: DataFrame) -> DataFrame:
    """Per driver: sessions, rows, median correlation, sessions of each quality."""
    return audit.groupBy("driver_id").agg(
        F.count("*").alias("sessions"), F.sum("paired_rows").alias("rows"), F.percentile("speed_corr", 0.5).alias("median_speed_corr"),
        F.count_if(F.col("quality") == "strong").alias("strong_sessions"), F.count_if(F.col("quality") == "review").alias("review_sessions"),
    )


def quality_totals(audit: DataFrame) -> DataFrame:
    return audit.groupBy("quality").agg(F.count("*").alias("sessions"))


def split_summary(sessions: DataFrame, split: str, rows: str) -> DataFrame:
    return sessions.groupBy(split, "driver_id").agg(F.count("*").alias("sessions"), F.sum(rows).alias("rows"))


def summarize_blackouts(episodes: DataFrame, samples: DataFrame | None, keys: list[str]) -> DataFrame:
    """Per group: sample-level velocity errors (start left out), episode-level final error, bias, distance error and three drift figures.

    Without ``samples`` the sample-level figures are pooled from the episodes' own
    means and their numbers of steps, which gives the same without a second pass.
    """
    e, n = F.col("velocity_error_kmh"), F.col("steps")
    pooled = [
        F.try_divide(F.sum(F.col("velocity_mae_kmh") * n), F.sum(n)).alias("velocity_mae_kmh"), F.sqrt(F.try_divide(F.sum(F.col("velocity_rmse_kmh") ** 2 * n), F.sum(n))).alias("velocity_rmse_kmh"),
        F.try_divide(F.sum(F.col("within_5_kmh_percent") * n), F.sum(n)).alias("within_5_kmh_percent"),
    ]
    p = episodes.groupBy(*keys).agg(
        F.count("*").alias("episodes"), F.avg(F.abs("final_velocity_error_kmh")).alias("final_abs_error_kmh"), F.avg("final_velocity_error_kmh").alias("final_bias_kmh"),
        F.avg(F.abs("distance_error_m")).alias("abs_distance_error_m"), F.avg("distance_error_m").alias("distance_bias_m"), F.avg("drift_percent").alias("drift_mean_percent"),
        F.percentile("drift_percent", 0.5).alias("drift_median_percent"), (100 * F.try_divide(F.sum(F.abs("distance_error_m")), F.greatest(F.sum("true_distance_m"), F.lit(1.0)))).alias("drift_aggregate_percent"),
        *([] if samples is not None else pooled),
    )
    if samples is None:
        return p
    s = samples.where("elapsed_seconds > 0").groupBy(*keys).agg(F.avg(F.abs(e)).alias("velocity_mae_kmh"), F.sqrt(F.avg(e * e)).alias("velocity_rmse_kmh"), (100 * F.avg((F.abs(e) <= 5).cast("double"))).alias("within_5_kmh_percent"))
    return p.join(s, keys, "left")


def summarize_episode_means(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """The variant that averages each episode's own errors."""
    return episodes.groupBy(*keys).agg(F.count("*").alias("episodes"), F.avg("velocity_mae_kmh").alias("mean_mae_kmh"), F.avg("velocity_rmse_kmh").alias("mean_rmse_kmh"), F.avg("drift_percent").alias("drift_mean_percent"))


def error_growth(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute velocity error by time since the start."""
    return samples.where("elapsed_seconds > 0").groupBy(*keys, "elapsed_seconds").agg(F.avg(F.abs("velocity_error_kmh")).alias("mae_kmh"), F.count("*").alias("n"))


def vector_error_metrics(axes: list[tuple[str, str]], prefix: str) -> list[Column]:
    """Per-axis RMSE, RMSE, maximum and p95 of the norm of (estimate - truth) over ``axes``."""
    errors = [_c(a) - _c(b) for a, b in axes]
    square = sum((e * e for e in errors[1:]), errors[0] * errors[0])
    out = [F.sqrt(F.avg(e * e)).alias(f"{prefix}_rmse_{i}") for i, e in enumerate(errors)]
    return [*out, F.sqrt(F.avg(square)).alias(f"{prefix}_rmse"), F.sqrt(F.max(square)).alias(f"{prefix}_max"), F.percentile(F.sqrt(square), 0.95).alias(f"{prefix}_p95")]


def held_signal_stats(df: DataFrame, keys: list[str], x: str, time: str, order: str = "row_idx") -> DataFrame:
    """Changes of a held signal, its update rate, and the lengths of its constant runs (p50, p90, max)."""
    w = W.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_new", F.coalesce(_c(x) != F.lag(x).over(w), F.lit(False)).cast("int"))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = d.groupBy(*keys, "_run").agg(F.count("*").alias("length"), F.min(time).alias("t0"), F.max(time).alias("t1"))
    span = F.greatest(F.max("t1") - F.min("t0"), F.lit(1e-9))
    return runs.groupBy(*keys).agg((F.count("*") - 1).alias("changes"), ((F.count("*") - 1) / span).alias("update_rate_hz"), F.percentile("length", 0.5).alias("run_p50"), F.percentile("length", 0.9).alias("run_p90"), F.max("length").alias("run_max"))


def fit_scaler(df: DataFrame, columns: list[str], split: str = "split", floor: float = 1e-5) -> DataFrame:
    """One row of c_mean and c_std over the training rows; a deviation below the floor becomes 1."""
    out = []
    for c in columns:
        sd = F.stddev_pop(c)
        out += [F.avg(c).alias(f"{c}_mean"), F.when(sd < floor, 1.0).otherwise(sd).alias(f"{c}_std")]
    return df.where(_c(split) == "train").agg(*out)


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: list[str]) -> DataFrame:
    """Add c_scaled; the scaler is one row."""
    joined = df.crossJoin(F.broadcast(scaler))
    return joined.select(*df.columns, *[((_c(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std")).alias(f"{c}_scaled") for c in columns])


def interval_mean_correlations(df: DataFrame, keys: list[str], candidates: list[str], speed: str, horizon: int, min_n: int = 20, order: str = "row_idx") -> DataFrame:
    """Correlation of each candidate's mean over the horizon with the change of speed, pooled over all segments, with its rank."""
    w = W.partitionBy(*keys).orderBy(order)
    r = w.rowsBetween(-(horizon - 1), 0)
    d = df.withColumn("_dv", _c(speed) - F.lag(speed, horizon).over(w))
    d = d.withColumns({f"_m_{c}": F.when(F.count(c).over(r) == horizon, F.avg(c).over(r)) for c in candidates})
    corr = d.agg(*[stats.safe_corr(f"_m_{c}", "_dv", min_n).alias(c) for c in candidates])
    long = corr.unpivot([], candidates, "feature", "corr")
    return long.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.abs("corr").desc_nulls_last(), "feature")))


def row_alignment(pairs: DataFrame, keys: list[str], min_n: int = 2) -> DataFrame:
    """Single-session diagnostic: separation mean, median, nearest-rank p95, max; correlations of speed, yaw rate (vehicle in degrees) and both vehicle speeds."""
    p = pairs.withColumn("_sep", geo.haversine_m("lat", "lon", "vehicle_lat", "vehicle_lon"))
    p = p.withColumns({"_r": F.row_number().over(W.partitionBy(*keys, F.col("_sep").isNull()).orderBy("_sep", "row_idx")), "_n": F.count("_sep").over(W.partitionBy(*keys))})
    p95 = F.max(F.when(F.col("_sep").isNotNull() & stats.nearest_rank(F.col("_r"), F.col("_n"), 0.95), F.col("_sep")))
    return p.groupBy(*keys).agg(
        F.avg("_sep").alias("separation_mean"), F.percentile("_sep", 0.5).alias("separation_median"), p95.alias("separation_p95"), F.max("_sep").alias("separation_max"),
        stats.safe_corr("phone_speed_kmh", "velocity_kmh", min_n).alias("speed_corr"), stats.safe_corr("phone_yaw_rate", F.radians("vehicle_yaw_deg"), min_n).alias("yaw_corr"),
        stats.safe_corr("velocity_kmh", "indicated_kmh", min_n).alias("indicated_corr"),
    )
