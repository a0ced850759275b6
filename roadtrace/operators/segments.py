"""Gaps and islands: row deltas, continuous segments and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c


def ordered(keys: list[str], order: str = "row_idx"):
    return W.partitionBy(*keys).orderBy(order)


def deltas(df: DataFrame, keys: list[str], columns: list[str], time: str, order: str = "row_idx", clip: tuple[float, float] = (0.05, 0.2), default: float = 0.1) -> DataFrame:
    """First differences and rates; the first difference is 0, the period is clipped and ``default`` where unknown."""
    w = ordered(keys, order)
    step = _c(time) - F.lag(time).over(w)  # greatest and least would skip a NULL
    period = F.when(step.isNull(), default).otherwise(F.least(F.greatest(step, F.lit(clip[0])), F.lit(clip[1])))
    df = df.withColumn("period", period)
    change = {c: F.coalesce(_c(c) - F.lag(c).over(w), F.lit(0.0)) for c in columns}
    return df.withColumns({f"{c}_delta": s for c, s in change.items()} | {f"{c}_rate": s / F.col("period") for c, s in change.items()})


def critical_valid(required: list[str], velocity: str, lowest: float = 0.0, highest: float = 180.0):
    """All required columns are set and the velocity lies in its range."""
    ok = _c(velocity).between(lowest, highest)
    for c in required:
        ok = ok & _c(c).isNotNull()
    return F.coalesce(ok, F.lit(False))


def segment_rows(df: DataFrame, keys: list[str], phone_time: str, vehicle_time: str, velocity: str, valid: str, max_gap: float = 0.25, max_jump: float = 10.0, order: str = "row_idx") -> DataFrame:
    """Add raw_segment: the number of the continuous run a row is in, -1 for invalid rows.

    A run starts at the first row, next to an invalid row, after a time step that
    is not in (0, max_gap] of either clock, and after a velocity jump. A comparison
    with NULL starts nothing.
    """
    w = ordered(keys, order)
    ok = _c(valid)
    steps = [_c(t) - F.lag(t).over(w) for t in (phone_time, vehicle_time)]
    jump = F.abs(_c(velocity) - F.lag(velocity).over(w))
    broken = ~ok | ~F.coalesce(F.lag(valid).over(w), F.lit(False)) | F.lag(F.lit(1)).over(w).isNull()
    for s in steps:
        broken = broken | F.coalesce((s <= 0) | (s > max_gap), F.lit(False))
    broken = broken | F.coalesce(jump > max_jump, F.lit(False))
    df = df.withColumns({"_start": broken.cast("int"), "phone_step": steps[0], "vehicle_step": steps[1], "velocity_step": jump})
    run = F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1
    return df.withColumn("raw_segment", F.when(ok, run).otherwise(-1).cast("int")).drop("_start")


def renumber_segments(df: DataFrame, keys: list[str], min_rows: int) -> DataFrame:
    """Add segment_id: runs of at least ``min_rows`` rows numbered densely from 0, other rows -1."""
    n = F.count("*").over(W.partitionBy(*keys, "raw_segment"))
    df = df.withColumn("_kept", (F.col("raw_segment") >= 0) & (n >= min_rows))
    # dense_rank over kept rows alone: the others are sorted behind them
    rank = F.dense_rank().over(W.partitionBy(*keys, "_kept").orderBy("raw_segment"))
    return df.withColumn("segment_id", F.when(F.col("_kept"), rank - 1).otherwise(-1).cast("int")).drop("_kept")


def segment_audit(df: DataFrame, keys: list[str], max_gap: float, max_jump: float) -> DataFrame:
    """Breaks over all rows but the first, invalid rows, and segment counts, one row per session (after ``renumber_segments``)."""
    out = lambda c: (c <= 0) | (c > max_gap)
    return df.groupBy(*keys).agg(
        F.count_if(out(F.col("phone_step"))).alias("phone_time_breaks"),
        F.count_if(out(F.col("vehicle_step"))).alias("vehicle_time_breaks"),
        F.count_if(F.col("velocity_step") > max_jump).alias("velocity_jump_breaks"),
        F.count_if(F.col("raw_segment") < 0).alias("invalid_rows"),
        F.count_distinct(F.when(F.col("raw_segment") >= 0, F.col("raw_segment"))).alias("raw_segments"),
        F.count_distinct(F.when(F.col("segment_id") >= 0, F.col("segment_id"))).alias("accepted_segments"),
        F.count_if(F.col("segment_id") < 0).alias("rows_excluded"),
    )


def archive_rows(df: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """Rows of accepted segments with archive_row, their dense position in the session."""
    return df.where("segment_id >= 0").withColumn("archive_row", F.row_number().over(ordered(keys, order)) - 1)


def segment_table(df: DataFrame, keys: list[str], time: str, order: str = "row_idx") -> DataFrame:
    """One row per segment of ``archive_rows``: first and last source and archive rows, rows, duration."""
    return df.groupBy(*keys, "segment_id").agg(
        F.min(order).alias("source_row_start"), F.max(order).alias("source_row_end"),
        F.min("archive_row").alias("archive_row_start"), F.max("archive_row").alias("archive_row_end"),
        F.count("*").alias("rows"), (F.max_by(time, order) - F.min_by(time, order)).alias("duration_seconds"),
    )


def longest_segment(df: DataFrame, keys: list[str], time: str, max_step: float = 0.5, order: str = "row_idx") -> DataFrame:
    """Per session the longest run of time steps in (0, max_step], the first one on ties: run, rows, first and last row."""
    w = ordered(keys, order)
    step = _c(time) - F.lag(time).over(w)
    df = df.withColumn("_start", F.coalesce((step <= 0) | (step > max_step), F.lit(True)).cast("int"))
    df = df.withColumn("run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = df.groupBy(*keys, "run").agg(F.count("*").alias("rows"), F.min(order).alias("first_row"), F.max(order).alias("last_row"))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("rows"), "run"))
    return runs.withColumn("_r", first).where("_r = 1").drop("_r")
