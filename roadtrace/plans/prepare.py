"""From two recordings per session to an audited, aligned, segmented and split dataset.

All per-session steps are partitioned by session key, so one exchange serves the
join, the audit and the segmentation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.operators import aggregates, align, joins, segments, splits, validate

KEYS = ["driver_id", "session_key"]


@dataclass
class Thresholds:
    """Defaults for 10 Hz recordings (seconds, km/h, rows)."""

    max_gap: float = 0.25
    max_jump: float = 10.0
    min_rows: int = 200
    history: int = 100
    horizons: tuple[int, ...] = (10, 20, 50)
    blackouts: tuple[int, ...] = (10, 30, 60, 120)
    rows_per_second: int = 10
    seed: int = 42


@dataclass
class Prepared:
    """The dataset's tables. ``archive`` feeds all others: write it (``sinks.write_sessions``) and read it back before reuse."""

    audit: DataFrame
    archive: DataFrame
    segment_audit: DataFrame
    segments: DataFrame
    sessions: DataFrame
    eligibility: DataFrame
    capacity: DataFrame
    failures: DataFrame


def audit(phone: DataFrame, vehicle: DataFrame, max_lag: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pair audit and lag verification of row-aligned recordings (phone_t, phone_speed_kmh, lat, lon; vehicle_t, velocity_kmh, vehicle_lat, vehicle_lon)."""
    pairs = joins.row_aligned_pairs(phone, vehicle, KEYS)
    swept = align.lag_sweep(phone.withColumnRenamed("phone_speed_kmh", "speed_kmh"), vehicle, KEYS, max_lag)
    return aggregates.audit_pairs(pairs, KEYS), align.verify_pairs(swept, KEYS)


def prepare(phone: DataFrame, vehicle: DataFrame, offsets: DataFrame | None = None, required: list[str] = (), t: Thresholds = Thresholds()) -> Prepared:
    """Join (shifted by each session's ``offset`` if given), cut into segments, split by driver and by drive, and check.

    The vehicle's clock and velocity decide on the segments together with the phone's
    clock; ``required`` phone columns must be set in a valid row.
    """
    if offsets is None:
        offsets = phone.select(*KEYS).distinct().withColumn("offset", F.lit(0))
    joined = joins.offset_aligned_pairs(phone, vehicle, offsets, KEYS)
    joined = joined.withColumn("valid", segments.critical_valid(["phone_t", "vehicle_t", *required], "velocity_kmh"))
    cut = segments.segment_rows(joined, KEYS, "phone_t", "vehicle_t", "velocity_kmh", "valid", t.max_gap, t.max_jump)
    cut = segments.renumber_segments(cut, KEYS, t.min_rows)
    archive = segments.archive_rows(cut, KEYS).withColumnsRenamed({"row_idx": "source_row", "vehicle_row": "vehicle_source_row"})
    table = segments.segment_table(archive, KEYS, "vehicle_t", "source_row")
    kept = archive.groupBy(*KEYS).agg(F.count("*").alias("kept_rows"), F.first("offset").alias("offset_rows"))
    sessions = splits.drive_holdout(splits.driver_holdout(kept, "kept_rows"), t.seed)
    marks = sessions.select(*KEYS, "driver_holdout_split", "drive_holdout_split")
    eligible = splits.training_eligibility(table, list(t.horizons), t.history)
    failures = validate.validate_dataset(archive, sessions, table, eligible, KEYS, t.max_gap, t.max_jump)
    return Prepared(
        audit=aggregates.audit_pairs(joined.drop("vehicle_row"), KEYS), archive=archive, segment_audit=segments.segment_audit(cut, KEYS, t.max_gap, t.max_jump), segments=table, sessions=sessions,
        eligibility=eligible.join(joins.small_side(marks), KEYS), capacity=splits.blackout_capacity(table, list(t.blackouts), t.history, t.rows_per_second).join(joins.small_side(marks), KEYS), failures=failures,
    )
