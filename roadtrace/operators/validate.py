"""Checks of a prepared dataset, as a table of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.signals import content_hash


def content_checksum(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free checksum of each session's content."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(content_hash(columns)).cast("string").alias("checksum"))


def _failures(df: DataFrame, check: str, key: list[str], bad) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(check).alias("check"), F.concat_ws(":", *key).alias("key"))


def validate_dataset(archive: DataFrame, sessions: DataFrame, segments: DataFrame, eligibility: DataFrame, keys: list[str], max_gap: float, max_jump: float, checksum_columns: list[str] | None = None) -> DataFrame:
    """Failures (check, key) of archive rows, manifest, segments and eligibility; an empty result means passed.

    archive: keys, segment_id, archive_row, source_row, vehicle_source_row, vehicle_t, velocity_kmh;
    sessions: keys, kept_rows, offset_rows, driver_holdout_split and, if checked, checksum.
    """
    w = W.partitionBy(*keys, "segment_id").orderBy("archive_row")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    a = archive.withColumns({"_ar": step("archive_row"), "_sr": step("source_row"), "_vr": step("vehicle_source_row"), "_dt": step("vehicle_t"), "_dv": F.abs(step("velocity_kmh"))})
    per = a.groupBy(*keys, "segment_id").agg(
        F.bool_or(F.col("_ar") != 1).alias("ar"), F.bool_or(F.col("_sr") != 1).alias("sr"), F.bool_or(F.col("_vr") != 1).alias("vr"),
        F.bool_or((F.col("_dt") <= 0) | (F.col("_dt") > max_gap + 1e-5)).alias("dt"), F.bool_or(F.col("_dv") > max_jump + 1e-4).alias("dv"),
        F.min(F.col("vehicle_source_row") - F.col("source_row")).alias("o0"), F.max(F.col("vehicle_source_row") - F.col("source_row")).alias("o1"), F.count("*").alias("n"),
    )
    seg = [*keys, "segment_id"]
    out = _failures(per, "non_contiguous_archive_rows", seg, F.col("ar"))
    for name, flag in (("non_contiguous_source_rows", "sr"), ("non_contiguous_vehicle_rows", "vr"), ("time_discontinuity", "dt"), ("velocity_jump", "dv")):
        out = out.unionByName(_failures(per, name, seg, F.col(flag)))
    per_session = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("o0").alias("o0"), F.max("o1").alias("o1"))
    m = sessions.join(per_session, keys, "left")
    out = out.unionByName(_failures(m, "row_count", keys, ~F.col("kept_rows").eqNullSafe(F.coalesce("n", F.lit(0)))))
    out = out.unionByName(_failures(m, "alignment_offset", keys, (F.col("o0") != F.col("offset_rows")) | (F.col("o1") != F.col("offset_rows"))))
    out = out.unionByName(_failures(segments, "segment_range", seg, F.col("archive_row_end") - F.col("archive_row_start") + 1 != F.col("rows")))
    some = eligibility.where("eligible_examples > 0")
    out = out.unionByName(_failures(some, "eligibility_range", [*seg, "horizon_rows"], F.col("last_eligible_archive_row") - F.col("first_eligible_archive_row") + 1 != F.col("eligible_examples")))
    joined = some.select(*seg, "horizon_rows", "first_eligible_archive_row", "history_purge_rows").join(segments.select(*seg, "archive_row_start"), seg)
    out = out.unionByName(_failures(joined, "history_purge", [*seg, "horizon_rows"], F.col("first_eligible_archive_row") - F.col("archive_row_start") < F.col("history_purge_rows")))
    drivers = sessions.groupBy("driver_id").agg(F.count_distinct("driver_holdout_split").alias("s"))
    out = out.unionByName(_failures(drivers, "driver_in_two_splits", ["driver_id"], F.col("s") > 1))
    if checksum_columns:
        now = content_checksum(archive, keys, checksum_columns).select(*keys, F.col("checksum").alias("now"))
        out = out.unionByName(_failures(sessions.join(now, keys, "left"), "checksum", keys, ~F.col("checksum").eqNullSafe(F.col("now"))))
    return out


def validation_status(failures: DataFrame) -> DataFrame:
    """One row: status and number of failures."""
    n = F.count("*")
    return failures.agg(F.when(n == 0, "passed").otherwise("failed").alias("status"), n.alias("failures"))
