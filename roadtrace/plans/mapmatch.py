"""Free against map-aided dead reckoning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.operators import episodes, reckon, roads
from roadtrace.session import written_once

RADIUS = 60.0
#: Blackouts that begin in the same square of so many metres share a region of the roads.
REGION_M = 1000.0


def free_vs_map(drives: DataFrame, edges: DataFrame, keys: list[str], by: list[str], distances: tuple = (1000.0,), history: int = 250, min_speed: float = 5.0, step_s: float = 7.0, min_rows: int = 11, min_history: float = 1.0, order: str = "row_idx") -> DataFrame:
    """Blackouts, median and least drift and share under 10 % of both tracks per group and blackout length.

    ``drives``: reckon.CHANNELS, speed (m/s), course_deg, az_deg, e and n (in the
    edges' frame) at reckon.RATE. All blackouts of each length are searched,
    calibrated on the ``history`` rows before them and reckoned with the speed and
    course of their first row; the truth is the place of their last row. Rows without
    a speed are no part of a drive. A blackout without a road at its start has no map track.
    Blackouts that begin in the same square share its edges (``roads.regions``).
    Rows, blackouts, calibrations, origins and the edges are written once, since several steps need each.
    """
    rate = reckon.RATE
    rows = drives.where("speed is not null").withColumn("position", (F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    rows = rows.select(*keys, "position", *reckon.CHANNELS, "speed", "course_deg", "az_deg", "e", "n")
    rows, edges = written_once(rows, "drives"), written_once(edges, "edges")
    found = episodes.distance_blackouts(rows, keys, "speed", list(distances), history, rate, min_speed, step_s, min_rows=min_rows, min_history=min_history, order="position")
    each = [*keys, "blackout_m", "start"]
    found = found.withColumnRenamed("distance_m", "blackout_m").withColumn("position", F.explode(F.expr(f"sequence(start - {history}, end - 1)")))
    placed = written_once(found.join(roads.shuffled(rows), [*keys, "position"]).withColumn("step", F.col("position") - F.col("start")), "blackouts")
    calibrations = written_once(reckon.calibrate(placed.where("step < 0"), each, "step"), "calibrations")
    dark = placed.where("step >= 0")
    reach = F.count("*") * F.max(F.when(F.col("step") == 0, F.col("speed"))) / rate + RADIUS
    first = lambda c: F.max(F.when(F.col("step") == 0, F.col(c)))
    origin = written_once(dark.groupBy(*each).agg(first("e").alias("e0"), first("n").alias("n0"), first("speed").alias("v0"), F.radians(first("course_deg")).alias("heading"), reach.alias("reach"), F.count("*").alias("rows")), "origins")
    dark = dark.join(roads.shuffled(origin), each)
    free = reckon.dead_reckon(dark.withColumns({"gt_e": F.col("e") - F.col("e0"), "gt_n": F.col("n") - F.col("n0")}), calibrations, each, "const", "gyro")
    begins = origin.select(*each, F.col("e0").alias("e"), F.col("n0").alias("n"), "heading", "reach", "rows")
    homes = roads.regions(begins, each, REGION_M, "rows")
    at = roads.anchor(begins, edges, each, "heading", RADIUS).join(roads.shuffled(homes), each)
    up = F.sqrt(sum(F.col(f"gravity_{x}") ** 2 for x in "xyz"))
    yaw = sum(F.col(f"gyro_{x}") * F.col(f"gravity_{x}") for x in "xyz") / F.greatest(up, F.lit(1e-6))
    moved = dark.join(roads.shuffled(calibrations.select(*each, "yaw_sign", "yaw_bias")), each).select(*each, "step", (F.col("yaw_sign") * yaw - F.col("yaw_bias")).alias("yaw_rate"), F.col("v0").alias("speed"))
    walked = roads.map_aided_walk(moved, at, roads.own_edges(begins.join(roads.shuffled(homes), each), edges, roads.REGION, "reach"), each, 1 / rate, by=roads.REGION)
    mapped = dark.select(*each, "step", "speed", F.col("e").alias("gt_e"), F.col("n").alias("gt_n")).join(walked, [*each, "step"])
    mapped = reckon.drift_stats(mapped.withColumns({"east_est": F.col("map_e"), "north_est": F.col("map_n")}), each)
    drifts = [d.select(*each, "drift_percent").withColumn("track", F.lit(t)) for t, d in (("free", free), ("map", mapped))]
    return reckon.drift_curve(drifts[0].unionByName(drifts[1]), [*by, "blackout_m", "track"])
