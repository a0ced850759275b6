"""The live engine as one streaming query over multiplexed drive logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.functions import geo
from roadtrace.streaming import devices
from roadtrace.streaming.live import fusion_filter_stream


def filter_input(log: DataFrame, device: str, lat0: float, lon0: float, up: tuple[str, str, str] = ("ux", "uy", "uz"), yaw_sign: float = 1.0) -> DataFrame:
    """Rows for ``live.fusion_filter_stream`` and ``devices.fusion_filter`` from a log with a gravity direction: yaw rate about it, fixes as east and north of the reference; the log's ``stationary`` is kept where it has one."""
    omega = yaw_sign * (F.col("gx") * F.col(up[0]) + F.col("gy") * F.col(up[1]) + F.col("gz") * F.col(up[2]))
    e, n = geo.to_enu("lat", "lon", lat0, lon0)
    kind = F.when(F.col("kind") == "gnss", "fix").otherwise("imu")
    return log.select(device, kind.alias("kind"), "t", F.coalesce(omega, F.lit(0.0)).alias("omega"), F.col("lx").alias("accel"), e.alias("e"), n.alias("n"), "speed", F.radians("course").alias("course"), F.greatest(F.col("acc"), F.lit(1.0)).alias("sigma"), *[c for c in ("stationary",) if c in log.columns])


def live(log: DataFrame, device: str, lat0: float, lon0: float, watermark: str = "10 seconds", in_order: bool = False) -> DataFrame:
    """Filter states and recovery figures of every device; one shuffle, by device.

    At once as rows come, or with ``in_order`` behind the watermark and then the same whatever the order of arrival.
    """
    rows = filter_input(log, device, lat0, lon0).withColumn("ts", F.timestamp_seconds("t"))
    stream = fusion_filter_stream if in_order else devices.fusion_filter_stream
    return stream(rows, device, "ts", watermark)
