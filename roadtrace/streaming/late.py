"""What a watermark does to late rows, as a batch rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def within_watermark(rows: DataFrame, device: list[str], ts: str, arrival: str, delay: str) -> DataFrame:
    """Rows no older than ``delay`` before the latest time that the device had shown when they arrived; the others count as late."""
    seen = F.max(ts).over(W.partitionBy(*device).orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("_seen", seen).where(F.col("_seen").isNull() | (F.col(ts) >= F.col("_seen") - F.expr(f"INTERVAL {delay}"))).drop("_seen")
