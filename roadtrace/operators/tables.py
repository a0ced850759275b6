"""Grid, episode and cell generators in the form of table functions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lag_grid(df: DataFrame, max_lag: int) -> DataFrame:
    return df.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))


def episode_starts(segments: DataFrame, first: int, length: int) -> DataFrame:
    """Starts first, first + length, ... that leave room for ``length`` more rows."""
    fits = segments.where(F.col("rows") - length - 1 >= first)
    return fits.withColumn("start", F.explode(F.sequence(F.lit(first).cast("bigint"), F.col("rows") - length - 1, F.lit(length).cast("bigint"))))
