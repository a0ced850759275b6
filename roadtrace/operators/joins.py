"""Joins of recordings: row-aligned, shifted, as-of, held and by parameter grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c

#: Rows up to which a side is broadcast by ``small_side``.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows (checked), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def co_located(spark: SparkSession) -> None:
    """Let joins by session and row use a partitioning by session alone, so that bucketed recordings (``sinks.write_bucketed``) are not shuffled again; the session keeps the setting."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def row_aligned_pairs(phone: DataFrame, vehicle: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """Rows of equal number; what one recording has beyond the other's end is left out."""
    return phone.join(vehicle, [*keys, order])


def offset_aligned_pairs(phone: DataFrame, vehicle: DataFrame, offsets: DataFrame, keys: list[str], order: str = "row_idx") -> DataFrame:
    """Phone row i with vehicle row i + offset of its session; adds vehicle_row."""
    shifted = phone.join(small_side(offsets.select(*keys, "offset")), keys).withColumn("vehicle_row", _c(order) + F.col("offset"))
    return shifted.join(vehicle.withColumnRenamed(order, "vehicle_row"), [*keys, "vehicle_row"])


def lag_sweep_pairs(phone: DataFrame, vehicle: DataFrame, keys: list[str], max_lag: int, order: str = "row_idx") -> DataFrame:
    """Every phone row with the vehicle rows at all lags from -max_lag to max_lag: the exact form for small sweeps."""
    every = phone.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("vehicle_row", _c(order) + F.col("lag"))
    return every.join(vehicle.withColumnRenamed(order, "vehicle_row"), [*keys, "vehicle_row"])


def as_of(samples: DataFrame, fixes: DataFrame, keys: list[str], time: str, fix_time: str, values: list[str], tie: str | None = None) -> DataFrame:
    """Each sample with the latest fix at or before it, and its age; NULL before the first fix.

    A union and one window instead of a range join; a fix at a sample's time comes first.
    """
    fix = F.struct(_c(fix_time).alias("fix_t"), *[_c(v).alias(v) for v in values])
    own = [c for c in samples.columns if c not in keys]
    left = samples.select(*keys, _c(time).alias("_t"), F.lit(1).alias("_kind"), F.struct(*own).alias("_row"), F.lit(None).cast(fixes.select(fix.alias("f")).schema["f"].dataType).alias("_fix"))
    right = fixes.select(*keys, _c(fix_time).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), fix.alias("_fix"))
    w = W.partitionBy(*keys).orderBy("_t", "_kind", *([F.col(f"_row.{tie}")] if tie else [])).rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right).withColumn("_fix", F.last("_fix", ignorenulls=True).over(w))
    out = both.where("_kind = 1").select(*keys, "_row.*", "_fix.fix_t", *[F.col(f"_fix.{v}").alias(f"fix_{v}" if v in own else v) for v in values])
    return out.withColumn("fix_age", _c(time) - F.col("fix_t"))


def hold(x, keys: list[str], position: str, every: int = 10):
    """The value at the start of each run of ``every`` positions, repeated over it."""
    w = W.partitionBy(*keys, F.floor(_c(position) / every)).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return F.first(_c(x)).over(w)


def leave_one_out(drivers: DataFrame, driver: str = "driver_id") -> DataFrame:
    """One row per driver: held out, with the sorted list of all others (a table of drivers is small)."""
    a, b = drivers.select(_c(driver).alias("held_out")), drivers.select(_c(driver).alias("other"))
    return a.join(b, F.col("held_out") != F.col("other")).groupBy("held_out").agg(F.array_sort(F.collect_list("other")).alias("others"))


def with_grid(df: DataFrame, grid: list[dict]) -> DataFrame:
    """Every row with every setting of a parameter grid, whose size the caller's code fixes."""
    names = list(grid[0])
    settings = F.array(*[F.struct(*[F.lit(g[n]).alias(n) for n in names]) for g in grid])
    return df.withColumn("_g", F.explode(settings)).select(*df.columns, "_g.*")


def unpaired(phone: DataFrame, vehicle: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one list only, with the side that has them."""
    a, b = phone.select(*keys).distinct(), vehicle.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("phone")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("vehicle")))


def endpoints(episodes: DataFrame, samples: DataFrame, keys: list[str], horizon: int, values: list[str], position: str = "position") -> DataFrame:
    """Samples at an episode's start and at every ``horizon`` rows up to its end; adds step (0 at the start)."""
    rows = episodes.withColumn(position, F.explode(F.sequence(_c("start"), _c("end"), F.lit(horizon).cast("bigint"))))
    rows = rows.withColumn("step", ((_c(position) - F.col("start")) / horizon).cast("int"))
    return rows.join(samples.select(*keys, position, *values), [*keys, position])
