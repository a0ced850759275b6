"""Telemetry views over the star-schema tables: once as DataFrames, once as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.signals import epoch_seconds

KEYS = ["driver_id", "session_key"]
SEGMENT = [*KEYS, "segment_id"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _telemetry(events: DataFrame, session) -> DataFrame:
    rows = events.withColumn("session_key", session)
    w = W.partitionBy("session_key").orderBy("ts", "event_id")
    rows = rows.withColumns({
        "driver_id": F.expr("chr(65 + user_id % 5)"),
        "row_idx": F.row_number().over(w) - 1,
        "t_s": epoch_seconds("ts"),
        "k": F.regexp_extract("props", "[0-9]+", 0).cast("double"),
    })
    return rows.withColumns({
        "speed_kmh": F.least("value", F.lit(180.0)), "heading_deg": 3.6 * F.col("k"),
        "lat": 52 + F.col("k") / 1000 + F.col("row_idx") / 10000,
        "lon": -1.5 + F.pmod("user_id", F.lit(50)) / 1000 + F.col("k") / 2000,
    })


def samples(spark: SparkSession, d: str) -> DataFrame:
    """One session per user; the driver is a letter A to E."""
    return _telemetry(table(spark, d, "events"), F.col("user_id").cast("string"))


def long_samples(spark: SparkSession, d: str) -> DataFrame:
    """One long session per event type, all of driver L."""
    return _telemetry(table(spark, d, "events"), F.col("event_type")).withColumn("driver_id", F.lit("L"))


def vehicle(spark: SparkSession, d: str) -> DataFrame:
    """A second recording of each session whose velocity lags the phone's by two rows."""
    s = samples(spark, d)
    w = W.partitionBy(*KEYS).orderBy("row_idx")
    velocity = F.lag("speed_kmh", 2).over(w) + F.pmod("event_id", F.lit(7)) / 10
    return s.select(*KEYS, "row_idx", F.col("t_s").alias("vehicle_t"), velocity.alias("velocity_kmh"), (F.col("lat") + 0.0003).alias("vehicle_lat"), F.col("lon").alias("vehicle_lon"))


def fixes(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where(F.col("event_type").isin("purchase", "signup"))
    return s.select(*KEYS, "event_id", F.col("t_s").alias("fix_t"), "lat", "lon", (F.col("speed_kmh") / 3.6).alias("fix_speed"), F.col("k").alias("accuracy"))


def imu(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).where(~F.col("event_type").isin("purchase", "signup"))
    return s.select(*KEYS, "event_id", "t_s", "speed_kmh", "k")


AXES = [f"{a}_{x}" for a in ("acc", "gravity", "gyro") for x in "xyz"]


def imu_vec(spark: SparkSession, d: str) -> DataFrame:
    """Nine channels from the first dimensions of the embeddings; one session per label."""
    e = table(spark, d, "embeddings")
    scales = [10.0] * 3 + [10.0] * 3 + [0.2] * 3
    cols = [(F.element_at("embedding", i + 1).cast("double") * s).alias(n) for i, (n, s) in enumerate(zip(AXES, scales, strict=True))]
    w = W.partitionBy("session_key").orderBy("vec_id")
    rows = e.select(F.lit("E").alias("driver_id"), F.col("label").cast("string").alias("session_key"), "vec_id", *cols)
    return rows.withColumn("row_idx", F.row_number().over(w) - 1)


#: Every SQL that uses a view begins with this.
PRELUDE = """
WITH telemetry AS (
  SELECT event_id, user_id, event_type, value,
         epoch_us(ts) / 1000000.0 AS t_s, ts,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k
  FROM events
), samples AS (
  SELECT *, chr(CAST(65 + user_id % 5 AS INTEGER)) AS driver_id, CAST(user_id AS VARCHAR) AS session_key,
         least(value, 180.0) AS speed_kmh, 3.6 * k AS heading_deg,
         52 + k / 1000 + row_idx / 10000.0 AS lat, -1.5 + (user_id % 50) / 1000.0 + k / 2000 AS lon
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx FROM telemetry)
), long_samples AS (
  SELECT *, 'L' AS driver_id, event_type AS session_key,
         least(value, 180.0) AS speed_kmh, 3.6 * k AS heading_deg,
         52 + k / 1000 + row_idx / 10000.0 AS lat, -1.5 + (user_id % 50) / 1000.0 + k / 2000 AS lon
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx FROM telemetry)
), vehicle AS (
  SELECT driver_id, session_key, row_idx, t_s AS vehicle_t,
         lag(speed_kmh, 2) OVER (PARTITION BY session_key ORDER BY row_idx) + (event_id % 7) / 10.0 AS velocity_kmh,
         lat + 0.0003 AS vehicle_lat, lon AS vehicle_lon
  FROM samples
), fixes AS (
  SELECT driver_id, session_key, event_id, t_s AS fix_t, lat, lon, speed_kmh / 3.6 AS fix_speed, k AS accuracy
  FROM samples WHERE event_type IN ('purchase', 'signup')
), imu AS (
  SELECT driver_id, session_key, event_id, t_s, speed_kmh, k FROM samples WHERE event_type NOT IN ('purchase', 'signup')
), imu_vec AS (
  SELECT 'E' AS driver_id, CAST(label AS VARCHAR) AS session_key, vec_id,
         embedding[1] * 10.0::DOUBLE AS acc_x, embedding[2] * 10.0::DOUBLE AS acc_y, embedding[3] * 10.0::DOUBLE AS acc_z,
         embedding[4] * 10.0::DOUBLE AS gravity_x, embedding[5] * 10.0::DOUBLE AS gravity_y, embedding[6] * 10.0::DOUBLE AS gravity_z,
         embedding[7] * 0.2::DOUBLE AS gyro_x, embedding[8] * 0.2::DOUBLE AS gyro_y, embedding[9] * 0.2::DOUBLE AS gyro_z,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_idx
  FROM embeddings
), framed AS (
  SELECT *, acc_x - gravity_x AS linear_x, acc_y - gravity_y AS linear_y, acc_z - gravity_z AS linear_z,
         gravity_x / greatest(sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z), 1e-6) AS up_x,
         gravity_y / greatest(sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z), 1e-6) AS up_y,
         gravity_z / greatest(sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z), 1e-6) AS up_z
  FROM imu_vec
), motion AS (
  SELECT *, sqrt((linear_x - linear_vertical * up_x) ** 2 + (linear_y - linear_vertical * up_y) ** 2 + (linear_z - linear_vertical * up_z) ** 2) AS linear_horizontal,
         sqrt(linear_x ** 2 + linear_y ** 2 + linear_z ** 2) AS linear_norm, sqrt(gyro_x ** 2 + gyro_y ** 2 + gyro_z ** 2) AS gyro_norm
  FROM (SELECT *, linear_x * up_x + linear_y * up_y + linear_z * up_z AS linear_vertical FROM framed)
)
"""
