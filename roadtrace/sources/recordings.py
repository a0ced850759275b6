"""Reading phone and vehicle recordings, drive logs and road ways, and naming what was found.

Recording columns are positional. Everything is read as text and then cast, so that a
bad value becomes NULL and never an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadtrace.functions import signals, stats

# Names of the positional columns of a phone recording (24) and a vehicle recording (29).
PHONE = (
    "lat lon alt gps_speed_ms gps_accuracy_m gps_course_deg unused elapsed_ms phone_ts acc_x acc_y acc_z gravity_x gravity_y gravity_z "
    "gyro_x gyro_y gyro_z mag_x mag_y mag_z yaw_deg pitch_deg roll_deg"
).split()
VEHICLE = (
    "satellites vehicle_t vehicle_lat vehicle_lon velocity_kmh heading_deg height_km vertical_kmh sample_period_s steering_deg wheel_fl wheel_fr wheel_rl wheel_rr "
    "yaw_rate_deg indicated_kmh acc_long_g acc_lat_g handbrake gear_requested gear engine_speed coolant_temp clutch brake_pressure brake_position battery air_temp pedal"
).split()
STANDARD_GRAVITY = 9.80665
BUFFER_CHARS = 16_384
# Columns of a drive log.
LOG = "kind t ax ay az lx ly lz gx gy gz mx my mz lat lon speed course acc mode est_lat est_lon est_v est_h".split()


def recording_key(path):
    """File stem in lower case without its two-letter prefix (S- or V-)."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    return F.lower(F.expr("substring({}, 3)".format("_stem")) if isinstance(path, str) else F.substring(stem, 3, 10_000))


def list_files(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path, folder, side (S or V) and key of every recording below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.upper(F.substring(name, 1, 1)).alias("side"), F.substring(name, 2, 1).alias("_dash"))
    out = out.withColumn("key", recording_key(F.col("path")))
    return out.where(F.col("side").isin("S", "V") & (F.col("_dash") == "-")).drop("_dash")


def discover_pairs(files: DataFrame) -> DataFrame:
    """Pairs of the same folder and key, where exactly one vehicle file matches: key, driver_id, phone_path, vehicle_path."""
    s = files.where("side = 'S'").select("folder", "key", F.col("path").alias("phone_path"))
    v = files.where("side = 'V'").groupBy("folder", "key").agg(F.count("*").alias("n"), F.min("path").alias("vehicle_path")).where("n = 1")
    return s.join(v, ["folder", "key"]).select("key", signals.driver_of("phone_path").alias("driver_id"), "phone_path", "vehicle_path")


def list_pairs(files: DataFrame) -> DataFrame:
    """Keys that occur on both sides anywhere, with the least path of each."""
    s = files.where("side = 'S'").groupBy("key").agg(F.min("path").alias("phone_path"))
    v = files.where("side = 'V'").groupBy("key").agg(F.min("path").alias("vehicle_path"))
    return s.join(v, "key")


def _read(spark: SparkSession, paths, names: list[str], text: set[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    # one task for each file, so that the rows can be numbered in their order
    # a parser is made for each file: its own buffer of a million characters would cost more than a short recording
    raw = spark.read.option("inputBufferSize", BUFFER_CHARS).csv(paths, schema=schema, header=True, enforceSchema=True, multiLine=True, mode="PERMISSIVE")
    raw = raw.withColumns({"path": F.col("_metadata.file_path"), "_order": F.monotonically_increasing_id()})
    cast = [stats.finite_number(n).alias(n) if n not in text else F.col(n) for n in names]
    return raw.select("path", "_order", *cast)


def with_source_row(df: DataFrame) -> DataFrame:
    """Add row_idx, the position in the file, from the reading order. Write the result at once: no later step keeps that order."""
    w = W.partitionBy("path").orderBy("_order")
    return df.withColumn("row_idx", F.row_number().over(w) - 1).drop("_order")


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"session_key": recording_key(F.col("path")), "driver_id": signals.driver_of("path")})


def read_phone(spark: SparkSession, paths) -> DataFrame:
    """Phone recordings: typed columns, phone_ts as a timestamp, elapsed_s, session_key, driver_id and row_idx. The speed is in m/s whatever its header says."""
    df = with_source_row(_read(spark, paths, PHONE, {"phone_ts", "unused"}))
    return _named(df).withColumns({"phone_ts": signals.parse_phone_timestamp("phone_ts"), "elapsed_s": signals.elapsed_seconds("elapsed_ms")}).drop("unused")


def read_vehicle(spark: SparkSession, paths) -> DataFrame:
    """Vehicle recordings: typed columns; accelerations in m/s2 as acc_long, acc_lat."""
    df = with_source_row(_read(spark, paths, VEHICLE, set()))
    return _named(df).withColumns({"acc_long": F.col("acc_long_g") * STANDARD_GRAVITY, "acc_lat": F.col("acc_lat_g") * STANDARD_GRAVITY})


def resolve_column(columns: list[str], *terms: str) -> str | None:
    """First header that holds all terms; a term of one letter must stand alone in it."""
    for c in columns:
        low = c.lower()
        words = set(re.split(r"[^a-z0-9]+", low))
        if all(t.lower() in words if len(t) == 1 else t.lower() in low for t in terms):
            return c
    return None


def resolve_any(columns: list[str], *keywords: str) -> str | None:
    """First header that holds any keyword."""
    return next((c for c in columns if any(k.lower() in c.lower() for k in keywords)), None)


#: Column of the tidy pairs, terms of its header, and whether it comes from the phone.
TIDY = {
    "ax": ("accelerometer", "x"), "ay": ("accelerometer", "y"), "az": ("accelerometer", "z"),
    "grx": ("gravity", "x"), "gry": ("gravity", "y"), "grz": ("gravity", "z"),
    "gx": ("gyroscope", "x"), "gy": ("gyroscope", "y"), "gz": ("gyroscope", "z"),
}


def tidy_pairs(phone: DataFrame, vehicle: DataFrame, keys: list[str], kmh: list[str] = (), order: str = "row_idx") -> DataFrame:
    """Row-aligned columns of both sides, speeds in ``kmh`` as m/s, rows with any NULL dropped, numbered anew."""
    j = phone.join(vehicle, [*keys, order])
    j = j.withColumns({c: F.col(c) / 3.6 for c in kmh}).na.drop()
    return j.withColumn(order, F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def log_schema() -> T.StructType:
    text = {"kind", "mode"}
    return T.StructType([T.StructField(n, T.StringType() if n in text else T.DoubleType()) for n in LOG])


def read_drive_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """A drive log (batch or stream) with NULL in unused cells."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(log_schema()).option("header", "true").csv(path)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """IMU rows and fixes of a drive log."""
    imu = log.where("kind = 'imu'").select("t", "ax", "ay", "az", "lx", "ly", "lz", "gx", "gy", "gz", "mx", "my", "mz")
    return imu, log.where("kind = 'gnss'").select("t", "lat", "lon", "speed", "course", "acc")


_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
WAYS = T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("geometry", T.ArrayType(_POINT)),
])))])


def explode_ways(elements: DataFrame) -> DataFrame:
    """way, seq, node, lat, lon of way elements with a geometry; node ids that are missing or too few are made up from the way."""
    w = elements.where("type = 'way' and geometry is not null")
    good = F.coalesce(F.size("nodes") == F.size("geometry"), F.lit(False))
    ids = F.when(good, F.transform("nodes", lambda x: x.cast("string"))).otherwise(F.transform("geometry", lambda _, i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("_"), i.cast("string"))))
    rows = w.select(F.col("id").alias("way"), F.posexplode(F.arrays_zip(ids.alias("node"), F.col("geometry").alias("p"))).alias("seq", "z"))
    return rows.select("way", "seq", F.col("z.node").alias("node"), F.col("z.p.lat").alias("lat"), F.col("z.p.lon").alias("lon"))


def read_road_ways(spark: SparkSession, path: str) -> DataFrame:
    """Ways of map files in JSON."""
    doc = spark.read.schema(WAYS).option("multiLine", "true").json(path)
    return explode_ways(doc.select(F.explode("elements").alias("x")).select("x.*"))
