"""Projections, scalar functions and window operators over the telemetry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadtrace.functions import geo, signals, stats, vectors
from roadtrace.operators import features, segments
from roadtrace.queries.registry import query
from roadtrace.queries.views import AXES, KEYS, PRELUDE, SEGMENT, fixes, imu, imu_vec, long_samples, samples, table, vehicle

# Thresholds that suit the views; the operators' defaults are those of 10 Hz recordings.
MAX_GAP, MAX_JUMP, MIN_ROWS = 86_400.0, 100.0, 5


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def motion(spark, d):
    v = imu_vec(spark, d)
    acc, gravity, gyro = (vectors.vec(*AXES[i : i + 3]) for i in (0, 3, 6))
    df = v.withColumns(vectors.gravity_frame(acc, gravity))
    return df.withColumns({"linear_norm": vectors.norm(vectors.vec("linear_x", "linear_y", "linear_z")), "gyro_norm": vectors.norm(gyro)})


def segmented(spark, d):
    s = samples(spark, d).withColumn("valid", segments.critical_valid(["k", "t_s"], "speed_kmh", 1.0, 180.0))
    s = segments.segment_rows(s, KEYS, "t_s", "t_s", "speed_kmh", "valid", MAX_GAP, MAX_JUMP)
    return segments.renumber_segments(s, KEYS, MIN_ROWS)


SEGMENTED = PRELUDE + f""", flagged AS (
  SELECT *, coalesce(k IS NOT NULL AND t_s IS NOT NULL AND speed_kmh BETWEEN 1 AND 180, false) AS valid,
         t_s - lag(t_s) OVER w AS phone_step, abs(speed_kmh - lag(speed_kmh) OVER w) AS velocity_step
  FROM samples WINDOW w AS (PARTITION BY driver_id, session_key ORDER BY row_idx)
), starts AS (
  SELECT *, CASE WHEN row_idx = 0 OR NOT valid OR NOT coalesce(lag(valid) OVER w, false)
                   OR coalesce(phone_step <= 0 OR phone_step > {MAX_GAP}, false)
                   OR coalesce(velocity_step > {MAX_JUMP}, false) THEN 1 ELSE 0 END AS begins
  FROM flagged WINDOW w AS (PARTITION BY driver_id, session_key ORDER BY row_idx)
), runs AS (
  SELECT *, CAST(CASE WHEN valid THEN sum(begins) OVER w - 1 ELSE -1 END AS INTEGER) AS raw_segment
  FROM starts WINDOW w AS (PARTITION BY driver_id, session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING)
), kept AS (
  SELECT *, raw_segment >= 0 AND count(*) OVER (PARTITION BY driver_id, session_key, raw_segment) >= {MIN_ROWS} AS is_kept FROM runs
), segmented AS (
  SELECT *, CAST(CASE WHEN is_kept THEN dense_rank() OVER (PARTITION BY driver_id, session_key, is_kept ORDER BY raw_segment) - 1 ELSE -1 END AS INTEGER) AS segment_id
  FROM kept
), archived AS (
  SELECT *, row_number() OVER (PARTITION BY driver_id, session_key ORDER BY row_idx) - 1 AS archive_row FROM segmented WHERE segment_id >= 0
), segment_table AS (
  SELECT driver_id, session_key, segment_id, min(row_idx) AS source_row_start, max(row_idx) AS source_row_end,
         min(archive_row) AS archive_row_start, max(archive_row) AS archive_row_end, count(*) AS rows,
         max_by(t_s, row_idx) - min_by(t_s, row_idx) AS duration_seconds
  FROM archived GROUP BY ALL
)
"""


def archived(spark, d):
    return segments.archive_rows(segmented(spark, d), KEYS)


# --- projections and filters


@query("""SELECT doc_id, coalesce(nullif(trim(regexp_extract('data/(Driver ' || source || ') x/S-' || doc_id, '\\(Driver\\s+([^)]+)\\)', 1)), ''), 'unknown') AS driver_id FROM documents""")
def p1_driver_id(spark, d):
    path = F.concat(F.lit("data/(Driver "), "source", F.lit(") x/S-"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", signals.driver_of(path).alias("driver_id"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS x, CASE WHEN event_id % 3 <> 0 THEN value END AS y FROM events""")
def p2_finite_numeric(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string"))
    odd = F.when(F.pmod("event_id", F.lit(3)) == 0, float("nan")).otherwise(F.col("value"))
    return e.withColumn("text", text).select("event_id", stats.finite_number("text").alias("x"), stats.finite(odd).alias("y"))


@query("SELECT event_id, coalesce(k IS NOT NULL AND t_s IS NOT NULL AND value BETWEEN 0 AND 180, false) AS valid FROM samples", PRELUDE)
def p3_critical_valid(spark, d):
    return samples(spark, d).select("event_id", segments.critical_valid(["k", "t_s"], "value").alias("valid"))


@query("""SELECT session_key, CASE WHEN session_key LIKE '1%' THEN 'test' WHEN session_key LIKE '2%' THEN 'validation' ELSE 'train' END AS split, count(*) AS rows
FROM samples WHERE driver_id <> 'E' GROUP BY 1, 2 HAVING count(*) >= 21""", PRELUDE)
def p4_scope_drives(spark, d):
    from roadtrace.operators import splits

    drives = samples(spark, d).groupBy("driver_id", "session_key").agg(F.count("*").alias("rows"))
    excluded = drives.where("driver_id = 'E'").select("session_key")
    return splits.scope_drives(drives, "session_key", ["[0-9]"], excluded, ["1"], ["2"], 21).select("session_key", "split", "rows")


@query("""SELECT event_id, user_id, row_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY driver_id, session_key ORDER BY row_idx) - 1 AS r FROM samples WHERE k IS NOT NULL AND value BETWEEN 0 AND 160
) WHERE r % 4 = 0""", PRELUDE)
def p6_usable_rows(spark, d):
    return features.usable_rows(samples(spark, d), KEYS, ["k"], "value", 4).select("event_id", "user_id", "row_idx")


@query("""SELECT p.session_key, p.row_idx, v.row_idx AS vehicle_row FROM samples p JOIN vehicle v ON p.session_key = v.session_key AND v.row_idx = p.row_idx + 2""", PRELUDE)
def p7_alignment_slice(spark, d):
    from roadtrace.operators import joins

    v = vehicle(spark, d)
    offsets = v.select(*KEYS).distinct().withColumn("offset", F.lit(2))
    return joins.offset_aligned_pairs(samples(spark, d).select(*KEYS, "row_idx"), v, offsets, KEYS).select("session_key", "row_idx", "vehicle_row")


@query("""SELECT p.event_id FROM samples p, (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS e FROM samples WHERE session_key = '3') x
WHERE p.lat BETWEEN a - degrees(50 / 6371000.0) AND b + degrees(50 / 6371000.0)
  AND p.lon BETWEEN c - degrees(50 / 6371000.0) / greatest(cos(radians(a)), 1e-6) AND e + degrees(50 / 6371000.0) / greatest(cos(radians(a)), 1e-6)""", PRELUDE)
def p8_bbox_filter(spark, d):
    from roadtrace.operators import roads

    s = samples(spark, d)
    return roads.bbox_filter(s, s.where("session_key = '3'"), 50.0).select("event_id")


# --- scalar functions


@query("""SELECT event_id, round(2 * 6371000.0 * atan2(sqrt(a), sqrt(greatest(1 - a, 0))), 4) AS metres FROM (
  SELECT event_id, sin(radians(52.5 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(52.5)) * sin(radians(-1.4 - lon) / 2) ** 2 AS a FROM samples)""", PRELUDE)
def v1_haversine(spark, d):
    return rounded(samples(spark, d).select("event_id", geo.haversine_m("lat", "lon", 52.5, -1.4).alias("metres")), "metres", places=4)


@query("""SELECT event_id, round(radians(lon + 1.5) * 6371000.0 * cos(radians(52)), 4) AS east, round(radians(lat - 52) * 6371000.0, 4) AS north, round(lat, 8) AS lat2, round(lon, 8) AS lon2 FROM samples""", PRELUDE)
def v2_enu_round_trip(spark, d):
    s = samples(spark, d)
    e, n = geo.to_enu("lat", "lon", 52.0, -1.5)
    la, lo = geo.from_enu(e, n, 52.0, -1.5)
    return s.select("event_id", F.round(e, 4).alias("east"), F.round(n, 4).alias("north"), F.round(la, 8).alias("lat2"), F.round(lo, 8).alias("lon2"))


@query("""SELECT event_id, round((lat - 52) * 111320.0, 4) AS n, round((lon + 1.5) * 111320.0 * cos(radians(52)), 4) AS e, round(10 - value, 4) AS dn, round(lat, 8) AS lat2, round(lon, 8) AS lon2, round(value, 6) AS alt2 FROM samples""", PRELUDE)
def v3_ned_round_trip(spark, d):
    n, e, dn = geo.to_ned("lat", "lon", "value", 52.0, -1.5, 10.0)
    la, lo, al = geo.from_ned(n, e, dn, 52.0, -1.5, 10.0)
    return samples(spark, d).select("event_id", *[F.round(c, p).alias(a) for c, a, p in ((n, "n", 4), (e, "e", 4), (dn, "dn", 4), (la, "lat2", 8), (lo, "lon2", 8), (al, "alt2", 6))])


@query("""SELECT event_id, round(atan2(k - 50, value - 50), 6) AS bearing, round(abs(atan2(sin(radians(heading_deg) - 1), cos(radians(heading_deg) - 1))), 6) AS diff,
  round((heading_deg - 400) - 360 * floor((heading_deg - 400) / 360), 6) AS wrapped FROM samples""", PRELUDE)
def v4_angles(spark, d):
    return samples(spark, d).select("event_id", F.round(geo.bearing(F.col("k") - 50, F.col("value") - 50), 6).alias("bearing"), F.round(geo.ang_diff(F.radians("heading_deg"), 1.0), 6).alias("diff"), F.round(geo.wrap_deg(F.col("heading_deg") - 400), 6).alias("wrapped"))


@query("SELECT vec_id, round(linear_x, 6) AS linear_x, round(up_z, 6) AS up_z, round(linear_vertical, 6) AS linear_vertical, round(linear_horizontal, 6) AS linear_horizontal FROM motion", PRELUDE)
def v5_gravity_frame(spark, d):
    cols = ("linear_x", "up_z", "linear_vertical", "linear_horizontal")
    return rounded(motion(spark, d).select("vec_id", *cols), *cols)


@query("""SELECT vec_id, round(linear_norm, 6) AS linear_norm, round(linear_vertical, 6) AS linear_vertical, round(linear_horizontal, 6) AS linear_horizontal, round(gyro_norm, 6) AS gyro_norm, round(yaw_rate, 6) AS yaw_rate,
  round(sqrt((gyro_x - yaw_rate * up_x) ** 2 + (gyro_y - yaw_rate * up_y) ** 2 + (gyro_z - yaw_rate * up_z) ** 2), 6) AS gyro_horizontal
FROM (SELECT *, gyro_x * up_x + gyro_y * up_y + gyro_z * up_z AS yaw_rate FROM motion)""", PRELUDE)
def v6_mounting_invariant(spark, d):
    new = vectors.mounting_invariant(*(vectors.vec(*AXES[i : i + 3]) for i in (0, 3, 6)))
    return imu_vec(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in new.items()])


@query("""SELECT vec_id, round(x1 * cos(r) + z2 * sin(r), 6) AS x, round(y2, 6) AS y, round(z2 * cos(r) - x1 * sin(r), 6) AS z FROM (
  SELECT *, y1 * cos(p) - acc_z * sin(p) AS y2, y1 * sin(p) + acc_z * cos(p) AS z2 FROM (
    SELECT *, acc_x * cos(y) - acc_y * sin(y) AS x1, acc_x * sin(y) + acc_y * cos(y) AS y1 FROM (
      SELECT *, radians(10 * vec_id % 360) AS y, radians(vec_id % 45) AS p, radians(7 * vec_id % 90) AS r FROM imu_vec)))""", PRELUDE)
def v7_rotate_euler(spark, d):
    x, y, z = vectors.rotate_euler_zxy(F.col("vec_id") * 10 % 360, F.col("vec_id") % 45, F.col("vec_id") * 7 % 90, vectors.vec("acc_x", "acc_y", "acc_z"))
    return imu_vec(spark, d).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


@query("""SELECT vec_id, CASE WHEN m2 >= 1e-6 AND mh >= 1e-3 AND yh >= 1e-3 THEN round(atan2(-((by_ * az_ - bz_ * ay_) * -up_x + (bz_ * ax_ - bx_ * az_) * -up_y + (bx_ * ay_ - by_ * ax_) * -up_z), ax_ * bx_ + ay_ * by_ + az_ * bz_), 6) END AS azimuth FROM (
  SELECT *, mx / mh AS ax_, my / mh AS ay_, mz / mh AS az_, qx / yh AS bx_, qy / yh AS by_, qz / yh AS bz_ FROM (
    SELECT *, sqrt(mx ** 2 + my ** 2 + mz ** 2) AS mh, sqrt(qx ** 2 + qy ** 2 + qz ** 2) AS yh FROM (
      SELECT *, gyro_x ** 2 + gyro_y ** 2 + gyro_z ** 2 AS m2, gyro_x - g * up_x AS mx, gyro_y - g * up_y AS my, gyro_z - g * up_z AS mz,
             -up_y * up_x AS qx, 1 - up_y * up_y AS qy, -up_y * up_z AS qz
      FROM (SELECT *, gyro_x * up_x + gyro_y * up_y + gyro_z * up_z AS g FROM motion))))""", PRELUDE)
def v8_compass_azimuth(spark, d):
    az = vectors.compass_azimuth(vectors.vec("gyro_x", "gyro_y", "gyro_z"), vectors.vec("up_x", "up_y", "up_z"))
    return motion(spark, d).select("vec_id", F.round(az, 6).alias("azimuth"))


@query("""SELECT vec_id, round(degrees(asin(greatest(-1, least(1, -f_z)))), 6) AS pitch, round(degrees(atan2(l_z / ln, up_z)), 6) AS roll, round(degrees(atan2(f_y, f_x)), 6) AS yaw, round(acc_x * f_x + acc_y * f_y + acc_z * f_z, 6) AS forward FROM (
  SELECT *, sqrt((up_y * f_z - up_z * f_y) ** 2 + (up_z * f_x - up_x * f_z) ** 2 + (up_x * f_y - up_y * f_x) ** 2) AS ln, up_x * f_y - up_y * f_x AS l_z FROM (
    SELECT *, linear_x / linear_norm AS f_x, linear_y / linear_norm AS f_y, linear_z / linear_norm AS f_z FROM motion))""", PRELUDE)
def v9_mount_angles(spark, d):
    up, forward = vectors.vec("up_x", "up_y", "up_z"), vectors.unit(vectors.vec("linear_x", "linear_y", "linear_z"))
    left = vectors.unit(vectors.cross(up, forward))
    along = vectors.phone_to_vehicle(vectors.vec("acc_x", "acc_y", "acc_z"), forward, left, up)[0]
    return motion(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in vectors.mount_angles(up, forward).items()], F.round(along, 6).alias("forward"))


@query("SELECT vec_id, round(cos(0.3) * acc_x - sin(0.3) * acc_y, 6) AS x, round(sin(0.3) * acc_x + cos(0.3) * acc_y, 6) AS y FROM imu_vec", PRELUDE)
def v10_rotate_phone_frame(spark, d):
    x, y = vectors.rotate_plane("acc_x", "acc_y", 0.3)
    return imu_vec(spark, d).select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT event_id, round(10 + t * 60, 6) AS foot_e, round(20 + t * 30, 6) AS foot_n, round(sqrt((k - 10 - t * 60) ** 2 + (value - 20 - t * 30) ** 2), 6) AS distance, round(t * sqrt(4500), 6) AS along
FROM (SELECT *, least(1, greatest(0, ((k - 10) * 60 + (value - 20) * 30) / 4500.0)) AS t FROM samples)""", PRELUDE)
def v11_project_to_segment(spark, d):
    p = geo.project_to_segment("k", "value", 10.0, 20.0, 70.0, 50.0)
    return samples(spark, d).select("event_id", *[F.round(p[n], 6).alias(n) for n in ("foot_e", "foot_n", "distance", "along")])


@query("""SELECT event_id, CASE WHEN denied THEN 'DENIED' WHEN degraded THEN 'DEGRADED' ELSE 'GOOD' END AS health,
  round(6.25 * CASE WHEN denied THEN 1e6 WHEN degraded THEN greatest(1, k / 10 / 2) ** 2 ELSE 1 END, 6) AS var_pos FROM (
  SELECT *, event_type = 'error' OR user_id % 12 < 4 AS denied, k / 10 >= 4 OR value < 25 AS degraded FROM samples)""", PRELUDE)
def v12_gnss_quality(spark, d):
    fix = F.when(F.col("event_type") == "error", "none").otherwise("3D")
    q = signals.gnss_quality(F.col("k") / 10, F.pmod("user_id", F.lit(12)), fix, F.col("value"))
    return samples(spark, d).select("event_id", q["health"].alias("health"), F.round(q["var_pos"], 6).alias("var_pos"))


@query("""SELECT event_id, round(k * k / 25 + value * value / 100, 6) AS nis6, (k * k / 25 + value * value / 100) < 16.81 AS ok6,
  round((k * (30 * k - 2 * value) + value * (20 * value - 2 * k)) / 596.0, 6) AS nis2 FROM samples""", PRELUDE)
def v13_nis_gate(spark, d):
    six, two = signals.nis_diagonal(["k", "value"], [F.lit(25.0), F.lit(100.0)]), signals.nis_2x2("k", "value", 20.0, 2.0, 30.0)
    return samples(spark, d).select("event_id", F.round(six, 6).alias("nis6"), (six < signals.GATE_6).alias("ok6"), F.round(two, 6).alias("nis2"))


@query("SELECT event_id, round(CASE WHEN k - 50 > 15 THEN k - 65 WHEN k - 50 < -15 THEN k - 35 ELSE 0 END, 6) AS a FROM samples", PRELUDE)
def v14_soft_deadband(spark, d):
    return samples(spark, d).select("event_id", F.round(vectors.soft_deadband(F.col("k") - 50, 15.0), 6).alias("a"))


@query("""SELECT event_id, epoch_us(date_trunc('milliseconds', ts)) AS us, round(k / 1000, 6) AS elapsed FROM samples""", PRELUDE)
def v15_phone_timestamp(spark, d):
    s = samples(spark, d)
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss:SSS")
    parsed = F.unix_micros(signals.parse_phone_timestamp(text))
    odd = signals.parse_phone_timestamp(F.lit("no time"))
    # the text has no zone: it is read and counted in the session's zone
    zone = F.unix_micros(F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    return s.select("event_id", F.when(odd.isNull(), parsed - zone).alias("us"), F.round(signals.elapsed_seconds("k"), 6).alias("elapsed"))


@query("SELECT session_key, substr(sha256('42:' || driver_id || ':' || session_key), 1, 16) AS h FROM (SELECT DISTINCT driver_id, session_key FROM samples)", PRELUDE)
def v16_stable_hash(spark, d):
    return samples(spark, d).select(*KEYS).distinct().select("session_key", signals.stable_hash(42, "driver_id", "session_key").alias("h"))


@query("""SELECT session_key, row_idx, round(m, 6) AS mean0, round(s, 6) AS std0 FROM (
  SELECT *, avg(acc_x) OVER w AS m, stddev_pop(acc_x) OVER w AS s, count(*) OVER w AS n FROM imu_vec
  WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS 7 PRECEDING)) WHERE n = 8 AND (row_idx - 7) % 4 = 0""", PRELUDE)
def v17_window_pooling(spark, d):
    w = features.feature_windows(imu_vec(spark, d), KEYS, ["acc_x", "acc_y"], 8, 4)
    mean, std = features.pool_window()
    return w.select("session_key", "row_idx", F.round(mean[0], 6).alias("mean0"), F.round(std[0], 6).alias("std0"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS packed FROM events""")
def v18_json(spark, d):
    e = table(spark, d, "events").withColumn("j", F.from_json("props", "k long"))
    return e.select("event_id", F.col("j.k").alias("k"), F.to_json(F.struct(F.col("j.k").alias("k"), F.col("event_type").alias("type"))).alias("packed"))


# --- windows


@query("""SELECT session_key, row_idx, row_idx = 0 AS first_row,
  round(CASE WHEN row_idx = 0 THEN 0.1 ELSE least(greatest(t_s - lag(t_s) OVER w, 0.05), 20000.0) END, 4) AS period, round(coalesce(speed_kmh - lag(speed_kmh) OVER w, 0), 6) AS speed_kmh_delta,
  round(coalesce(speed_kmh - lag(speed_kmh) OVER w, 0) / CASE WHEN row_idx = 0 THEN 0.1 ELSE least(greatest(t_s - lag(t_s) OVER w, 0.05), 20000.0) END, 3) AS speed_kmh_rate
FROM samples WINDOW w AS (PARTITION BY driver_id, session_key ORDER BY row_idx)""", PRELUDE)
def w1_deltas(spark, d):
    out = segments.deltas(samples(spark, d), KEYS, ["speed_kmh"], "t_s", clip=(0.05, 20000.0))
    return out.select("session_key", "row_idx", (F.col("row_idx") == 0).alias("first_row"), F.round("period", 4).alias("period"), F.round("speed_kmh_delta", 6).alias("speed_kmh_delta"), F.round("speed_kmh_rate", 3).alias("speed_kmh_rate"))


@query("SELECT session_key, row_idx, raw_segment FROM runs", SEGMENTED)
def w2_segment_rows(spark, d):
    return segmented(spark, d).select("session_key", "row_idx", "raw_segment")


@query("SELECT session_key, row_idx, segment_id FROM segmented", SEGMENTED)
def w3_renumber_segments(spark, d):
    return segmented(spark, d).select("session_key", "row_idx", "segment_id")


@query(f"""SELECT driver_id, session_key, count(*) FILTER (WHERE phone_step <= 0 OR phone_step > {MAX_GAP}) AS phone_time_breaks, count(*) FILTER (WHERE phone_step <= 0 OR phone_step > {MAX_GAP}) AS vehicle_time_breaks,
  count(*) FILTER (WHERE velocity_step > {MAX_JUMP}) AS velocity_jump_breaks, count(*) FILTER (WHERE raw_segment < 0) AS invalid_rows,
  count(DISTINCT raw_segment) FILTER (WHERE raw_segment >= 0) AS raw_segments, count(DISTINCT segment_id) FILTER (WHERE segment_id >= 0) AS accepted_segments, count(*) FILTER (WHERE segment_id < 0) AS rows_excluded
FROM segmented GROUP BY ALL""", SEGMENTED)
def w3_segment_audit(spark, d):
    return segments.segment_audit(segmented(spark, d), KEYS, MAX_GAP, MAX_JUMP)


@query("SELECT * REPLACE (round(duration_seconds, 4) AS duration_seconds) FROM segment_table", SEGMENTED)
def w4_segment_table(spark, d):
    return rounded(segments.segment_table(archived(spark, d), KEYS, "t_s"), "duration_seconds", places=4)


@query("""SELECT session_key, run, rows, first_row, last_row FROM (
  SELECT session_key, run, count(*) AS rows, min(row_idx) AS first_row, max(row_idx) AS last_row, row_number() OVER (PARTITION BY session_key ORDER BY count(*) DESC, run) AS r FROM (
    SELECT *, CAST(sum(b) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (
      SELECT *, CASE WHEN coalesce(step <= 0 OR step > 50000, true) THEN 1 ELSE 0 END AS b FROM (SELECT *, t_s - lag(t_s) OVER (PARTITION BY session_key ORDER BY row_idx) AS step FROM samples)))
  GROUP BY session_key, run) WHERE r = 1""", PRELUDE)
def w5_longest_segment(spark, d):
    return segments.longest_segment(samples(spark, d), KEYS, "t_s", 50_000.0).drop("driver_id")


@query("""SELECT driver_id, session_key, segment_id, row_idx,
  CASE WHEN count(speed_kmh) OVER w3 = 3 THEN round(avg(speed_kmh) OVER w3, 6) END AS mean_3, CASE WHEN count(speed_kmh) OVER w3 = 3 THEN round(stddev_pop(speed_kmh) OVER w3, 6) END AS std_3,
  CASE WHEN count(speed_kmh) OVER w5 = 5 THEN round(max(speed_kmh) OVER w5 - min(speed_kmh) OVER w5, 6) END AS range_5, CASE WHEN count(k) OVER w5 = 5 THEN round(avg(k * k) OVER w5, 6) END AS energy_5
FROM archived WINDOW w3 AS (PARTITION BY driver_id, session_key, segment_id ORDER BY row_idx ROWS 2 PRECEDING), w5 AS (PARTITION BY driver_id, session_key, segment_id ORDER BY row_idx ROWS 4 PRECEDING)""", SEGMENTED)
def w6_rolling_features(spark, d):
    f = features.rolling_features(archived(spark, d), SEGMENT, ["speed_kmh"], (3, 5), {"k": "k"})
    return f.select(*SEGMENT, "row_idx", F.round("speed_kmh_mean_3", 6).alias("mean_3"), F.round("speed_kmh_std_3", 6).alias("std_3"), F.round("speed_kmh_range_5", 6).alias("range_5"), F.round("k_energy_5", 6).alias("energy_5"))


@query("""SELECT session_key, row_idx, CASE WHEN count(*) OVER w = 10 THEN round(avg(acc_x) OVER w, 6) END AS acc_x_mean_10, CASE WHEN count(*) OVER w = 10 THEN round(stddev_pop(gyro_z) OVER w, 6) END AS gyro_z_std_10, CASE WHEN count(*) OVER w = 10 THEN round(max(gravity_y) OVER w - min(gravity_y) OVER w, 6) END AS gravity_y_range_10
FROM imu_vec WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS 9 PRECEDING)""", PRELUDE)
def w6_rolling_features_wide(spark, d):
    f = features.rolling_features_wide(imu_vec(spark, d), KEYS, AXES, (5, 10, 20))
    cols = ("acc_x_mean_10", "gyro_z_std_10", "gravity_y_range_10")
    return rounded(f.select("session_key", "row_idx", *cols), *cols)


@query("""SELECT session_key, row_idx, CASE WHEN count(acc_x) OVER w = 5 THEN round(avg(acc_x) OVER w, 6) END AS smooth
FROM imu_vec WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""", PRELUDE)
def w7_smooth_centered(spark, d):
    return imu_vec(spark, d).select("session_key", "row_idx", F.round(features.smooth_centered("acc_x", KEYS), 6).alias("smooth"))


@query("""SELECT session_key, row_idx, round(b, 6) AS bias, round(linear_x - b, 6) AS debiased FROM (
  SELECT *, coalesce(avg(linear_x) OVER (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS b FROM motion)""", PRELUDE)
def w8_causal_bias(spark, d):
    m = motion(spark, d).withColumn("bias", features.causal_bias("linear_x", KEYS, 10))
    return m.select("session_key", "row_idx", F.round("bias", 6).alias("bias"), F.round(F.col("linear_x") - F.col("bias"), 6).alias("debiased"))


@query("""SELECT driver_id, session_key, segment_id, row_idx, round(speed_kmh / 3.6 - lag(speed_kmh / 3.6, 2) OVER (PARTITION BY driver_id, session_key, segment_id ORDER BY row_idx), 6) AS delta_v FROM archived""", SEGMENTED)
def w9_delta_v_target(spark, d):
    return archived(spark, d).select(*SEGMENT, "row_idx", F.round(features.delta_target(F.col("speed_kmh") / 3.6, SEGMENT, 2), 6).alias("delta_v"))


@query("""SELECT session_key, row_idx, CASE WHEN n > 1 THEN round(degrees(atan2(ge, gn)) - 360 * floor(degrees(atan2(ge, gn)) / 360), 4) END AS course_deg FROM (
  SELECT session_key, row_idx, count(*) OVER (PARTITION BY session_key) AS n, coalesce((lead(e) OVER w - lag(e) OVER w) / 2, lead(e) OVER w - e, e - lag(e) OVER w) AS ge, coalesce((lead(f) OVER w - lag(f) OVER w) / 2, lead(f) OVER w - f, f - lag(f) OVER w) AS gn FROM (
    SELECT session_key, row_idx, sum(k * 3) OVER x / 5 AS e, sum(value) OVER x / 5 AS f FROM samples WINDOW x AS (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  WINDOW w AS (PARTITION BY session_key ORDER BY row_idx))""", PRELUDE)
def w10_course_over_ground(spark, d):
    s = features.course_over_ground(samples(spark, d).withColumns({"east": F.col("k") * 3, "north": F.col("value")}), KEYS)
    return rounded(s.select("session_key", "row_idx", "course_deg"), "course_deg", places=4)


@query("""SELECT session_key, row_idx, round(coalesce((lead(value) OVER w - lag(value) OVER w) / 0.2, (lead(value) OVER w - value) / 0.1, (value - lag(value) OVER w) / 0.1), 6) AS g
FROM samples WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)""", PRELUDE)
def w11_gradient(spark, d):
    return samples(spark, d).select("session_key", "row_idx", F.round(features.gradient("value", KEYS), 6).alias("g"))


@query("""SELECT session_key, row_idx, round(sum(dh) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING), 5) AS heading FROM (
  SELECT *, coalesce(atan2(sin(radians(h - lag(h) OVER w)), cos(radians(h - lag(h) OVER w))), radians(h)) AS dh FROM (SELECT *, 3.5 * k AS h FROM samples) WINDOW w AS (PARTITION BY session_key ORDER BY row_idx))""", PRELUDE)
def w12_unwrap(spark, d):
    s = samples(spark, d).withColumn("h", F.radians(3.5 * F.col("k")))
    return rounded(features.unwrap(s, KEYS, "h", "heading").select("session_key", "row_idx", "heading"), "heading", places=5)


HELD = PRELUDE + """, held AS (
  SELECT session_key, row_idx, CASE WHEN event_id % 7 <> 0 THEN floor(k / 25) END AS x FROM samples
), gaps AS (
  SELECT *, max(CASE WHEN x IS NOT NULL THEN row_idx END) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS p0,
         min(CASE WHEN x IS NOT NULL THEN row_idx END) OVER (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p1 FROM held
), filled AS (
  SELECT g.session_key, g.row_idx, coalesce(g.x, a.x + (b.x - a.x) * (g.row_idx - p0) / (p1 - p0), a.x, b.x) AS f
  FROM gaps g LEFT JOIN held a ON a.session_key = g.session_key AND a.row_idx = p0 LEFT JOIN held b ON b.session_key = g.session_key AND b.row_idx = p1
), knots AS (
  SELECT *, lag(f) OVER w IS NULL OR f <> lag(f) OVER w OR lead(f) OVER w IS NULL AS knot FROM filled WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)
), around AS (
  SELECT *, max(CASE WHEN knot THEN row_idx END) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS p0,
         min(CASE WHEN knot THEN row_idx END) OVER (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p1 FROM knots
)
"""


@query("""SELECT g.session_key, g.row_idx, round(CASE WHEN g.knot THEN g.f ELSE a.f + (b.f - a.f) * (g.row_idx - p0) / (p1 - p0) END, 6) AS speed
FROM around g LEFT JOIN filled a ON a.session_key = g.session_key AND a.row_idx = p0 LEFT JOIN filled b ON b.session_key = g.session_key AND b.row_idx = p1""", HELD)
def w13_interpolate_held(spark, d):
    s = samples(spark, d).withColumn("x", F.when(F.pmod("event_id", F.lit(7)) != 0, F.floor(F.col("k") / 25).cast("double")))
    return rounded(features.interpolate_held(s, KEYS, "x", "speed").select("session_key", "row_idx", "speed"), "speed")


@query("""SELECT g.session_key, g.row_idx, round(coalesce(r.rate, p.rate, q.rate, 0), 6) AS rate FROM marks g
LEFT JOIN rates r ON r.session_key = g.session_key AND g.row_idx >= r.row_idx AND g.row_idx < r.next_row
LEFT JOIN (SELECT session_key, max_by(rate, row_idx) AS rate, max(next_row) AS n FROM rates GROUP BY 1) p ON p.session_key = g.session_key AND g.row_idx >= p.n
LEFT JOIN (SELECT session_key, min_by(rate, row_idx) AS rate, min(row_idx) AS n FROM rates GROUP BY 1) q ON q.session_key = g.session_key AND g.row_idx < q.n""", PRELUDE + """, marks AS (
  SELECT session_key, row_idx, value, floor(row_idx / 4) + (k > 50)::INT AS mark FROM samples
), arrivals AS (
  SELECT * FROM (SELECT *, mark <> lag(mark) OVER (PARTITION BY session_key ORDER BY row_idx) AS knot FROM marks) WHERE knot
), rates AS (
  SELECT * FROM (SELECT session_key, row_idx, lead(row_idx) OVER w AS next_row, (lead(value) OVER w - value) / ((lead(row_idx) OVER w - row_idx) * 0.1) AS rate FROM arrivals WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)) WHERE next_row IS NOT NULL
)""")
def w14_interval_rates(spark, d):
    s = samples(spark, d).withColumn("mark", F.floor(F.col("row_idx") / 4) + (F.col("k") > 50).cast("int"))
    return rounded(features.interval_rates(s, KEYS, "value", "mark", "rate").select("session_key", "row_idx", "rate"), "rate")


@query("""SELECT session_key, row_idx, round(sum(speed_kmh / 3.6 / 10) OVER w, 6) AS dist, round(sum(t) OVER w, 6) AS turn FROM (
  SELECT *, coalesce(abs(atan2(sin(h - lag(h) OVER v), cos(h - lag(h) OVER v))), 0) AS t FROM (SELECT *, radians(heading_deg) AS h FROM samples) WINDOW v AS (PARTITION BY session_key ORDER BY row_idx)
) WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING)""", PRELUDE)
def w15_cumulative(spark, d):
    s = samples(spark, d).withColumn("dist", features.cumulative_distance(F.col("speed_kmh") / 3.6, KEYS)).withColumn("h", F.radians("heading_deg"))
    return rounded(features.cumulative_turn(s, KEYS, "h", "turn").select("session_key", "row_idx", "dist", "turn"), "dist", "turn")


@query("""SELECT session_key, row_idx, quiet, quiet AND t_s - min(CASE WHEN quiet THEN t_s END) OVER (PARTITION BY session_key, loud) >= 20000 AS stationary FROM (
  SELECT *, max(CASE WHEN NOT quiet THEN t_s END) OVER (PARTITION BY session_key ORDER BY t_s ROWS UNBOUNDED PRECEDING) AS loud FROM (
    SELECT *, coalesce(count(*) OVER w >= 2 AND var_pop(value) OVER w < 400 AND avg(value) OVER w < 40 AND avg(k) OVER w < 60, false) AS quiet FROM samples
    WINDOW w AS (PARTITION BY session_key ORDER BY t_s RANGE BETWEEN 100000 PRECEDING AND CURRENT ROW)))""", PRELUDE)
def w16_stationary(spark, d):
    s = features.stationary(samples(spark, d), KEYS, "t_s", "value", "k", 100_000.0, 20_000.0, 2, 400.0, 40.0, 60.0)
    return s.select("session_key", "row_idx", "quiet", "stationary")


@query("""SELECT session_key, row_idx, value > 60 AS shock, count(*) FILTER (WHERE value > 60) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS shocks FROM samples""", PRELUDE)
def w17_shock_count(spark, d):
    return features.shock_count(samples(spark, d), KEYS, "value", 60.0).select("session_key", "row_idx", "shock", "shocks")


@query("""SELECT session_key, row_idx, count(*) OVER w = 10 AND var_pop(gyro_x) OVER w + var_pop(gyro_y) OVER w + var_pop(gyro_z) OVER w > 0.002 AS moved
FROM imu_vec WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS 9 PRECEDING)""", PRELUDE)
def w18_knock_flag(spark, d):
    return imu_vec(spark, d).select("session_key", "row_idx", features.knock_flag(("gyro_x", "gyro_y", "gyro_z"), KEYS, 10, 0.002, 1.0).alias("moved"))


@query("""SELECT session_key, row_idx, round(y, 6) AS y FROM smooth""", PRELUDE.replace("WITH telemetry", "WITH RECURSIVE telemetry") + """, smooth AS (
  SELECT session_key, row_idx, speed_kmh AS y FROM samples WHERE row_idx = 0
  UNION ALL
  SELECT s.session_key, s.row_idx, y + (1 - exp(-0.1 / 0.5)) * (s.speed_kmh - y) FROM smooth JOIN samples s ON s.session_key = smooth.session_key AND s.row_idx = smooth.row_idx + 1
)""")
def w19_ema(spark, d):
    return rounded(features.ema(samples(spark, d), KEYS, "speed_kmh", "y", 0.5).select("session_key", "row_idx", "y"), "y")


@query("""SELECT session_key, row_idx, round(total, 6) AS total, round(label, 6) AS label FROM (
  SELECT *, sum(acc_x) OVER w AS total, count(*) OVER w AS n, gyro_z AS label FROM imu_vec WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS 9 PRECEDING)) WHERE n = 10 AND (row_idx - 9) % 4 = 0""", PRELUDE)
def w20_feature_windows(spark, d):
    w = features.feature_windows(imu_vec(spark, d), KEYS, ["acc_x", "acc_y", "acc_z"], 10, 4, "gyro_z")
    total = F.aggregate("window", F.lit(0.0), lambda s, r: s + r[0])
    return w.select("session_key", "row_idx", F.round(total, 6).alias("total"), F.round("label", 6).alias("label"))


@query("""SELECT session_key, row_idx, round(gn, 6) AS gyro_norm_last, CASE WHEN row_idx >= 4 THEN 1.0 END AS dt_first, 6 AS labels FROM (
  SELECT session_key, row_idx, sqrt(gyro_x ** 2 + gyro_y ** 2 + gyro_z ** 2) AS gn FROM imu_vec) WHERE row_idx >= 4 AND (row_idx - 4) % 3 = 0""", PRELUDE)
def w21_imu9_windows(spark, d):
    w = features.imu9_windows(imu_vec(spark, d).withColumn("t", F.col("row_idx").cast("double")), KEYS, ("acc_x", "acc_y", "acc_z"), ("gyro_x", "gyro_y", "gyro_z"), "t", 5, 3)
    return w.select("session_key", "row_idx", F.round(F.element_at(F.element_at("window", 5), 8), 6).alias("gyro_norm_last"), F.element_at(F.element_at("window", 1), 9).alias("dt_first"), F.size("label").alias("labels"))


@query("SELECT session_key, row_idx, row_idx // 20 AS block_id, row_idx % 20 AS position_in_block FROM samples", PRELUDE)
def w22_block_layout(spark, d):
    return features.block_layout(samples(spark, d), 20).select("session_key", "row_idx", "block_id", "position_in_block")


@query("SELECT session_key, row_idx, row_number() OVER (PARTITION BY session_key ORDER BY value, event_id) AS position FROM samples", PRELUDE)
def w23_position_rank(spark, d):
    from roadtrace.operators import ranking

    return ranking.position_rank(samples(spark, d), KEYS, ["value", "event_id"]).select("session_key", "row_idx", "position")
