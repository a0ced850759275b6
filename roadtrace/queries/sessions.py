"""Joins, aggregates, rankings, sets, splits and alignment over the telemetry views."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo, stats
from roadtrace.operators import aggregates, align, features, joins, ranking, segments, sets, splits, validate
from roadtrace.queries.registry import query
from roadtrace.queries.views import KEYS, PRELUDE, SEGMENT, fixes, imu, imu_vec, long_samples, samples, table, vehicle
from roadtrace.queries.windows import MAX_GAP, MAX_JUMP, SEGMENTED, archived, motion, rounded
from roadtrace.session import shared_base, written_once
from roadtrace.sources import sinks

SEPARATION = "2 * 6371000.0 * atan2(sqrt(hav), sqrt(greatest(1 - hav, 0)))"
PAIRS = PRELUDE + f""", paired AS (
  SELECT *, {SEPARATION} AS sep FROM (
    SELECT p.driver_id, p.session_key, p.row_idx, p.t_s AS phone_t, v.vehicle_t, p.speed_kmh AS phone_speed_kmh, v.velocity_kmh, p.k,
           sin(radians(v.vehicle_lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(v.vehicle_lat)) * sin(radians(v.vehicle_lon - p.lon) / 2) ** 2 AS hav
    FROM samples p JOIN vehicle v USING (driver_id, session_key, row_idx))
)
"""


def corr_sql(x, y, n, over=""):
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    sd = f"stddev_pop({a}) * stddev_pop({b})"
    return f"CASE WHEN count({a}) >= {n} AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / nullif({sd}, 0) END"


def pairs(spark, d):
    p = samples(spark, d).withColumnsRenamed({"t_s": "phone_t", "speed_kmh": "phone_speed_kmh"})
    return joins.row_aligned_pairs(p, vehicle(spark, d), KEYS)


def bucketed_pairs(spark, d):
    """``pairs`` of two recordings that were written in buckets by session: written once, they meet without a shuffle, here and in every later query."""
    joins.co_located(spark)
    p = samples(spark, d).withColumnsRenamed({"t_s": "phone_t", "speed_kmh": "phone_speed_kmh"})
    sides = []
    for name, rows in (("phone", p), ("vehicle", vehicle(spark, d))):
        table_name = f"roadtrace_{name}_{uuid.uuid4().hex[:12]}"
        sinks.write_bucketed(rows, table_name, KEYS, buckets=16, path=f"{shared_base(spark)}/{table_name}")
        sides.append(spark.table(table_name))
    return joins.row_aligned_pairs(*sides, KEYS)


# --- joins


@query("SELECT session_key, row_idx, round(phone_speed_kmh, 6) AS phone_speed_kmh, round(velocity_kmh, 6) AS velocity_kmh FROM paired", PAIRS)
def j1_row_aligned_pairs(spark, d):
    return rounded(pairs(spark, d).select("session_key", "row_idx", "phone_speed_kmh", "velocity_kmh"), "phone_speed_kmh", "velocity_kmh")


@query("SELECT session_key, row_idx, round(phone_speed_kmh, 6) AS phone_speed_kmh, round(velocity_kmh, 6) AS velocity_kmh FROM paired", PAIRS)
def j1_row_aligned_bucketed(spark, d):
    return rounded(bucketed_pairs(spark, d).select("session_key", "row_idx", "phone_speed_kmh", "velocity_kmh"), "phone_speed_kmh", "velocity_kmh")


@query("""SELECT p.session_key, p.row_idx, v.row_idx AS vehicle_row, round(v.velocity_kmh, 6) AS velocity_kmh FROM samples p JOIN vehicle v ON v.session_key = p.session_key AND v.row_idx = p.row_idx + (p.user_id % 5) - 2""", PRELUDE)
def j2_offset_aligned_pairs(spark, d):
    p = samples(spark, d)
    offsets = p.groupBy(*KEYS).agg((F.pmod(F.first("user_id"), F.lit(5)) - 2).alias("offset"))
    return rounded(joins.offset_aligned_pairs(p, vehicle(spark, d), offsets, KEYS).select("session_key", "row_idx", "vehicle_row", "velocity_kmh"), "velocity_kmh")


@query("""SELECT p.session_key, lag, count(*) AS pairs, round(sum(v.velocity_kmh), 4) AS total FROM samples p, (SELECT unnest(range(-3, 4)) AS lag) l JOIN vehicle v ON v.session_key = p.session_key AND v.row_idx = p.row_idx + lag GROUP BY ALL""", PRELUDE)
def j3_lag_sweep_pairs(spark, d):
    p = joins.lag_sweep_pairs(samples(spark, d).select(*KEYS, "row_idx"), vehicle(spark, d), KEYS, 3)
    return p.groupBy("session_key", F.col("lag").cast("long").alias("lag")).agg(F.count("*").alias("pairs"), F.round(F.sum("velocity_kmh"), 4).alias("total"))


@query("""SELECT i.event_id, round(f.accuracy, 6) AS accuracy, round(i.t_s - f.fix_t, 4) AS fix_age FROM imu i ASOF LEFT JOIN fixes f ON i.session_key = f.session_key AND i.t_s >= f.fix_t""", PRELUDE)
def j4_as_of_fix(spark, d):
    out = joins.as_of(imu(spark, d), fixes(spark, d), KEYS, "t_s", "fix_t", ["accuracy"], "event_id")
    return out.select("event_id", F.round("accuracy", 6).alias("accuracy"), F.round("fix_age", 4).alias("fix_age"))


@query("""SELECT session_key, row_idx, first(value ORDER BY row_idx) OVER (PARTITION BY session_key, row_idx // 10 ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS held FROM samples""".replace("first(value ORDER BY row_idx)", "first_value(value)"), PRELUDE)
def j5_hold_at_1hz(spark, d):
    return samples(spark, d).select("session_key", "row_idx", joins.hold("value", KEYS, "row_idx").alias("held"))


ELIGIBLE = SEGMENTED + """, eligible AS (
  SELECT s.*, horizon_rows, greatest(0, rows - greatest(5, horizon_rows)) AS eligible_examples,
         CASE WHEN rows > greatest(5, horizon_rows) THEN archive_row_start + greatest(5, horizon_rows) ELSE -1 END AS first_row,
         CASE WHEN rows > greatest(5, horizon_rows) THEN archive_row_end ELSE -1 END AS last_row
  FROM segment_table s, (SELECT unnest([2, 8]) AS horizon_rows) h
)
"""


def segment_table(spark, d):
    return segments.segment_table(archived(spark, d), KEYS, "t_s")


@query("""SELECT e.driver_id, e.session_key, e.segment_id, e.horizon_rows, e.first_row - s.archive_row_start AS purge FROM eligible e JOIN segment_table s USING (driver_id, session_key, segment_id) WHERE e.eligible_examples > 0""", ELIGIBLE)
def j6_eligibility_segments(spark, d):
    s = segment_table(spark, d)
    e = splits.training_eligibility(s, [2, 8], 5).where("eligible_examples > 0")
    return e.drop("archive_row_start").join(s.select(*SEGMENT, "archive_row_start"), SEGMENT).select(*SEGMENT, "horizon_rows", (F.col("first_eligible_archive_row") - F.col("archive_row_start")).alias("purge"))


@query("""SELECT a.driver_id AS held_out, list(b.driver_id ORDER BY b.driver_id) AS others FROM (SELECT DISTINCT driver_id FROM samples) a, (SELECT DISTINCT driver_id FROM samples) b WHERE a.driver_id <> b.driver_id GROUP BY 1""", PRELUDE)
def j9_leave_one_driver_out(spark, d):
    return joins.leave_one_out(samples(spark, d).select("driver_id").distinct())


@query("""SELECT session_key, gain, decay, count(*) AS rows, round(sum(value * gain), 4) AS total FROM samples, (SELECT unnest([0.5, 1.0])::DOUBLE AS gain) g, (SELECT unnest([20, 40])::INTEGER AS decay) x GROUP BY ALL""", PRELUDE)
def j10_parameter_grid(spark, d):
    grid = [{"gain": g, "decay": x} for g in (0.5, 1.0) for x in (20, 40)]
    s = joins.with_grid(samples(spark, d).select("session_key", "value"), grid)
    return s.groupBy("session_key", "gain", "decay").agg(F.count("*").alias("rows"), F.round(F.sum(F.col("value") * F.col("gain")), 4).alias("total"))


@query("""WITH p AS (SELECT DISTINCT lang || '/' || source AS k FROM documents), v AS (SELECT DISTINCT 'en/' || source AS k FROM documents UNION SELECT DISTINCT lang || '/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) FROM documents JOIN pages ON page_id = doc_id)
SELECT k, 'phone' AS side FROM p WHERE k NOT IN (SELECT k FROM v WHERE k IS NOT NULL) AND k IS NOT NULL UNION ALL SELECT k, 'vehicle' FROM v WHERE k NOT IN (SELECT k FROM p WHERE k IS NOT NULL) AND k IS NOT NULL""")
def j11_unpaired_files(spark, d):
    """Languages with sources against English with all sources and languages with the hosts of pages of the same id."""
    docs, pages = table(spark, d, "documents"), table(spark, d, "pages")
    hosts = docs.join(pages, F.col("page_id") == F.col("doc_id")).select(F.concat("lang", F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("k"))
    p = docs.select(F.concat("lang", F.lit("/"), "source").alias("k"))
    v = docs.select(F.concat(F.lit("en/"), "source").alias("k")).unionByName(hosts)
    return joins.unpaired(p.where("k is not null"), v.where("k is not null"), ["k"])


@query("""WITH p AS (SELECT DISTINCT source AS k FROM documents), v AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS k FROM pages)
SELECT k, 'phone' AS side FROM p WHERE k NOT IN (SELECT k FROM v WHERE k IS NOT NULL) UNION ALL SELECT k, 'vehicle' FROM v WHERE k NOT IN (SELECT k FROM p WHERE k IS NOT NULL)""")
def j11_unpaired_files_whole(spark, d):
    """All sources of documents against all hosts of pages."""
    hosts = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("k"))
    return joins.unpaired(table(spark, d, "documents").select(F.col("source").alias("k")), hosts, ["k"])


# --- aggregates


@query("SELECT driver_id, session_key, round(" + corr_sql("phone_speed_kmh", "velocity_kmh", 3) + ", 6) AS corr, round(" + corr_sql("phone_speed_kmh", "velocity_kmh", 70) + ", 6) AS corr_70 FROM paired GROUP BY ALL", PAIRS)
def a1_safe_corr(spark, d):
    return pairs(spark, d).groupBy(*KEYS).agg(F.round(stats.safe_corr("phone_speed_kmh", "velocity_kmh", 3), 6).alias("corr"), F.round(stats.safe_corr("phone_speed_kmh", "velocity_kmh", 70), 6).alias("corr_70"))


@query("""SELECT event_type, count(value) AS samples, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(avg(abs(value)), 6) AS mean_abs, round(100 * avg((abs(value) < 1e-12)::INT), 6) AS zero_percent,
  """ + ", ".join(f"round(quantile_cont(value::DOUBLE, {p / 100}), 6) AS p{p}" for p in stats.PERCENTS) + " FROM samples GROUP BY 1", PRELUDE)
def a2_distribution(spark, d):
    out = samples(spark, d).groupBy("event_type").agg(*stats.distribution("value"))
    return rounded(out, "mean", "std", "mean_abs", "zero_percent", *[f"p{p}" for p in stats.PERCENTS])


@query("""SELECT name, count(x) AS valid, count(*) - count(x) AS invalid, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, count(DISTINCT x) AS unique FROM (
  SELECT 'k' AS name, k AS x FROM samples UNION ALL SELECT 'velocity_kmh', velocity_kmh FROM vehicle UNION ALL SELECT 'heading_deg', heading_deg FROM samples) GROUP BY 1""", PRELUDE)
def a3_column_profile(spark, d):
    s = joins.row_aligned_pairs(samples(spark, d), vehicle(spark, d), KEYS).withColumn("nothing", F.lit(None).cast("double"))
    return rounded(aggregates.column_profile(s, ["k", "velocity_kmh", "heading_deg", "nothing"]), "min", "max", "mean")


@query("SELECT 'one' AS name UNION ALL SELECT 'drive' WHERE (SELECT count(DISTINCT user_id % 1) FROM samples) = 1", PRELUDE)
def a4_constant_columns(spark, d):
    s = samples(spark, d).withColumns({"one": F.lit(1.0), "drive": F.pmod("user_id", F.lit(1)).cast("double")})
    return aggregates.constant_columns(aggregates.column_profile(s, ["k", "one", "drive"]))


@query("""SELECT session_key, round(min_by(t_s, row_idx), 4) AS start, round(max_by(t_s, row_idx) - min_by(t_s, row_idx), 4) AS span_seconds, count(*) FILTER (WHERE x < 0) AS negative_deltas, count(*) FILTER (WHERE x = 0) AS zero_deltas, count(*) FILTER (WHERE x > 100000) AS large_gaps,
  count(*) FILTER (WHERE x <= 0 OR x > 100000) AS anomalies, """ + ", ".join(f"round(max(x) FILTER (WHERE r = least(n, CAST(round_even({f} * (n - 1), 0) AS BIGINT) + 1)), 4) AS {name}" for name, f in (("d_min", 0.0), ("p01", 0.01), ("p50", 0.5), ("p99", 0.99), ("d_max", 1.0))) + """
FROM (SELECT *, CASE WHEN x IS NOT NULL THEN row_number() OVER (PARTITION BY session_key, x IS NULL ORDER BY x, row_idx) END AS r, count(x) OVER (PARTITION BY session_key) AS n FROM (SELECT *, t_s - lag(t_s) OVER (PARTITION BY session_key ORDER BY row_idx) AS x FROM samples)) GROUP BY 1""", PRELUDE)
def a5_delta_summary(spark, d):
    out = aggregates.delta_summary(samples(spark, d), ["session_key"], "t_s", 20_000.0)
    out = out.withColumn("anomalies", F.size("anomalies").cast("long")).drop("end")
    return rounded(out, "start", "span_seconds", "d_min", "p01", "p50", "p99", "d_max", places=4)


AUDIT = PAIRS + f""", stepped AS (
  SELECT *, phone_t - lag(phone_t) OVER w AS dp, vehicle_t - lag(vehicle_t) OVER w AS dv FROM paired WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)
), audit AS (
  SELECT *, CASE WHEN speed_corr >= 0.05 AND separation_median <= 100 THEN 'strong' ELSE 'review' END AS quality FROM (
    SELECT driver_id, session_key, count(*) AS paired_rows, quantile_cont(dp, 0.5) AS phone_period, quantile_cont(dv, 0.5) AS vehicle_period,
           count(*) FILTER (WHERE dp <= 0 OR dp > 50000) AS phone_bad_steps, count(*) FILTER (WHERE dv <= 0 OR dv > 90000) AS vehicle_bad_steps, count(*) FILTER (WHERE dv > 90000) AS vehicle_large_gaps,
           count(*) FILTER (WHERE phone_speed_kmh IS NULL) AS phone_speed_invalid, count(*) FILTER (WHERE velocity_kmh IS NULL) AS velocity_invalid,
           {corr_sql("phone_speed_kmh", "velocity_kmh", 3)} AS speed_corr, avg(sep) AS separation_mean, quantile_cont(sep, 0.5) AS separation_median, quantile_cont(sep, 0.95) AS separation_p95
    FROM stepped GROUP BY ALL)
)
"""
AUDITED = ("phone_period", "vehicle_period", "speed_corr", "separation_mean", "separation_median", "separation_p95")


def audit(spark, d):
    return aggregates.audit_pairs(pairs(spark, d), KEYS, 50_000.0, 90_000.0)


@query("SELECT * EXCLUDE (quality) REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in AUDITED) + "), CASE WHEN speed_corr >= 0.8 AND separation_median <= 100 THEN 'strong' ELSE 'review' END AS quality FROM audit", AUDIT)
def a6_audit_pair(spark, d):
    return rounded(audit(spark, d), *AUDITED, places=4)


@query("SELECT * EXCLUDE (quality) REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in AUDITED) + "), CASE WHEN speed_corr >= 0.8 AND separation_median <= 100 THEN 'strong' ELSE 'review' END AS quality FROM audit", AUDIT)
def a6_audit_bucketed(spark, d):
    return rounded(aggregates.audit_pairs(bucketed_pairs(spark, d), KEYS, 50_000.0, 90_000.0), *AUDITED, places=4)


@query("""SELECT session_key, arg_max(feature, (abs(c), -i)) AS best_feature, round(arg_max(c, (abs(c), -i)), 6) AS best_corr FROM (
  """ + " UNION ALL ".join(f"SELECT session_key, {i} AS i, '{f}' AS feature, {corr_sql(f, 'gyro_z', 3)} AS c FROM motion GROUP BY 1" for i, f in enumerate(("linear_x", "linear_y", "linear_z", "linear_vertical", "linear_horizontal"))) + ") GROUP BY 1", PRELUDE)
def a7_best_axis_corr(spark, d):
    out = aggregates.best_axis_corr(motion(spark, d), ["session_key"], ["linear_x", "linear_y", "linear_z", "linear_vertical", "linear_horizontal"], "gyro_z")
    return rounded(out, "best_corr")


def lenient_audit(spark, d):
    """The audit with a lower bar, so that the view has sessions of both qualities."""
    ok = F.coalesce((F.col("speed_corr") >= 0.05) & (F.col("separation_median") <= 100), F.lit(False))
    return audit(spark, d).withColumn("quality", F.when(ok, "strong").otherwise("review"))


@query("SELECT driver_id, count(*) AS sessions, CAST(sum(paired_rows) AS BIGINT) AS rows, round(quantile_cont(speed_corr, 0.5), 6) AS median_speed_corr, count(*) FILTER (WHERE quality = 'strong') AS strong_sessions, count(*) FILTER (WHERE quality = 'review') AS review_sessions FROM audit GROUP BY 1", AUDIT)
def a8_driver_summary(spark, d):
    return rounded(aggregates.driver_summary(lenient_audit(spark, d)), "median_speed_corr")


@query("SELECT quality, count(*) AS sessions FROM audit GROUP BY 1", AUDIT)
def a9_quality_totals(spark, d):
    return aggregates.quality_totals(lenient_audit(spark, d))


HOLDOUT = PRELUDE + """, totals AS (
  SELECT driver_id, row_number() OVER (ORDER BY count(*) DESC, driver_id) AS r FROM samples GROUP BY 1
), sessions AS (
  SELECT driver_id, session_key, count(*) AS paired_rows FROM samples GROUP BY ALL
), holdout AS (
  SELECT s.*, CASE r WHEN 1 THEN 'train' WHEN 2 THEN 'validation' ELSE 'test' END AS driver_holdout_split FROM sessions s JOIN totals USING (driver_id)
)
"""


def sessions(spark, d):
    return samples(spark, d).groupBy(*KEYS).agg(F.count("*").alias("paired_rows"))


@query("SELECT driver_holdout_split, driver_id, count(*) AS sessions, CAST(sum(paired_rows) AS BIGINT) AS rows FROM holdout GROUP BY ALL", HOLDOUT)
def a10_split_summary(spark, d):
    return aggregates.split_summary(splits.driver_holdout(sessions(spark, d)), "driver_holdout_split", "paired_rows")


METRICS = """round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) ** 2)), 6) AS rmse, round(1 - sum((p - a) ** 2) / nullif(sum(a * a) - sum(a) * sum(a) / count(a), 0), 6) AS r2, round(avg(p - a), 6) AS bias,
  """ + ", ".join(f"round(100 * avg((abs(p - a) <= {k})::INT), 6) AS within_{k}_percent" for k in (1, 2, 5))


@query(f"SELECT driver_id, {METRICS} FROM (SELECT driver_id, phone_speed_kmh AS a, velocity_kmh AS p FROM paired WHERE velocity_kmh IS NOT NULL) GROUP BY 1", PAIRS)
def a11_regression_metrics(spark, d):
    out = pairs(spark, d).groupBy("driver_id").agg(*stats.regression_metrics("phone_speed_kmh", "velocity_kmh"))
    return rounded(out, *[c for c in out.columns if c != "driver_id"])


@query("""SELECT session_key, round(sqrt(avg(ex ** 2)), 6) AS position_rmse_0, round(sqrt(avg(ey ** 2)), 6) AS position_rmse_1, round(sqrt(avg(ez ** 2)), 6) AS position_rmse_2, round(sqrt(avg(ex ** 2 + ey ** 2 + ez ** 2)), 6) AS position_rmse,
  round(sqrt(max(ex ** 2 + ey ** 2 + ez ** 2)), 6) AS position_max, round(quantile_cont(sqrt(ex ** 2 + ey ** 2 + ez ** 2), 0.95), 6) AS position_p95 FROM (SELECT session_key, acc_x - gravity_x AS ex, acc_y - gravity_y AS ey, acc_z - gravity_z AS ez FROM imu_vec) GROUP BY 1""", PRELUDE)
def a14_vector_error_metrics(spark, d):
    out = imu_vec(spark, d).groupBy("session_key").agg(*aggregates.vector_error_metrics([("acc_x", "gravity_x"), ("acc_y", "gravity_y"), ("acc_z", "gravity_z")], "position"))
    return rounded(out, *out.columns[1:])


@query("""SELECT session_key, round(atan2(sum(sin(radians(heading_deg))), sum(cos(radians(heading_deg)))), 6) AS mean_angle, round(sqrt(sum(sin(radians(heading_deg))) ** 2 + sum(cos(radians(heading_deg))) ** 2) / count(*), 6) AS r FROM samples GROUP BY 1""", PRELUDE)
def a15_circular(spark, d):
    s = samples(spark, d).withColumn("a", F.radians("heading_deg"))
    return rounded(s.groupBy("session_key").agg(stats.circular_mean("a").alias("mean_angle"), stats.circular_r("a").alias("r")), "mean_angle", "r")


@query("""SELECT session_key, count(*) - 1 AS changes, round((count(*) - 1) / greatest(max(t1) - min(t0), 1e-9), 9) AS update_rate_hz, quantile_cont(n::DOUBLE, 0.5) AS run_p50, round(quantile_cont(n::DOUBLE, 0.9), 6) AS run_p90, max(n) AS run_max FROM (
  SELECT session_key, run, count(*) AS n, min(t_s) AS t0, max(t_s) AS t1 FROM (
    SELECT *, sum(ch) OVER (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN coalesce(floor(k / 50) <> lag(floor(k / 50)) OVER (PARTITION BY session_key ORDER BY row_idx), false) THEN 1 ELSE 0 END AS ch FROM samples)) GROUP BY ALL) GROUP BY 1""", PRELUDE)
def a16_held_signal_stats(spark, d):
    s = samples(spark, d).withColumn("h", F.floor(F.col("k") / 50))
    out = aggregates.held_signal_stats(s, ["session_key"], "h", "t_s")
    return out.withColumns({"update_rate_hz": F.round("update_rate_hz", 9), "run_p90": F.round("run_p90", 6)})


@query("""SELECT s.event_id, round((s.value - m) / sd, 6) AS value_scaled, round(s.k - s.k, 6) AS zero FROM samples s, (SELECT avg(value) AS m, CASE WHEN stddev_pop(value) < 1e-5 THEN 1 ELSE stddev_pop(value) END AS sd FROM samples WHERE driver_id = 'A')""", PRELUDE)
def a17_fit_scaler(spark, d):
    s = samples(spark, d).withColumns({"split": F.when(F.col("driver_id") == "A", "train").otherwise("test"), "flat": F.lit(3.0)})
    out = aggregates.apply_scaler(s, aggregates.fit_scaler(s, ["value", "flat"]), ["value", "flat"])
    return out.select("event_id", F.round("value_scaled", 6).alias("value_scaled"), F.round("flat_scaled", 6).alias("zero"))


CANDIDATES = ("linear_x", "linear_y", "linear_vertical", "gyro_norm")


@query("SELECT feature, round(c, 6) AS corr, row_number() OVER (ORDER BY abs(c) DESC NULLS LAST, feature) AS rank FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {corr_sql('m_' + c, 'dv', 20)} AS c FROM rolled" for c in CANDIDATES) + ")", PRELUDE + """, rolled AS (
  SELECT acc_z - lag(acc_z, 5) OVER w AS dv, """ + ", ".join(f"CASE WHEN count({c}) OVER r = 5 THEN avg({c}) OVER r END AS m_{c}" for c in CANDIDATES) + """
  FROM motion WINDOW w AS (PARTITION BY session_key ORDER BY row_idx), r AS (PARTITION BY session_key ORDER BY row_idx ROWS 4 PRECEDING)
)""")
def a18_interval_mean_correlations(spark, d):
    return rounded(aggregates.interval_mean_correlations(motion(spark, d), KEYS, list(CANDIDATES), "acc_z", 5), "corr")


@query("""SELECT driver_id, count(*) AS blackouts, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median_drift, min(value) AS min_drift, round(100 * avg((value < 10)::INT), 6) AS under_limit_percent FROM samples GROUP BY 1""", PRELUDE)
def a19_fraction_under(spark, d):
    from roadtrace.operators import reckon

    out = reckon.drift_curve(samples(spark, d).withColumn("drift_percent", F.col("value")), ["driver_id"])
    return rounded(out, "median_drift", "under_limit_percent")


@query("""SELECT session_key, n, round((sxy * (syy + 2) - szy * sxz) / ((sxx + 2) * (syy + 2) - sxz * sxz), 6) AS b0, round((szy * (sxx + 2) - sxy * sxz) / ((sxx + 2) * (syy + 2) - sxz * sxz), 6) AS b1 FROM (
  SELECT session_key, count(*) AS n, sum((k - mk) * (k - mk)) AS sxx, sum((row_idx - mr) * (row_idx - mr)) AS syy, sum((k - mk) * (row_idx - mr)) AS sxz, sum((k - mk) * (value - mv)) AS sxy, sum((row_idx - mr) * (value - mv)) AS szy
  FROM (SELECT *, avg(k) OVER w AS mk, avg(row_idx) OVER w AS mr, avg(value) OVER w AS mv FROM samples WINDOW w AS (PARTITION BY session_key)) GROUP BY 1)""", PRELUDE)
def a20_ridge_from_moments(spark, d):
    from roadtrace.operators import rollout

    out = rollout.ridge_from_moments(samples(spark, d), ["session_key"], ["k", "row_idx"], "value", 2.0)
    return out.select("session_key", "n", F.round(F.col("coef")[0], 6).alias("b0"), F.round(F.col("coef")[1], 6).alias("b1"))


@query(f"""SELECT session_key, round(avg(sep), 4) AS separation_mean, round(quantile_cont(sep, 0.5), 4) AS separation_median, round(max(sep) FILTER (WHERE r = least(n, CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1)), 4) AS separation_p95, round(max(sep), 4) AS separation_max,
  round({corr_sql("phone_speed_kmh", "velocity_kmh", 2)}, 6) AS speed_corr, round({corr_sql("k", "radians(velocity_kmh)", 2)}, 6) AS yaw_corr, round({corr_sql("velocity_kmh", "k", 2)}, 6) AS indicated_corr
FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY sep, row_idx) AS r, count(sep) OVER (PARTITION BY session_key) AS n FROM paired) GROUP BY 1""", PAIRS)
def a21_row_alignment(spark, d):
    p = pairs(spark, d).withColumns({"phone_yaw_rate": F.col("k"), "vehicle_yaw_deg": F.col("velocity_kmh"), "indicated_kmh": F.col("k")})
    out = aggregates.row_alignment(p, ["session_key"])
    return out.select("session_key", *[F.round(c, 4).alias(c) for c in out.columns if c.startswith("sep")], *[F.round(c, 6).alias(c) for c in out.columns if c.endswith("corr")])


# --- rankings and sets

LAGS = PRELUDE + f""", lagged AS (
  SELECT p.driver_id, p.session_key, lag, p.speed_kmh AS x, v.velocity_kmh AS y, {SEPARATION.replace('hav', '(sin(radians(v.vehicle_lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(v.vehicle_lat)) * sin(radians(v.vehicle_lon - p.lon) / 2) ** 2)')} AS sep
  FROM samples p, (SELECT CAST(unnest(range(-50, 51)) AS INTEGER) AS lag) l JOIN vehicle v ON v.session_key = p.session_key AND v.row_idx = p.row_idx + lag
), sweep AS (
  SELECT driver_id, session_key, lag, {corr_sql("x", "y", 20)} AS speed_corr, quantile_cont(sep, 0.5) AS median_separation, quantile_cont(sep, 0.95) AS p95_separation FROM lagged GROUP BY ALL
), best AS (
  SELECT s.driver_id, s.session_key, coalesce(b.lag, 0) AS best_lag, b.speed_corr AS best_corr, coalesce(b.median_separation, s.median_separation) AS best_separation, b.p95_separation AS best_p95,
         s.speed_corr AS zero_corr, s.median_separation AS zero_separation, b.speed_corr - s.speed_corr AS gain
  FROM sweep s LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY speed_corr DESC, median_separation, lag) AS r FROM sweep WHERE speed_corr IS NOT NULL) WHERE r = 1) b ON b.session_key = s.session_key
  WHERE s.lag = 0
)
"""
LAG_COLUMNS = ("speed_corr", "median_separation", "p95_separation")
BEST_COLUMNS = ("best_corr", "best_separation", "best_p95", "zero_corr", "zero_separation", "gain")


def sweep(spark, d):
    return align.lag_sweep(samples(spark, d), vehicle(spark, d), KEYS, 50)


@query("SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in BEST_COLUMNS) + ") FROM best", LAGS)
def t1_best_lag(spark, d):
    return rounded(ranking.best_lag(sweep(spark, d), KEYS), *BEST_COLUMNS, places=4)


@query("SELECT session_key, axis, best_lag, round(best_corr, 6) AS best_corr, round(abs(best_corr) - coalesce(second, 0), 6) AS peak_margin FROM (SELECT b.*, (SELECT max(abs(corr)) FROM prof p WHERE p.session_key = b.session_key AND p.axis = b.axis AND abs(p.lag - b.best_lag) > 3) AS second FROM (SELECT session_key, arg_max(axis, (abs(corr), axis, -lag)) AS axis, arg_max(lag, (abs(corr), axis, -lag)) AS best_lag, arg_max(corr, (abs(corr), axis, -lag)) AS best_corr FROM prof GROUP BY 1) b)", PRELUDE + """, prof AS (
  SELECT session_key, CAST(row_idx % 3 AS INTEGER) AS axis, CAST(row_idx // 3 AS INTEGER) AS lag, acc_x / 10 AS corr FROM imu_vec)""")
def t2_best_channel(spark, d):
    p = imu_vec(spark, d).select("session_key", F.pmod("row_idx", F.lit(3)).cast("int").alias("axis"), F.floor(F.col("row_idx") / 3).cast("int").alias("lag"), (F.col("acc_x") / 10).alias("corr"))
    return rounded(ranking.best_channel(p, ["session_key"], 3), "best_corr", "peak_margin")


@query("SELECT session_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY session_key) AS n FROM samples) WHERE r = n // 2", PRELUDE)
def t3_representative_episode(spark, d):
    return ranking.representative(samples(spark, d), ["session_key"], "value", "event_id").select("session_key", "event_id")


@query("""SELECT event_id, round(least(value, 120) - 8 * k / 100 + CASE WHEN 8 * k > 60 AND 8 * k < 720 THEN least(8 * k, 400) * 0.05 ELSE -20 END, 6) AS score FROM samples ORDER BY 2 DESC, 1 LIMIT 1""", PRELUDE)
def t4_best_demo_blackout(spark, d):
    s = samples(spark, d).withColumns({"free": F.col("value"), "mapped": F.col("k") / 100, "turn": 8 * F.col("k")})
    s = s.withColumn("score", F.round(ranking.demo_score("free", "mapped", "turn"), 6))
    return ranking.top_one(s, F.col("score"), ["event_id"]).select("event_id", "score")


@query("SELECT round(min(score), 6) AS score, arg_min(driver_id, (score, driver_id)) AS driver_id FROM (SELECT driver_id, avg(value) AS score FROM samples GROUP BY 1)", PRELUDE)
def t5_select_parameters(spark, d):
    return rounded(ranking.select_parameters(samples(spark, d).groupBy("driver_id").agg(F.avg("value").alias("score")), ["driver_id"], "score"), "score")


@query("SELECT row_number() OVER (ORDER BY driver_id, session_key, segment_id) AS position, driver_id, session_key, segment_id FROM segment_table", SEGMENTED)
def t6_output_order(spark, d):
    # numbered per driver and offset by the drivers before it, so that no task sorts all segments
    s = segment_table(spark, d)
    counts = {r["driver_id"]: r["n"] for r in s.groupBy("driver_id").agg(F.count("*").alias("n")).collect()}
    before = F.create_map(*[F.lit(x) for i, k in enumerate(sorted(counts)) for x in (k, sum(counts[j] for j in sorted(counts)[:i]))])
    ranked = ranking.position_rank(s, ["driver_id"], ["session_key", "segment_id"])
    out = ranked.select((F.col("position") + before[F.col("driver_id")]).cast("long").alias("position"), *SEGMENT)
    return out.orderBy(*SEGMENT)


@query("SELECT event_id, event_type AS drive_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS local_index FROM events")
def u1_union_sessions(spark, d):
    """All rows of all sessions with their drive and place in it."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("drive_id"))
    return sets.numbered(e, "drive_id", "event_id")


@query("SELECT lang || '/' || source AS name FROM documents INTERSECT SELECT 'de/' || source FROM documents WHERE lang <> 'de'")
def u2_feature_overlap(spark, d):
    """Languages with sources, against German with the sources of all other languages."""
    docs = table(spark, d, "documents")
    others = docs.where("lang <> 'de'").select(F.concat(F.lit("de/"), "source").alias("name"))
    return sets.overlap(docs.select(F.concat("lang", F.lit("/"), "source").alias("name")), others)


@query("SELECT source AS name FROM documents WHERE lang = 'de' INTERSECT SELECT source FROM documents WHERE lang = 'es'")
def u2_feature_overlap_whole(spark, d):
    """The sources that two languages, German and Spanish, have in common."""
    docs = table(spark, d, "documents").withColumn("name", F.col("source"))
    return sets.overlap(docs.where("lang = 'de'").select("name"), docs.where("lang = 'es'").select("name"))


@query("SELECT split FROM (SELECT unnest(['train', 'validation', 'test', 'final']) AS split) WHERE split NOT IN (SELECT driver_holdout_split FROM holdout)", HOLDOUT)
def u3_missing_splits(spark, d):
    s = splits.driver_holdout(sessions(spark, d))
    required = spark.createDataFrame([(x,) for x in (*splits.SPLITS, "final")], "split string")
    return sets.missing(required, s.select(F.col("driver_holdout_split").alias("split")))


@query("SELECT DISTINCT least(user_id, event_id % 100) AS a, greatest(user_id, event_id % 100) AS b FROM events WHERE user_id <> event_id % 100")
def u4_undirected_edges(spark, d):
    return sets.undirected(table(spark, d, "events").select(F.col("user_id").alias("a"), F.pmod("event_id", F.lit(100)).alias("b")))


# --- splits and checks


@query("SELECT driver_id, session_key, driver_holdout_split FROM holdout", HOLDOUT)
def d1_driver_holdout(spark, d):
    return splits.driver_holdout(sessions(spark, d)).select(*KEYS, "driver_holdout_split")


@query("""SELECT driver_id, session_key, CASE WHEN n = 1 THEN 'train' WHEN n = 2 THEN CASE WHEN r = 1 THEN 'train' ELSE 'test' END WHEN r > n - h THEN 'test' WHEN r > n - 2 * h THEN 'validation' ELSE 'train' END AS drive_holdout_split FROM (
  SELECT *, greatest(1, CAST(round_even(n * 0.15, 0) AS INTEGER)) AS h FROM (
    SELECT driver_id, session_key, count(*) OVER (PARTITION BY driver_id) AS n, row_number() OVER (PARTITION BY driver_id ORDER BY substr(sha256('42:' || driver_id || ':' || session_key), 1, 16), session_key) AS r FROM sessions))""", HOLDOUT)
def d2_drive_holdout(spark, d):
    return splits.drive_holdout(sessions(spark, d)).select(*KEYS, "drive_holdout_split")


BLOCKS = PRELUDE + """, blocks AS (SELECT DISTINCT session_key AS drive_id, row_idx // 10 AS block_id FROM samples)"""


def blocks(spark, d):
    return features.block_layout(samples(spark, d), 10).select(F.col("session_key").alias("drive_id"), "block_id").distinct()


@query("SELECT drive_id, block_id, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY block_id) - 1 AS r, count(*) OVER (PARTITION BY drive_id) AS n FROM blocks)", BLOCKS)
def d3_block_split_chronological(spark, d):
    return splits.block_split(blocks(spark, d), "chronological")


@query("SELECT drive_id, block_id, CASE WHEN r < floor(n * 0.7) THEN 'train' WHEN r < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY substr(sha256('42:' || drive_id || ':' || block_id), 1, 16), drive_id, block_id) - 1 AS r, count(*) OVER () AS n FROM blocks)", BLOCKS)
def d3_block_split_random(spark, d):
    return splits.block_split(blocks(spark, d), "random")


@query("SELECT driver_id, session_key, segment_id, horizon_rows, CAST(eligible_examples AS BIGINT) AS eligible_examples, first_row AS first_eligible_archive_row, last_row AS last_eligible_archive_row FROM eligible", ELIGIBLE)
def d4_training_eligibility(spark, d):
    return splits.training_eligibility(segment_table(spark, d), [2, 8], 5).select(*SEGMENT, "horizon_rows", "eligible_examples", "first_eligible_archive_row", "last_eligible_archive_row")


@query("SELECT driver_id, session_key, segment_id, blackout_seconds, greatest(0, CAST(floor((rows - 5) / blackout_seconds) AS BIGINT)) AS nonoverlapping_episodes FROM segment_table, (SELECT unnest([5, 10]) AS blackout_seconds) b", SEGMENTED)
def d5_blackout_capacity(spark, d):
    return splits.blackout_capacity(segment_table(spark, d), [5, 10], 5, 1).select(*SEGMENT, "blackout_seconds", "nonoverlapping_episodes")


@query("SELECT event_id FROM samples WHERE row_idx % 20 >= 6 AND k IS NOT NULL AND CASE WHEN event_id % 9 <> 0 THEN value END IS NOT NULL", PRELUDE)
def d6_eligible_examples(spark, d):
    s = features.block_layout(samples(spark, d), 20).withColumn("target", F.when(F.pmod("event_id", F.lit(9)) != 0, F.col("value")))
    return splits.eligible_examples(s, 6, ["k", "target"]).select("event_id")


@query("""SELECT e.drive_id, e.local_index, reach FROM laid e, (SELECT unnest(['history', 'target']) AS reach, unnest([5, 2]) AS back) r
LEFT JOIN laid t ON t.drive_id = e.drive_id AND t.local_index = e.local_index - back
WHERE e.local_index % 20 >= 3 AND (t.drive_id IS NULL OR t.block_id <> e.block_id)""", PRELUDE + """, laid AS (SELECT session_key AS drive_id, row_idx AS local_index, row_idx // 20 AS block_id FROM samples)""")
def d7_audit_boundaries(spark, d):
    s = features.block_layout(samples(spark, d), 20).withColumnsRenamed({"session_key": "drive_id", "row_idx": "local_index"})
    laid = s.join(splits.block_split(s.select("drive_id", "block_id").distinct(), "chronological"), ["drive_id", "block_id"])
    return splits.boundary_violations(laid.where("position_in_block >= 3"), laid, 5, 2)


@query("""SELECT 'velocity_jump' AS "check", driver_id || ':' || session_key || ':' || segment_id AS key FROM (SELECT *, abs(speed_kmh - lag(speed_kmh) OVER (PARTITION BY driver_id, session_key, segment_id ORDER BY archive_row)) AS j FROM archived) GROUP BY driver_id, session_key, segment_id HAVING max(j) > 60 + 1e-4
UNION ALL SELECT 'row_count', driver_id || ':' || session_key FROM (SELECT driver_id, session_key, count(*) AS n, count(*) FILTER (WHERE segment_id >= 0) AS m FROM segmented GROUP BY ALL) WHERE n <> m""", SEGMENTED)
def d8_validate_dataset(spark, d):
    a = archived(spark, d).select(*SEGMENT, "archive_row", F.col("row_idx").alias("source_row"), F.col("row_idx").alias("vehicle_source_row"), F.col("t_s").alias("vehicle_t"), F.col("speed_kmh").alias("velocity_kmh"))
    seg = segment_table(spark, d)
    # the manifest counts all rows, so sessions that lost rows are reported, and the jump limit is tighter than the one that cut the segments
    s = splits.driver_holdout(sessions(spark, d)).select(*KEYS, F.col("paired_rows").alias("kept_rows"), F.lit(0).alias("offset_rows"), "driver_holdout_split")
    return validate.validate_dataset(a, s, seg, splits.training_eligibility(seg, [2, 8], 5), KEYS, MAX_GAP, 60.0)


@query(f"SELECT CASE WHEN count(*) = 0 THEN 'passed' ELSE 'failed' END AS status, count(*) AS failures FROM (SELECT *, abs(speed_kmh - lag(speed_kmh) OVER (PARTITION BY driver_id, session_key, segment_id ORDER BY archive_row)) AS j FROM archived) WHERE j > {MAX_JUMP} + 1e-4", SEGMENTED)
def d8_validation_status(spark, d):
    a = archived(spark, d).select(*SEGMENT, "archive_row", F.col("row_idx").alias("source_row"), F.col("row_idx").alias("vehicle_source_row"), F.col("t_s").alias("vehicle_t"), F.col("speed_kmh").alias("velocity_kmh"))
    seg = segment_table(spark, d)
    kept = a.groupBy(*KEYS).agg(F.count("*").alias("kept_rows"))
    s = splits.driver_holdout(sessions(spark, d)).join(kept, KEYS).select(*KEYS, "kept_rows", F.lit(0).alias("offset_rows"), "driver_holdout_split")
    return validate.validation_status(validate.validate_dataset(a, s, seg, splits.training_eligibility(seg, [2, 8], 5), KEYS, MAX_GAP, MAX_JUMP))


@query("SELECT driver_id, session_key, 'strong' AS quality FROM audit WHERE quality = 'strong' AND driver_id IN ('A', 'B')", AUDIT)
def p5_select_sessions(spark, d):
    m = lenient_audit(spark, d).withColumn("training_eligible", F.col("quality") == "strong")
    return splits.select_sessions(m, {"A": "train", "B": "test"}).select(*KEYS, "quality")


# --- alignment


@query("SELECT driver_id, session_key, lag, " + ", ".join(f"round({c}, 4) AS {c}" for c in LAG_COLUMNS) + " FROM sweep", LAGS)
def l1_lag_sweep(spark, d):
    return rounded(sweep(spark, d), *LAG_COLUMNS, places=4)


@query("SELECT driver_id, session_key, lag, " + ", ".join(f"round({c}, 4) AS {c}" for c in LAG_COLUMNS) + " FROM sweep", LAGS)
def l1_lag_sweep_exact(spark, d):
    return rounded(align.lag_sweep_exact(samples(spark, d), vehicle(spark, d), KEYS, 50), *LAG_COLUMNS, places=4)


LONG_LAGS = PRELUDE + f""", behind AS (
  SELECT session_key, row_idx, lag(speed_kmh, 2) OVER (PARTITION BY session_key ORDER BY row_idx) AS velocity_kmh, lat + 0.0003 AS vehicle_lat, lon AS vehicle_lon FROM long_samples
), lagged AS (
  SELECT p.driver_id, p.session_key, lag, p.speed_kmh AS x, v.velocity_kmh AS y, {SEPARATION.replace('hav', '(sin(radians(v.vehicle_lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(v.vehicle_lat)) * sin(radians(v.vehicle_lon - p.lon) / 2) ** 2)')} AS sep
  FROM long_samples p, (SELECT CAST(unnest(range(-10, 11)) AS INTEGER) AS lag) l JOIN behind v ON v.session_key = p.session_key AND v.row_idx = p.row_idx + lag
)"""


@query(f"""SELECT driver_id, session_key, lag, round({corr_sql("x", "y", 20)}, 4) AS speed_corr, round(quantile_cont(sep, 0.5), 4) AS median_separation, round(quantile_cont(sep, 0.95), 4) AS p95_separation FROM lagged GROUP BY ALL""", LONG_LAGS)
def l1_lag_sweep_blocks(spark, d):
    """The sweep of long sessions (one for each event type) in blocks that share no task. Their rows are numbered once and written."""
    s = written_once(long_samples(spark, d).select(*KEYS, "row_idx", "speed_kmh", "lat", "lon"), "long")
    velocity = F.lag("speed_kmh", 2).over(W.partitionBy("session_key").orderBy("row_idx"))
    behind = s.select(*KEYS, "row_idx", velocity.alias("velocity_kmh"), (F.col("lat") + 0.0003).alias("vehicle_lat"), F.col("lon").alias("vehicle_lon"))
    return rounded(align.lag_sweep(s, behind, KEYS, 10, block=500), *LAG_COLUMNS, places=4)


@query("""SELECT driver_id, session_key, best_lag, CASE WHEN zero_corr >= 0.8 AND zero_separation <= 100 THEN 'verified_row_alignment' WHEN best_corr >= 0.8 AND gain >= 0.05 THEN 'lag_candidate_manual_review' WHEN zero_corr >= 0.8 THEN 'strong_speed_manual_review' ELSE 'review' END AS quality FROM best""", LAGS)
def l2_verify_pairs(spark, d):
    return align.verify_pairs(sweep(spark, d), KEYS).select(*KEYS, "best_lag", "quality")


PROFILE = PRELUDE + """, valid AS (
  SELECT session_key, row_number() OVER w AS i, count(*) OVER p AS n, (x - avg(x) OVER p) / stddev_pop(x) OVER p AS zx, (y - avg(y) OVER p) / stddev_pop(y) OVER p AS zy
  FROM (SELECT session_key, row_idx, speed_kmh AS x, lag(speed_kmh, 3) OVER (PARTITION BY session_key ORDER BY row_idx) AS y FROM long_samples) WHERE x IS NOT NULL AND y IS NOT NULL
  WINDOW w AS (PARTITION BY session_key ORDER BY row_idx), p AS (PARTITION BY session_key)
)"""


def delayed(spark, d):
    s = long_samples(spark, d)
    return s.withColumn("target", F.lag("speed_kmh", 3).over(W.partitionBy("session_key").orderBy("row_idx"))).withColumn("row_idx", F.col("row_idx").cast("long"))


@query("SELECT a.session_key, CAST(a.i - b.i AS INTEGER) AS lag, round(sum(a.zx * b.zy) / max(a.n), 6) AS corr FROM valid a JOIN valid b ON a.session_key = b.session_key AND b.i BETWEEN a.i - 100 AND a.i + 100 GROUP BY ALL", PROFILE)
def l3_lag_profile(spark, d):
    p = align.lag_profile(delayed(spark, d), ["session_key"], ["speed_kmh"], "target", 100, 100)
    return rounded(p.select("session_key", "lag", "corr"), "corr")


@query("SELECT a.session_key, CAST(a.i - b.i AS INTEGER) AS lag, round(sum(a.zx * b.zy) / max(a.n), 6) AS corr FROM valid a JOIN valid b ON a.session_key = b.session_key AND b.i BETWEEN a.i - 6 AND a.i + 6 GROUP BY ALL", PROFILE)
def l3_lag_profile_exact(spark, d):
    return rounded(align.lag_profile_exact(delayed(spark, d), ["session_key"], "speed_kmh", "target", 6, 100), "corr")


#: Sessions whose names have an odd number of letters lag by 1 to 5 rows; the others turn at random.
LAGGED = "1 + length(session_key) % 5"


@query(f"""SELECT session_key, CASE WHEN length(session_key) % 2 = 1 THEN 'high' ELSE 'insufficient' END AS tier, CAST(CASE WHEN length(session_key) % 2 = 1 THEN {LAGGED} ELSE 0 END AS INTEGER) AS vehicle_offset FROM valid GROUP BY 1""", PROFILE)
def l4_recover_alignment(spark, d):
    s = long_samples(spark, d).withColumns({"row_idx": F.col("row_idx").cast("long"), "behind": F.expr(LAGGED)})
    w = W.partitionBy("session_key").orderBy("row_idx")
    s = s.withColumn("target", F.coalesce(*[F.when(F.col("behind") == n, F.lag("speed_kmh", n).over(w)) for n in range(1, 6)]))
    s = s.withColumn("turn", F.when(F.length("session_key") % 2 == 1, -F.col("speed_kmh")).otherwise(F.pmod(F.xxhash64("event_id"), F.lit(1000)).cast("double")))
    acc = align.lag_profile(s, ["session_key"], ["k", "speed_kmh"], "target", 20, 100)
    yaw = align.lag_profile(s, ["session_key"], ["turn", "k"], "target", 20, 100)
    return align.recover_alignment(acc, yaw, ["session_key"], 20).select("session_key", "tier", "vehicle_offset")
