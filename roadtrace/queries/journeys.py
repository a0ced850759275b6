"""Episodes, rollouts, dead reckoning, roads, sources and device streams over the telemetry views."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo, signals
from roadtrace.operators import aggregates, episodes, features, joins, ranking, reckon, roads, rollout, scoring, tables, validate
from roadtrace.queries.registry import query
from roadtrace.queries.sessions import segment_table
from roadtrace.queries.views import AXES, KEYS, PRELUDE, SEGMENT, fixes, imu, imu_vec, long_samples, samples, table
from roadtrace.queries.windows import SEGMENTED, archived, motion, rounded
from roadtrace.session import shared_base
from roadtrace.sources import recordings, sinks
from roadtrace.streaming import devices

HISTORY, HORIZON, DURATIONS = 5, 2, [4, 10]
EPISODE = [*SEGMENT, "duration", "start"]

EPISODES = SEGMENTED + f""", episodes AS (
  SELECT driver_id, session_key, segment_id, duration, CAST(unnest(range({HISTORY}, rows - duration, duration)) AS BIGINT) AS start
  FROM segment_table, (SELECT unnest({DURATIONS}) AS duration) d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY driver_id, session_key, segment_id ORDER BY row_idx) - 1 AS position FROM archived
), steps AS (
  SELECT e.driver_id, e.session_key, e.segment_id, e.duration, e.start, CAST((p.position - e.start) / {HORIZON} AS INTEGER) AS step, p.speed_kmh / 3.6 AS true_speed, p.t_s,
         p.t_s - first_value(p.t_s) OVER (PARTITION BY e.driver_id, e.session_key, e.segment_id, e.duration, e.start ORDER BY p.position) AS elapsed, (p.k - 50) / 10 AS delta, p.k / 100 AS confidence
  FROM episodes e JOIN placed p USING (driver_id, session_key, segment_id) WHERE p.position BETWEEN e.start AND e.start + e.duration AND (p.position - e.start) % {HORIZON} = 0
), held AS (
  SELECT *, first_value(true_speed) OVER (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step) AS predicted FROM steps
)
"""


def scored_sql(name, source):
    p = "PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step"
    return f""", {name} AS (
  SELECT *, predicted_distance_m - true_distance_m AS distance_error_m, CASE WHEN true_distance_m >= 1 THEN 100 * abs(predicted_distance_m - true_distance_m) / true_distance_m END AS drift_percent FROM (
    SELECT driver_id, session_key, segment_id, duration, start, avg(abs(e)) FILTER (WHERE step > 0) AS velocity_mae_kmh, sqrt(avg(e * e) FILTER (WHERE step > 0)) AS velocity_rmse_kmh, max_by(e, step) AS final_velocity_error_kmh,
           100 * avg((abs(e) <= 5)::INT) FILTER (WHERE step > 0) AS within_5_kmh_percent, sum(pd) AS predicted_distance_m, sum(td) AS true_distance_m
    FROM (SELECT *, (predicted - true_speed) * 3.6 AS e, (predicted + lag(predicted) OVER w) / 2 * (elapsed - lag(elapsed) OVER w) AS pd, (true_speed + lag(true_speed) OVER w) / 2 * (elapsed - lag(elapsed) OVER w) AS td
          FROM {source} WINDOW w AS ({p})) GROUP BY ALL)
)
"""


SCORED = EPISODES + scored_sql("scored", "held")


def placed(spark, d):
    return archived(spark, d).withColumn("position", F.row_number().over(W.partitionBy(*SEGMENT).orderBy("row_idx")) - 1)


def steps(spark, d) -> DataFrame:
    e = episodes.time_blackouts(segment_table(spark, d), DURATIONS, HISTORY, 1).select(*EPISODE, "end")
    s = placed(spark, d).select(*SEGMENT, F.col("position").cast("long").alias("position"), (F.col("speed_kmh") / 3.6).alias("true_speed"), "t_s", ((F.col("k") - 50) / 10).alias("delta"), (F.col("k") / 100).alias("confidence"))
    out = joins.endpoints(e, s, SEGMENT, HORIZON, ["true_speed", "t_s", "delta", "confidence"])
    w = W.partitionBy(*EPISODE).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("elapsed", F.col("t_s") - F.first("t_s").over(w))


SCORES = ("velocity_mae_kmh", "velocity_rmse_kmh", "final_velocity_error_kmh", "within_5_kmh_percent", "predicted_distance_m", "true_distance_m", "distance_error_m", "drift_percent")


def hold_scores(spark, d):
    return rollout.score_episodes(rollout.hold_last(steps(spark, d), EPISODE, "true_speed"), EPISODE)


@query("SELECT driver_id, session_key, segment_id, duration, start, start + duration AS \"end\" FROM episodes", EPISODES)
def e1_time_blackouts(spark, d):
    return episodes.time_blackouts(segment_table(spark, d), DURATIONS, HISTORY, 1).select(*EPISODE, "end")


@query("SELECT driver_id, session_key, segment_id, duration, CAST(unnest(range(5, rows - duration + 1, 3)) AS BIGINT) AS start FROM segment_table, (SELECT unnest([4, 10]) AS duration) d", SEGMENTED)
def e2_strided_examples(spark, d):
    return episodes.strided_examples(segment_table(spark, d), DURATIONS, 3, 2, 3, 1).select(*EPISODE)


@query("SELECT driver_id, session_key, segment_id, duration, start, step, round(true_speed, 6) AS true_speed, round(elapsed, 3) AS elapsed FROM steps", EPISODES)
def j12_episode_truth(spark, d):
    return rounded(steps(spark, d).select(*EPISODE, "step", "true_speed", F.round("elapsed", 3).alias("elapsed")), "true_speed")


SCAN = PRELUDE.replace("WITH telemetry", "WITH RECURSIVE telemetry") + """, drive AS (
  SELECT session_key, row_idx, v, sum(v / 10) OVER w AS cum, min(v) OVER (PARTITION BY session_key ORDER BY row_idx ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (PARTITION BY session_key) AS n
  FROM (SELECT session_key, row_idx, speed_kmh / 3.6 AS v FROM long_samples) WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT a.session_key, dist, a.row_idx AS s, min(b.row_idx) AS e FROM drive a, (SELECT unnest([50, 200])::DOUBLE AS dist) x JOIN drive b ON b.session_key = a.session_key AND b.row_idx BETWEEN a.row_idx AND a.row_idx + 800 AND b.cum >= a.cum + dist GROUP BY ALL
), judged AS (
  SELECT a.session_key, x.dist, a.row_idx AS s, e.e, coalesce(e.e < a.n AND e.e - a.row_idx >= 5 AND (p.cum - a.cum + a.v / 10) * 10 / (e.e - a.row_idx) >= 3 AND a.before >= 0, false) AS ok
  FROM drive a, (SELECT unnest([50, 200])::DOUBLE AS dist) x LEFT JOIN ends e ON e.session_key = a.session_key AND e.dist = x.dist AND e.s = a.row_idx LEFT JOIN drive p ON p.session_key = a.session_key AND p.row_idx = e.e - 1 WHERE a.row_idx < a.n - 5
), scan AS (
  SELECT session_key, dist, s, e, ok FROM judged WHERE s = 25
  UNION ALL
  SELECT j.session_key, j.dist, j.s, j.e, j.ok FROM scan c JOIN judged j ON j.session_key = c.session_key AND j.dist = c.dist AND j.s = CASE WHEN c.ok THEN c.e ELSE c.s + 50 END
)
"""


@query("SELECT 'L' AS driver_id, session_key, dist AS distance_m, s AS start, e AS \"end\" FROM scan WHERE ok", SCAN)
def e3_distance_blackouts(spark, d):
    s = long_samples(spark, d).withColumn("v", F.col("speed_kmh") / 3.6)
    return episodes.distance_blackouts(s, KEYS, "v", [50.0, 200.0], 25, 10.0, 3.0, 5.0, min_history=0.0)


STRAIGHT = PRELUDE.replace("WITH telemetry", "WITH RECURSIVE telemetry") + """, drive AS (
  SELECT session_key, row_idx, v, n, sum(v / 10) OVER w AS cum, lag(v) OVER (PARTITION BY session_key ORDER BY row_idx) AS before, sum(coalesce(abs(d - 2 * pi() * floor((d + pi()) / (2 * pi()))), 0)) OVER w AS turn
  FROM (SELECT session_key, row_idx, speed_kmh / 3.6 AS v, count(*) OVER (PARTITION BY session_key) AS n, radians(heading_deg) - lag(radians(heading_deg)) OVER (PARTITION BY session_key ORDER BY row_idx) AS d FROM long_samples)
  WINDOW w AS (PARTITION BY session_key ORDER BY row_idx ROWS UNBOUNDED PRECEDING)
), ends AS (
  SELECT a.session_key, a.row_idx AS s, min(b.row_idx) AS e FROM drive a JOIN drive b ON b.session_key = a.session_key AND b.row_idx BETWEEN a.row_idx AND a.row_idx + 1400 AND b.cum >= a.cum + 200 GROUP BY ALL
), judged AS (
  SELECT a.session_key, a.row_idx AS s, e.e, p.turn - a.turn AS turning, coalesce(e.e < a.n AND e.e - a.row_idx >= 5 AND (p.cum - a.cum + a.v / 10) * 10 / (e.e - a.row_idx) >= 3 AND a.before >= 1, false) AS ok
  FROM drive a LEFT JOIN ends e ON e.session_key = a.session_key AND e.s = a.row_idx LEFT JOIN drive p ON p.session_key = a.session_key AND p.row_idx = e.e - 1 WHERE a.row_idx < a.n - 5
), scan AS (
  SELECT session_key, s, e, ok, turning FROM judged WHERE s = 1
  UNION ALL
  SELECT j.session_key, j.s, j.e, j.ok, j.turning FROM scan c JOIN judged j ON j.session_key = c.session_key AND j.s = c.s + CASE WHEN c.ok THEN 20 ELSE 30 END
)
"""


@query("""SELECT 'L' AS driver_id, session_key, x.s AS start, x.e AS "end", round(x.turning, 6) AS turning FROM (SELECT session_key, min({'turning': round(turning, 9), 's': s, 'e': e}) AS x FROM scan WHERE ok GROUP BY 1)""", STRAIGHT)
def e4_straightest_segment(spark, d):
    s = long_samples(spark, d).withColumns({"v": F.col("speed_kmh") / 3.6, "h": F.radians("heading_deg")})
    return rounded(episodes.straightest_segment(features.cumulative_turn(s, KEYS, "h", "turn"), KEYS, "v", "turn", 200.0, 1), "turning")


@query("""SELECT driver_id, session_key, segment_id, duration, start, step, round(v, 6) AS predicted FROM rolled""", EPISODES.replace("WITH telemetry", "WITH RECURSIVE telemetry") + """, rolled AS (
  SELECT driver_id, session_key, segment_id, duration, start, step, true_speed AS v FROM steps WHERE step = 0
  UNION ALL
  SELECT s.driver_id, s.session_key, s.segment_id, s.duration, s.start, s.step, greatest(0, r.v + s.delta) FROM rolled r JOIN steps s ON s.driver_id = r.driver_id AND s.session_key = r.session_key AND s.segment_id = r.segment_id AND s.duration = r.duration AND s.start = r.start AND s.step = r.step + 1
)""")
def e5_rollout_delta_v(spark, d):
    return rounded(rollout.clamped_rollout(steps(spark, d), EPISODE, "true_speed", "delta").select(*EPISODE, "step", "predicted"), "predicted")


@query("SELECT driver_id, session_key, segment_id, duration, start, step, round(predicted, 6) AS predicted FROM held", EPISODES)
def e6_hold_last_speed(spark, d):
    return rounded(rollout.hold_last(steps(spark, d), EPISODE, "true_speed").select(*EPISODE, "step", "predicted"), "predicted")


@query("SELECT driver_id, session_key, segment_id, duration, start, " + ", ".join(f"round({c}, {1 if c.endswith('_m') else 4}) AS {c}" for c in SCORES) + " FROM scored", SCORED)
def e7_score_episode(spark, d):
    metres = [c for c in SCORES if c.endswith("_m")]
    return rounded(rounded(hold_scores(spark, d).select(*EPISODE, *SCORES), *metres, places=1), *[c for c in SCORES if c not in metres], places=4)


@query("""SELECT driver_id, session_key, segment_id, duration, start, round(sum(true_speed * 0.1) , 6) AS true_distance_m, round(sum(predicted * 0.1), 6) AS predicted_distance_m, round(100 * abs(sum(predicted * 0.1) - sum(true_speed * 0.1)) / greatest(sum(true_speed * 0.1), 1), 6) AS drift_percent FROM held GROUP BY ALL""", EPISODES)
def e7_score_episode_sum(spark, d):
    s = rollout.score_episodes(rollout.hold_last(steps(spark, d), EPISODE, "true_speed"), EPISODE, distance="sum", denominator="at_least_1")
    return rounded(s.select(*EPISODE, "true_distance_m", "predicted_distance_m", "drift_percent"), "true_distance_m", "predicted_distance_m", "drift_percent")


@query("""SELECT driver_id, session_key, segment_id, duration, start, step, threshold, round(s - least(0, min(s) OVER (PARTITION BY driver_id, session_key, segment_id, duration, start, threshold ORDER BY step)), 6) AS predicted FROM (
  SELECT *, first_value(true_speed) OVER w + sum(CASE WHEN step = 0 OR confidence < threshold THEN 0 ELSE least(3, greatest(-3, delta * 0.5)) END) OVER w AS s FROM steps, (SELECT unnest([0.2, 0.6])::DOUBLE AS threshold) t
  WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start, threshold ORDER BY step ROWS UNBOUNDED PRECEDING))""", EPISODES)
def e8_gated_rollout(spark, d):
    grid = joins.with_grid(steps(spark, d), [{"threshold": t, "shrinkage": 0.5} for t in (0.2, 0.6)])
    out = rollout.gated_rollout(grid, [*EPISODE, "threshold"], "true_speed", "delta", "confidence")
    return rounded(out.select(*EPISODE, "step", "threshold", "predicted"), "predicted")


@query("""SELECT driver_id, session_key, segment_id, duration, start, step, round(speed, 6) AS speed, round(heading, 6) AS heading, round(sum(speed * sin(heading) * 0.1) OVER w, 5) AS east, round(sum(speed * 0.1) OVER w, 6) AS distance FROM (
  SELECT *, greatest(0, first_value(true_speed) OVER w + sum(delta * 0.1) OVER w) AS speed, first_value(confidence) OVER w + sum(confidence * 0.1) OVER w AS heading FROM steps
  WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step ROWS UNBOUNDED PRECEDING)""", EPISODES)
def e9_unrolled_integration(spark, d):
    out = rollout.unrolled_integration(steps(spark, d), EPISODE, "true_speed", "confidence", "delta", "confidence")
    return rounded(rounded(out.select(*EPISODE, "step", "speed", "heading", "east", "distance"), "speed", "heading", "distance"), "east", places=5)


def control_samples(spark, d):
    s = steps(spark, d).withColumns({"acceleration": F.col("delta"), "calibrated": F.col("delta") / 10, "gyro": F.col("confidence") / 20, "yaw": F.col("confidence") / 10})
    w = W.partitionBy(*EPISODE).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumns({"v0": F.first("true_speed").over(w), "h0": F.first("confidence").over(w)})
    return s.withColumns({"true_east": F.sum(F.col("true_speed") * F.sin("confidence") * 0.1).over(w), "true_north": F.sum(F.col("true_speed") * F.cos("confidence") * 0.1).over(w)})


@query("""SELECT avg(part) AS score_check, CAST(sum(n) AS BIGINT) AS samples FROM (
  SELECT duration, sum(a) / sum(n) / 10 + sum(abs(pd - td)) / greatest(sum(td), 1) AS part, sum(n) AS n FROM (
    SELECT duration, sum(abs(predicted - true_speed)) * 3.6 AS a, count(*) AS n, sum(predicted) * 0.1 AS pd, sum(true_speed) * 0.1 AS td FROM held GROUP BY driver_id, session_key, segment_id, duration, start) GROUP BY duration)""".replace("avg(part)", "round(avg(part), 6)"), EPISODES)
def e10_drift_controls_hold(spark, d):
    # a gain of 0 is the hold baseline, whose score SQL can give
    out = rollout.control_search(control_samples(spark, d), EPISODE, rollout.speed_grid()[:1])
    return out.select(F.round("score", 6).alias("score_check"), "samples")


@query(None)
def e11_control_search(spark, d):
    grid = rollout.speed_grid()
    episodes_ = control_samples(spark, d).persist()
    found = rollout.control_search(episodes_, EPISODE, grid)
    best = spark.createDataFrame(found.collect(), found.schema)  # one row for each setting
    chosen = grid[ranking.select_parameters(best, ["setting"], "score").head()["setting"]]
    yaw = rollout.yaw_search(episodes_, EPISODE, chosen)
    yaw = spark.createDataFrame(yaw.collect(), yaw.schema)
    episodes_.unpersist()
    return best.select(F.lit("speed").alias("search"), "setting", "score").unionByName(yaw.select(F.lit("yaw").alias("search"), "setting", "score"))


def drives(spark, d):
    """IMU windows as drives: nine channels, a speed, a course and an azimuth."""
    v = imu_vec(spark, d)
    return v.withColumns({"speed": 10 + F.col("acc_x"), "course_deg": F.col("row_idx") * 3.0, "az_deg": F.col("row_idx") * 3.0 - 20})


def mounted(spark, d, closed_form: bool = False):
    """All sessions as 10 Hz drives whose phone is mounted in a known way: forward axis, biases, yaw sign and compass offset follow from user_id.

    The horizontal plane's axes are y and -x, as the library takes them for an upright
    phone. The ``closed_form`` has no bias: it would turn its axis.
    """
    w = W.partitionBy(*KEYS).orderBy("row_idx")
    rate = lambda c: F.coalesce((F.lead(c).over(w) - F.lag(c).over(w)) / 2, F.lead(c).over(w) - F.col(c), F.col(c) - F.lag(c).over(w)) * reckon.RATE
    s = samples(spark, d).withColumns({"t": F.col("row_idx") * 0.1, "speed": F.col("speed_kmh") / 3.6, "course_deg": 2.0 * F.col("row_idx") + F.col("k") / 20})
    s = s.withColumns({"rate": rate("speed"), "turning": F.radians(rate("course_deg")), "angle": F.radians(2.0 * (F.col("user_id") % 180)), "sign": F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(-1.0)})
    push, side = F.col("rate") + (0.0 if closed_form else (F.col("user_id") % 7 - 3) / 10), -F.col("speed") * F.col("turning")
    turned = -1.0 if closed_form else 1.0  # the two calibrations count the angle in opposite senses
    h1 = push * F.cos("angle") - turned * side * F.sin("angle")
    h2 = turned * push * F.sin("angle") + side * F.cos("angle")
    zero = {c: F.lit(0.0) for c in reckon.CHANNELS}
    return s.withColumns(zero | {"acc_x": -h2, "acc_y": h1, "acc_z": F.lit(9.81), "gravity_z": F.lit(9.81), "gyro_z": F.col("sign") * (F.col("turning") + (F.col("user_id") % 5) / 100), "az_deg": F.col("course_deg") - 20 - F.col("user_id") % 10})


MOUNTED = "CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS yaw_sign, round((user_id % 5) / 100.0, 5)::DOUBLE AS yaw_bias, round(radians(20 + user_id % 10), 5) AS az_offset"


@query(f"SELECT session_key, round(-sin(radians(2 * (user_id % 180))), 4) + 0.0 AS forward_x, round(cos(radians(2 * (user_id % 180))), 4) + 0.0 AS forward_y, round((user_id % 7 - 3) / 10.0, 4)::DOUBLE AS accel_bias, {MOUNTED} FROM samples GROUP BY session_key, user_id HAVING count(*) >= 3", PRELUDE)
def e12_calibrate(spark, d):
    """The mounting of every session's phone, found again from its samples."""
    m = mounted(spark, d)
    found = reckon.calibrate(m.select("*", F.count("*").over(W.partitionBy(*KEYS)).alias("rows")).where("rows >= 3"), KEYS)
    out = found.select("session_key", *[(F.round(c, p) + 0.0).alias(n) for n, c, p in (("forward_x", F.col("forward")[0], 4), ("forward_y", F.col("forward")[1], 4), ("accel_bias", F.col("accel_bias"), 4))], "yaw_sign", "yaw_bias", "az_offset")
    return rounded(out, "yaw_bias", "az_offset", places=5)


@query(f"SELECT session_key, round(sin(radians(2 * (user_id % 180))), 4) + 0.0 AS forward_x, round(cos(radians(2 * (user_id % 180))), 4) + 0.0 AS forward_y, 1.0::DOUBLE AS fit, {MOUNTED}, 1.0::DOUBLE AS compass_r FROM samples GROUP BY session_key, user_id HAVING count(*) >= 6", PRELUDE)
def e13_calibrate_procrustes(spark, d):
    """The same by the closed form."""
    found = reckon.calibrate_procrustes(mounted(spark, d, True), KEYS, "t", 0.45, 0.3)
    out = found.select("session_key", (F.round(F.col("forward")[0], 4) + 0.0).alias("forward_x"), (F.round(F.col("forward")[1], 4) + 0.0).alias("forward_y"), F.round("fit", 5).alias("fit"), "yaw_sign", "yaw_bias", "az_offset", F.round("compass_r", 5).alias("compass_r"))
    return rounded(out, "yaw_bias", "az_offset", places=5)


@query("""SELECT driver_id, session_key, segment_id, duration, start, step, round(sum(CASE WHEN step > 0 THEN v0 * sin(h) / 10 ELSE 0 END) OVER w, 5) AS east_est, round(sum(CASE WHEN step > 0 THEN v0 * cos(h) / 10 ELSE 0 END) OVER w, 5) AS north_est FROM (
  SELECT *, first_value(true_speed) OVER w AS v0, first_value(confidence) OVER w + sum(CASE WHEN step > 0 THEN delta / 10 ELSE 0 END) OVER w AS h FROM steps WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step ROWS UNBOUNDED PRECEDING))
WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step ROWS UNBOUNDED PRECEDING)""", EPISODES)
def e14_dead_reckon_windows(spark, d):
    out = reckon.dead_reckon_windows(steps(spark, d), EPISODE, "const", "gyro", "true_speed", "confidence", "delta")
    return rounded(out.select(*EPISODE, "step", "east_est", "north_est"), "east_est", "north_est", places=5)


@query(None)
def e14_dead_reckon_fused(spark, d):
    s = drives(spark, d)
    cal = reckon.calibrate(s.where("row_idx < 25"), KEYS)
    dark = s.where("row_idx >= 25").withColumns({"step": F.col("row_idx") - 25, "gt_e": F.col("row_idx").cast("double"), "gt_n": F.lit(0.0)})
    return reckon.dead_reckon(dark, cal, KEYS, "ins", "fused")


@query("""SELECT duration, count(*) AS blackouts, round(quantile_cont(dr, 0.5), 3) AS median_drift, round(min(dr), 3) AS min_drift, round(100 * avg((dr < 10)::INT), 6) AS under_limit_percent FROM (
  SELECT duration, 100 * max_by(sqrt((e - ge) ** 2), step) / greatest(sum(true_speed) / 10, 1e-6) AS dr FROM (
    SELECT *, sum(CASE WHEN step > 0 THEN v0 / 10 ELSE 0 END) OVER w AS e, sum(CASE WHEN step > 0 THEN true_speed / 10 ELSE 0 END) OVER w AS ge FROM (SELECT *, first_value(true_speed) OVER w AS v0 FROM steps WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step))
    WINDOW w AS (PARTITION BY driver_id, session_key, segment_id, duration, start ORDER BY step ROWS UNBOUNDED PRECEDING))
  GROUP BY driver_id, session_key, segment_id, duration, start) GROUP BY duration""", EPISODES)
def e15_drift_curve(spark, d):
    s = steps(spark, d).withColumns({"north0": F.lit(0.0), "east0": F.lit(math.pi / 2)})
    r = reckon.dead_reckon_windows(s, EPISODE, "const", "hold", "true_speed", "east0")
    w = W.partitionBy(*EPISODE).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumns({"gt_e": F.sum(F.when(F.col("step") > 0, F.col("true_speed") / 10).otherwise(0.0)).over(w), "gt_n": F.col("north_est"), "speed": F.col("true_speed")})
    out = reckon.drift_curve(reckon.drift_stats(r, EPISODE), ["duration"])
    return rounded(rounded(out, "median_drift", "min_drift", places=3), "under_limit_percent")


@query("""SELECT session_key, round((sxy / (sxx + 100)), 6) AS b0, round(my - (sxy / (sxx + 100)) * mx, 6) AS intercept FROM (
  SELECT session_key, sum((m - mm) * (dv - md)) AS sxy, sum((m - mm) ** 2) AS sxx, max(mm) AS mx, max(md) AS my FROM (
    SELECT *, avg(m) OVER p AS mm, avg(dv) OVER p AS md FROM (SELECT session_key, m, dv FROM (SELECT session_key, CASE WHEN count(*) OVER r = 5 THEN avg(linear_x) OVER r END AS m, acc_z - lag(acc_z, 2) OVER w AS dv FROM motion WINDOW w AS (PARTITION BY session_key ORDER BY row_idx), r AS (PARTITION BY session_key ORDER BY row_idx ROWS 4 PRECEDING)) WHERE m IS NOT NULL AND dv IS NOT NULL)
    WINDOW p AS (PARTITION BY session_key)) GROUP BY 1)""", PRELUDE)
def e16_causal_ridge_fit(spark, d):
    m = features.rolling_features(motion(spark, d), KEYS, ["linear_x"], (5,)).withColumn("dv", features.delta_target("acc_z", KEYS, 2))
    fit = rollout.ridge_from_moments(m, ["session_key"], ["linear_x_mean_5"], "dv", 100.0)
    return fit.select("session_key", F.round(F.col("coef")[0], 6).alias("b0"), F.round("intercept", 6).alias("intercept"))


@query(None)
def e16_causal_ridge_calibration(spark, d):
    """Fit per session on its first half, roll through the rest, against holding the last speed."""
    m = features.rolling_features(motion(spark, d), KEYS, ["linear_x", "gyro_norm"], (5,)).withColumns({"v": 10 + F.col("acc_z")})
    m = m.withColumn("dv", features.delta_target("v", KEYS, 1)).withColumn("half", F.floor(F.count("*").over(W.partitionBy(*KEYS)) / 2))
    fit = rollout.ridge_from_moments(m.where("row_idx <= half"), KEYS, ["linear_x_mean_5", "gyro_norm_mean_5"], "dv", 100.0)
    late = m.where("row_idx >= half").join(fit, KEYS).withColumns({"step": F.col("row_idx") - F.col("half"), "true_speed": F.col("v"), "elapsed": (F.col("row_idx") - F.col("half")) * 0.1})
    late = late.withColumn("delta", F.col("intercept") + F.col("coef")[0] * F.col("linear_x_mean_5") + F.col("coef")[1] * F.col("gyro_norm_mean_5"))
    both = rollout.clamped_rollout(late, KEYS, "v", "delta").withColumn("model", F.lit("causal_ridge")).unionByName(rollout.hold_last(late, KEYS, "v").withColumn("model", F.lit("hold_last_speed")))
    return aggregates.summarize_episode_means(rollout.score_episodes(both, [*KEYS, "model"]), ["model"])


@query("""SELECT session_key, row_idx, CASE WHEN n >= 2 THEN round(least(4, greatest(-4, my + (linear_x - mx) / sd * (sxy / (sxx + 1)))) / 4, 5) ELSE 0 END AS projection FROM motion JOIN (
  SELECT session_key, max(n) AS n, max(mx) AS mx, max(sd) AS sd, max(my) AS my, sum(((m - mx) / sd) * (dv - my)) AS sxy, sum(((m - mx) / sd) ** 2) AS sxx FROM (
    SELECT *, count(dv) OVER p AS n, avg(m) OVER p AS mx, stddev_pop(m) OVER p AS sd, avg(dv) OVER p AS my FROM (SELECT session_key, row_idx // 10 AS b, avg(linear_x) AS m, max(acc_z) AS dv FROM motion GROUP BY ALL) WINDOW p AS (PARTITION BY session_key)) GROUP BY 1) USING (session_key)""", PRELUDE)
def e17_calibrated_projection(spark, d):
    m = motion(spark, d)
    blocks = m.groupBy("session_key", F.floor(F.col("row_idx") / 10).alias("b")).agg(F.avg("linear_x").alias("linear_x"), F.max("acc_z").alias("change"))
    out = rollout.calibrated_projection(blocks, m, ["session_key"], ["linear_x"], "change", 4.0, 4.0)
    return rounded(out.select("session_key", "row_idx", "projection"), "projection", places=5)


# --- summaries of episodes

SUMMARY = ("final_abs_error_kmh", "final_bias_kmh", "abs_distance_error_m", "distance_bias_m", "drift_mean_percent", "drift_median_percent", "drift_aggregate_percent", "velocity_mae_kmh", "velocity_rmse_kmh", "within_5_kmh_percent")


@query("""SELECT p.duration, episodes, """ + ", ".join(f"round({c}, 2) AS {c}" for c in SUMMARY) + """ FROM (
  SELECT duration, count(*) AS episodes, avg(abs(final_velocity_error_kmh)) AS final_abs_error_kmh, avg(final_velocity_error_kmh) AS final_bias_kmh, avg(abs(distance_error_m)) AS abs_distance_error_m, avg(distance_error_m) AS distance_bias_m,
         avg(drift_percent) AS drift_mean_percent, quantile_cont(drift_percent, 0.5) AS drift_median_percent, 100 * sum(abs(distance_error_m)) / greatest(sum(true_distance_m), 1) AS drift_aggregate_percent FROM scored GROUP BY 1) p
JOIN (SELECT duration, avg(abs(e)) AS velocity_mae_kmh, sqrt(avg(e * e)) AS velocity_rmse_kmh, 100 * avg((abs(e) <= 5)::INT) AS within_5_kmh_percent FROM (SELECT duration, (predicted - true_speed) * 3.6 AS e FROM held WHERE elapsed > 0) GROUP BY 1) s USING (duration)""", SCORED)
def a12_summarize_blackouts(spark, d):
    """The flagship: how far off a car is when it holds its last speed through simulated blackouts, by their duration."""
    out = aggregates.summarize_blackouts(hold_scores(spark, d), None, ["duration"])
    return rounded(out.select("duration", "episodes", *SUMMARY), *SUMMARY, places=2)


@query("SELECT duration, step * 1.0::DOUBLE AS elapsed_seconds, round(avg(abs(predicted - true_speed) * 3.6), 6) AS mae_kmh, count(*) AS n FROM held WHERE step > 0 GROUP BY ALL", EPISODES)
def a13_error_growth(spark, d):
    s = rollout.hold_last(steps(spark, d), EPISODE, "true_speed").withColumns({"elapsed_seconds": F.col("step").cast("double"), "velocity_error_kmh": (F.col("predicted") - F.col("true_speed")) * 3.6})
    return rounded(aggregates.error_growth(s, ["duration"]), "mae_kmh")


@query("SELECT driver_id, round(avg(abs(d)), 6) AS zero_delta_mae, round(avg(abs(p - d)), 6) AS mae, round(100 * (1 - avg(abs(p - d)) / avg(abs(d))), 6) AS improvement_percent FROM (SELECT driver_id, value - k AS d, value / 2 AS p FROM samples) GROUP BY 1", PRELUDE)
def a11_delta_metrics(spark, d):
    from roadtrace.functions import stats

    out = samples(spark, d).withColumns({"d": F.col("value") - F.col("k"), "p": F.col("value") / 2}).groupBy("driver_id").agg(*stats.delta_metrics("d", "p"))
    return rounded(out.select("driver_id", "zero_delta_mae", "mae", "improvement_percent"), "zero_delta_mae", "mae", "improvement_percent")


@query("SELECT event_id, round(0.5 * k - 0.25 * value + 1, 6) AS prediction FROM samples", PRELUDE)
def f1_delta_model(spark, d):
    out = scoring.predict(samples(spark, d).select("event_id", "k", "value"), ["k", "value"], scoring.linear_model([0.5, -0.25], 1.0))
    return rounded(out.select("event_id", "prediction"), "prediction")


@query("SELECT session_key, round(sum((value + before) / 2 * (t_s - tb)), 2) AS area FROM (SELECT session_key, value, t_s, lag(value) OVER w AS before, lag(t_s) OVER w AS tb FROM samples WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)) GROUP BY 1", PRELUDE)
def f2_trapezoid(spark, d):
    s = samples(spark, d).withColumn("area", rollout.trapezoid("value", "t_s", KEYS, "row_idx"))
    return s.groupBy("session_key").agg(F.round(F.sum("area"), 2).alias("area"))


@query("SELECT driver_id, session_key, segment_id, CAST(unnest(range(5, rows - 6, 6)) AS BIGINT) AS start FROM segment_table", SEGMENTED)
def f3_episode_starts(spark, d):
    return tables.episode_starts(segment_table(spark, d), 5, 6).select(*SEGMENT, "start")


# --- roads: a lattice whose size follows the number of drives

SPACING = 100.0
LATTICE = """
WITH RECURSIVE side AS (SELECT greatest(8, CAST(ceil(sqrt(count(DISTINCT user_id))) AS BIGINT)) AS n FROM events
), grid AS (
  SELECT n, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, x * 1000 + y AS id, x * 100.0::DOUBLE AS e, y * 100.0::DOUBLE AS f FROM side, unnest(range(n)) a(x), unnest(range(n)) b(y)
), edges AS (
  SELECT a.id AS a, b.id AS b, a.e AS ae, a.f AS an, b.e AS be, b.f AS bn, 100.0::DOUBLE AS length FROM grid a JOIN grid b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)
), points AS (
  SELECT event_id, (event_id * 37 % (100 * (n - 1)))::DOUBLE AS e, (event_id * 53 % (100 * (n - 1)))::DOUBLE AS f FROM events, side
), projected AS (
  SELECT p.event_id, p.e, p.f, g.a, g.b, t * 100 AS along, sqrt((p.e - ae - t * (be - ae)) ** 2 + (p.f - an - t * (bn - an)) ** 2) AS distance, ae, an, be, bn FROM points p, edges g,
  LATERAL (SELECT least(1, greatest(0, ((p.e - g.ae) * (g.be - g.ae) + (p.f - g.an) * (g.bn - g.an)) / 10000)) AS t) x
  WHERE g.ae BETWEEN p.e - 260 AND p.e + 260 AND g.an BETWEEN p.f - 260 AND p.f + 260
)
"""


def lattice(spark: SparkSession, d: str) -> DataFrame:
    n = F.greatest(F.lit(8), F.ceil(F.sqrt(F.count_distinct("user_id")))).cast("long")
    g = table(spark, d, "events").agg(n.alias("n")).withColumn("x", F.explode(F.expr("sequence(0L, n - 1)"))).withColumn("y", F.explode(F.expr("sequence(0L, n - 1)")))
    to = F.explode(F.expr("filter(array(struct(x + 1 as x2, y as y2), struct(x as x2, y + 1 as y2)), p -> p.x2 < n and p.y2 < n)"))
    e = g.withColumn("t", to).select("x", "y", "t.x2", "t.y2")
    node = lambda x, y: (F.col(x) * 1000 + F.col(y)).cast("string")
    e = e.select(node("x", "y").alias("a"), node("x2", "y2").alias("b"), *[(F.col(c) * SPACING).alias(n) for c, n in (("x", "ae"), ("y", "an"), ("x2", "be"), ("y2", "bn"))])
    return e.withColumn("length", F.lit(SPACING)).withColumn("edge", F.concat_ws("-", "a", "b"))


def with_streets(spark, d, df):
    """Add the number of streets of the lattice (one number, so one row is broadcast)."""
    return df.crossJoin(F.broadcast(table(spark, d, "events").agg(F.greatest(F.lit(8), F.ceil(F.sqrt(F.count_distinct("user_id")))).cast("long").alias("streets"))))


def road_points(spark, d):
    e = with_streets(spark, d, table(spark, d, "events"))
    return e.select("event_id", *[F.pmod(F.col("event_id") * f, 100 * (F.col("streets") - 1)).cast("double").alias(c) for c, f in (("e", 37), ("n", 53))])


@query("SELECT event_id, a || '-' || b AS edge, round(distance, 6) AS distance, round(along, 6) AS along FROM projected WHERE distance <= 40", LATTICE)
def j7_near_edges(spark, d):
    out = roads.near_edges(road_points(spark, d), lattice(spark, d), ["event_id"], 40.0, 100)
    return rounded(out.select("event_id", "edge", "distance", "along"), "distance", "along")


@query("""SELECT event_id, count(*) AS candidates, round(min(distance), 6) AS nearest FROM (
  SELECT *, min(distance) OVER (PARTITION BY event_id) AS d0 FROM projected) WHERE distance <= CASE WHEN d0 <= 10 THEN 10 WHEN d0 <= 20 THEN 20 WHEN d0 <= 40 THEN 40 ELSE 80 END GROUP BY 1""", LATTICE)
def j8_near_edges_expanding(spark, d):
    out = roads.near_edges_expanding(road_points(spark, d), lattice(spark, d), ["event_id"], 10.0, 80.0, 100)
    return out.groupBy("event_id").agg(F.count("*").alias("candidates"), F.round(F.min("distance"), 6).alias("nearest"))


#: Every session is a way through the places of its rows; four users share their nodes, and a node lies where it appears first.
DRIVEN = PRELUDE + """, ways AS (
  SELECT session_key AS way, row_idx AS seq, (user_id // 4) || '_' || CAST(k AS INTEGER) AS node, lat, lon FROM samples
), placed AS (
  SELECT node, radians(lon + 1.51) * 6371000.0 * cos(radians(51.99)) AS e, radians(lat - 51.99) * 6371000.0 AS n FROM ways
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY way, seq) = 1
), pairs AS (
  SELECT DISTINCT least(node, b) AS a, greatest(node, b) AS b FROM (SELECT node, lead(node) OVER (PARTITION BY way ORDER BY seq) AS b FROM ways) WHERE node <> b
), driven AS (
  SELECT * FROM (SELECT a, b, x.e AS ae, x.n AS an, y.e AS be, y.n AS bn, sqrt((x.e - y.e) ** 2 + (x.n - y.n) ** 2) AS length FROM pairs JOIN placed x ON x.node = a JOIN placed y ON y.node = b) WHERE length > 0
)"""
#: Cells of the driven ways' index; their edges are kilometres long.
WIDE_M = 5000.0


def driven_roads(spark, d):
    """The road graph of all sessions' ways."""
    node = F.concat_ws("_", F.floor(F.col("user_id") / 4).cast("string"), F.col("k").cast("int").cast("string"))
    ways = samples(spark, d).select(F.col("session_key").alias("way"), F.col("row_idx").alias("seq"), node.alias("node"), "lat", "lon")
    return roads.build_road_graph(ways, 51.99, -1.51)[1]


@query("SELECT a, b, round(length, 3) AS length FROM driven", DRIVEN)
def m1_build_road_graph(spark, d):
    return rounded(driven_roads(spark, d).select("a", "b", "length"), "length", places=3)


@query("""SELECT a || '-' || b AS edge, CAST(x AS BIGINT) AS cx, CAST(y AS BIGINT) AS cy FROM driven, unnest(range(CAST(floor(least(ae, be) / 5000) AS BIGINT), CAST(floor(greatest(ae, be) / 5000) AS BIGINT) + 1)) p(x),
  unnest(range(CAST(floor(least(an, bn) / 5000) AS BIGINT), CAST(floor(greatest(an, bn) / 5000) AS BIGINT) + 1)) q(y)""", DRIVEN)
def m2_grid_index(spark, d):
    return roads.grid_index(driven_roads(spark, d), WIDE_M)


@query("""SELECT event_id, round(min(score), 5) AS score FROM (
  SELECT event_id, abs(atan2(sin(br - h), cos(br - h))) + 0.02 * distance AS score FROM (SELECT event_id, distance, radians(event_id % 360 + 0.5) AS h, unnest([atan2(be - ae, bn - an), atan2(ae - be, an - bn)]) AS br FROM projected WHERE distance <= 60)) GROUP BY 1""", LATTICE)
def m3_anchor(spark, d):
    p = road_points(spark, d).withColumn("h", F.radians(F.pmod("event_id", F.lit(360)) + 0.5))
    return rounded(roads.anchor(p, lattice(spark, d), ["event_id"], "h", 60.0, 100).select("event_id", "score"), "score", places=5)


@query("""SELECT session_key, CASE WHEN user_id % 5 = 4 AND user_id % 4 <> 3 THEN 100.0 * (3 - user_id % 4) + 60 ELSE 400.0 - 100 * (user_id % 5) + 100 * (3 - user_id % 4) END::DOUBLE AS distance FROM (SELECT DISTINCT session_key, user_id FROM samples)""", PRELUDE)
def m4_route_distance(spark, d):
    """From 30 m along a street of the lattice to 30 m along another: the way round the blocks."""
    s = samples(spark, d).select("session_key", "user_id").distinct()
    x, y = F.pmod("user_id", F.lit(5)), F.pmod("user_id", F.lit(4))
    edge = lambda x, y: F.concat_ws("-", (x * 1000 + y).cast("string"), ((x + 1) * 1000 + y).cast("string"))
    pairs = s.select("session_key", edge(x, y).alias("edge_i"), (x * SPACING + 30).alias("ei"), (y * SPACING).alias("ni"), edge(F.lit(4), F.lit(3)).alias("edge_j"), F.lit(430.0).alias("ej"), F.lit(300.0).alias("nj"))
    ends = pairs.select("session_key", F.explode(F.array(F.struct(F.col("ei").alias("e"), F.col("ni").alias("n")), F.struct(F.col("ej").alias("e"), F.col("nj").alias("n")))).alias("p")).select("session_key", "p.*")
    homes = roads.regions(ends, ["session_key"], 1000.0)
    out = roads.route_distances(pairs.join(homes, "session_key"), roads.own_edges(ends.join(homes, "session_key"), lattice(spark, d), roads.REGION, 500.0), roads.REGION)
    # on one street both points lie at 30 m of the same or another block
    return rounded(out.select("session_key", "distance"), "distance", places=4)


FOLDED = PRELUDE + """, side AS (
  SELECT CAST(greatest(8, ceil(sqrt(count(DISTINCT user_id)))) AS BIGINT) AS streets, 100.0 * (greatest(8, ceil(sqrt(count(DISTINCT user_id)))) - 1) AS length FROM events
)"""


#: Stairs: a block east, a block north and so on to the far corner of the lattice and back; every second session has its mirror image.
STAIRS = FOLDED + """, stairs AS (
  SELECT session_key, row_idx, user_id, event_id, CAST(floor(p / 100) AS BIGINT) AS m, p % 100 AS r FROM (
    SELECT session_key, row_idx, user_id, event_id, 2 * length - abs((100.0 * (user_id % (2 * streets - 2)) + 25 + 50 * row_idx) % (4 * length) - 2 * length) AS p FROM samples, side)
), steps_on AS (
  SELECT *, CASE WHEN m % 2 = 0 THEN m // 2 * 100.0 + r ELSE (m + 1) // 2 * 100.0 END AS x, CASE WHEN m % 2 = 0 THEN m // 2 * 100.0 ELSE (m - 1) // 2 * 100.0 + r END AS y FROM stairs
)"""


def stairs(place):
    """East and north of a place along the stairs, and whether it lies on a block that goes east."""
    m, r = F.floor(place / SPACING), F.pmod(place, F.lit(SPACING))
    east = m % 2 == 0
    return F.when(east, F.floor(m / 2) * SPACING + r).otherwise((m + 1) / 2 * SPACING), F.when(east, F.floor(m / 2) * SPACING).otherwise((m - 1) / 2 * SPACING + r), east


def turning_drives(spark, d):
    """Each session with all its rows drives the stairs there and back, a little beside the road."""
    s = with_streets(spark, d, samples(spark, d)).withColumn("length", (F.col("streets") - 1) * SPACING)
    place = folded(SPACING * F.pmod("user_id", 2 * F.col("streets") - 2) + 25 + F.col("row_idx") * 50.0, 2 * F.col("length"))
    x, y, east = stairs(F.col("place"))
    s = s.withColumn("place", place).withColumns({"x": x, "y": y, "east": east, "off": F.pmod("event_id", F.lit(7)).cast("double")})
    x, y = F.when(F.col("east"), F.col("x")).otherwise(F.col("x") + F.col("off")), F.when(F.col("east"), F.col("y") + F.col("off")).otherwise(F.col("y"))
    mirror = F.col("user_id") % 2 == 1
    return s.select("session_key", F.col("row_idx").cast("long").alias("row_idx"), F.when(mirror, y).otherwise(x).alias("e"), F.when(mirror, x).otherwise(y).alias("n"))


@query("SELECT session_key, row_idx, round(CASE WHEN user_id % 2 = 1 THEN y ELSE x END, 4) AS match_e, round(CASE WHEN user_id % 2 = 1 THEN x ELSE y END, 4) AS match_n, true AS matched FROM steps_on", STAIRS)
def m5_hmm_match(spark, d):
    """All rows of all sessions through a turn at every corner, on the whole lattice."""
    p, edges, cap, most = turning_drives(spark, d), lattice(spark, d), 400.0, 120.0
    cand = roads.near_edges_expanding(p, edges, ["session_key", "row_idx"], most=most)
    reach = cap / 2 + most
    out = roads.hmm_match(p, cand, edges, ["session_key"], reach, sigma=5.0, cap=cap)
    return rounded(out.select("session_key", "row_idx", "match_e", "match_n", "matched"), "match_e", "match_n", places=4)


def folded(along, length):
    """Place on a street of ``length`` after ``along`` metres back and forth on it."""
    return length - F.abs(F.pmod(along, 2 * length) - length)


def whole_drives(spark, d):
    """Each session with all its rows drives back and forth along its street of the whole lattice, a little beside it."""
    s = with_streets(spark, d, samples(spark, d)).withColumn("length", (F.col("streets") - 1) * SPACING)
    e = folded(F.col("row_idx") * 40.0 + 20, F.col("length"))
    return s.select("session_key", F.col("row_idx").cast("long").alias("row_idx"), e.alias("e"), (F.pmod("user_id", F.col("streets")) * SPACING + F.pmod("event_id", F.lit(7))).cast("double").alias("n"))


@query("SELECT session_key, row_idx, round(length - abs((row_idx * 40.0 + 20) % (2 * length) - length), 4) AS match_e, round(100.0 * (user_id % streets), 4) AS match_n, true AS matched FROM samples, side", FOLDED)
def m5_hmm_match_whole(spark, d):
    """All rows of all sessions back and forth on one street of the whole lattice. Routes of at most ``cap`` metres stay within half of it of the candidates' foot points."""
    p, edges, cap, most = whole_drives(spark, d), lattice(spark, d), 2000.0, 200.0
    cand = roads.near_edges_expanding(p, edges, ["session_key", "row_idx"], most=most)
    # near_edges_expanding may double its radius past ``most`` once
    reach = cap / 2 + 2 * most
    out = roads.hmm_match(p, cand, edges, ["session_key"], reach, cap=cap)
    return rounded(out.select("session_key", "row_idx", "match_e", "match_n", "matched"), "match_e", "match_n", places=4)


#: Sessions that begin in the same square of so many metres share a region of the lattice.
REGION_M = 1000.0


@query("""SELECT session_key, row_idx AS step, round(CASE WHEN m % 2 = 0 THEN m // 2 * 100.0 + r ELSE (m + 1) // 2 * 100.0 END, 4) AS map_e, round(CASE WHEN m % 2 = 0 THEN m // 2 * 100.0 ELSE (m - 1) // 2 * 100.0 + r END, 4) AS map_n FROM (
  SELECT session_key, row_idx, CASE WHEN p = last THEN CAST(floor(last / 100) AS BIGINT) - 1 ELSE CAST(floor(p / 100) AS BIGINT) END AS m, CASE WHEN p = last THEN 100.0 ELSE p % 100 END AS r FROM (
    SELECT session_key, row_idx, 2 * length + 100 AS last, least(2 * length + 100, 200.0 * (user_id % (streets - 1)) + 15 + 12 * (row_idx + 1)) AS p FROM samples, side))""", FOLDED)
def m6_map_aided_walk(spark, d):
    """All rows of all sessions up the stairs with a turn at each corner, and beyond the lattice's last corner to the end of a blind alley, where they stay."""
    s = with_streets(spark, d, samples(spark, d)).withColumns({"step": F.col("row_idx").cast("long"), "speed": F.lit(12.0), "from": 2 * SPACING * F.pmod("user_id", F.col("streets") - 1) + 15})
    block = lambda after: F.floor((F.col("from") + 12 * after) / SPACING)
    # a right angle in the second in which a corner is passed: left after a block east, right after a block north
    turn = F.when(block(F.col("step") + 1) == block(F.col("step")), 0.0).when(block(F.col("step")) % 2 == 0, -math.pi / 2).otherwise(math.pi / 2)
    s = s.withColumn("yaw_rate", turn)
    start = s.groupBy("session_key", "from").agg((F.sum("speed") + 2 * SPACING).alias("reach"), F.count("*").alias("rows"))
    x, y, _ = stairs(F.col("from"))
    start = start.select("session_key", x.alias("e"), y.alias("n"), F.lit(math.pi / 2).alias("h"), "reach", "rows")
    homes = roads.regions(start, ["session_key"], REGION_M, "rows")
    last = lattice(spark, d).agg(F.max("be").alias("be")).select(F.col("be").alias("ae"), F.col("be").alias("an"), (F.col("be") + SPACING).alias("be"), F.col("be").alias("bn"), F.lit(SPACING).alias("length"))
    corner = (F.col("ae") / SPACING * 1001).cast("long").cast("string")
    edges = lattice(spark, d).unionByName(last.withColumns({"a": corner, "b": F.lit("end")}).withColumn("edge", F.concat_ws("-", "a", "b")))
    at = roads.anchor(start, edges, ["session_key"], "h").join(homes, "session_key")
    own = roads.own_edges(start.join(homes, "session_key"), edges, roads.REGION, "reach")
    out = roads.map_aided_walk(s, at, own, ["session_key"], 1.0, False, by=roads.REGION)
    return rounded(out.select("session_key", "step", "map_e", "map_n"), "map_e", "map_n", places=4)


@query("SELECT session_key, row_idx AS step, round(length - abs((15.0 + (row_idx + 1) * 12) % (2 * length) - length), 4) AS map_e, round(100.0 * (user_id % streets), 4) AS map_n FROM samples, side", FOLDED)
def m6_map_aided_walk_whole(spark, d):
    """All rows of all sessions along the whole of a street, turning back at its ends."""
    s = samples(spark, d).select("session_key", "user_id", F.col("row_idx").cast("long").alias("step"), F.lit(0.0).alias("yaw_rate"), F.lit(12.0).alias("speed"))
    start = with_streets(spark, d, s.groupBy("session_key", "user_id").agg((F.sum("speed") + SPACING).alias("reach"), F.count("*").alias("rows")))
    start = start.select("session_key", F.lit(15.0).alias("e"), (F.pmod("user_id", F.col("streets")) * SPACING).cast("double").alias("n"), F.lit(math.pi / 2).alias("h"), F.least(F.col("reach"), F.col("streets") * SPACING).alias("reach"), "rows")
    streets = lattice(spark, d).where("an = bn")
    homes = roads.regions(start, ["session_key"], REGION_M, "rows")
    at = roads.anchor(start, streets, ["session_key"], "h").join(homes, "session_key")
    own = roads.own_edges(start.join(homes, "session_key"), streets, roads.REGION, "reach")
    out = roads.map_aided_walk(s, at, own, ["session_key"], 1.0, by=roads.REGION)
    return rounded(out.select("session_key", "step", "map_e", "map_n"), "map_e", "map_n", places=4)


def street_drives(spark, d):
    """All rows of each session as a drive at 10 Hz and 10 to 15 m/s back and forth on its street of the lattice, with a gyro that errs."""
    s = with_streets(spark, d, samples(spark, d)).withColumns({"length": (F.col("streets") - 1) * SPACING, "speed": 10 + F.col("k") / 20})
    w = W.partitionBy(*KEYS).orderBy("row_idx").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("along", F.pmod("user_id", F.lit(97)) * 37.0 + F.sum(F.col("speed") / 10).over(w))
    east = F.pmod("along", 2 * F.col("length")) < F.col("length")
    n = (F.pmod("user_id", F.col("streets")) * SPACING + F.pmod("event_id", F.lit(7))).cast("double")
    still = {c: F.lit(0.0) for c in reckon.CHANNELS} | {"acc_z": F.lit(9.81), "gravity_z": F.lit(9.81), "acc_x": (F.col("k") - 50) / 100, "gyro_z": 0.02 + (F.col("k") - 50) / 500}
    return s.withColumns({"e": folded(F.col("along"), F.col("length")), "n": n, "course_deg": F.when(east, 90.0).otherwise(270.0), "az_deg": F.when(east, 70.0).otherwise(250.0)} | still)


@query(None)
def m7_free_vs_map(spark, d):
    from roadtrace.plans import mapmatch

    return mapmatch.free_vs_map(street_drives(spark, d), lattice(spark, d), KEYS, ["driver_id"], (15.0, 40.0), 10, step_s=0.5)


# --- sources and sinks


def file_list(spark, d):
    docs = table(spark, d, "documents")
    folder = F.concat(F.lit("/data/(Driver "), "source", F.lit(")"))
    side = F.when(F.pmod("doc_id", F.lit(3)) == 0, "V").otherwise("S")
    return docs.select(F.concat(folder, F.lit("/"), side, F.lit("-K"), F.pmod("doc_id", F.lit(11)).cast("string"), F.lit(".csv")).alias("path"), folder.alias("folder"), side.alias("side"), F.concat(F.lit("k"), F.pmod("doc_id", F.lit(11)).cast("string")).alias("key"))


FILES = """
WITH files AS (
  SELECT DISTINCT '/data/(Driver ' || source || ')' AS folder, source, CASE WHEN doc_id % 3 = 0 THEN 'V' ELSE 'S' END AS side, 'k' || doc_id % 11 AS key FROM documents
)"""


@query("SELECT s.key, s.source AS driver_id FROM files s JOIN files v ON s.folder = v.folder AND s.key = v.key WHERE s.side = 'S' AND v.side = 'V'", FILES)
def s1_discover_pairs(spark, d):
    f = file_list(spark, d).distinct().withColumn("key", recordings.recording_key(F.col("path")))
    return recordings.discover_pairs(f).select("key", "driver_id")


@query("SELECT key FROM files WHERE side = 'S' INTERSECT SELECT key FROM files WHERE side = 'V'", FILES)
def s2_list_pairs(spark, d):
    return recordings.list_pairs(file_list(spark, d)).select("key")


def _round_trip(spark: SparkSession, write, name: str) -> str:
    """A new folder for a query that writes and reads back, below the one that all executors share."""
    import uuid

    path = f"{shared_base(spark)}/roadtrace-{name}-{uuid.uuid4().hex[:12]}"
    write(path)
    return path


def _recording(s: DataFrame, columns: list[str], filled: dict) -> DataFrame:
    return s.select("file", "row_idx", *[filled.get(c, F.lit("")).cast("string").alias(c) for c in columns])


def _write_csv(df: DataFrame, columns: list[str]):
    # one file for each session
    return lambda path: sinks.write_recordings(df, path, columns)


@query("SELECT session_key, row_idx, round(lat, 6) AS lat, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS gps_speed_ms, round(k / 1000, 6) AS elapsed_s FROM samples", PRELUDE)
def s3_read_phone(spark, d):
    s = samples(spark, d).withColumn("file", F.concat(F.lit("S-"), "session_key"))
    csv = _recording(s, recordings.PHONE, {"lat": F.round("lat", 6), "gps_speed_ms": F.when(F.pmod("event_id", F.lit(10)) == 0, "n/a").otherwise(F.col("value").cast("string")), "elapsed_ms": F.col("k")})
    path = _round_trip(spark, _write_csv(csv, recordings.PHONE), "phone")
    # the rows keep their order in their file
    raw = recordings._read(spark, path, recordings.PHONE, {"phone_ts", "unused"})
    rows = recordings.with_source_row(raw.withColumn("path", F.regexp_extract("path", r"/S-([^/]+)\.csv$", 1)))
    return rows.select(F.col("path").alias("session_key"), "row_idx", "lat", "gps_speed_ms", F.round(signals.elapsed_seconds("elapsed_ms"), 6).alias("elapsed_s"))


@query("SELECT session_key, row_idx, value AS velocity_kmh, round(k / 100 * 9.80665, 8) AS acc_long FROM samples", PRELUDE)
def s4_read_vehicle(spark, d):
    s = samples(spark, d).withColumn("file", F.concat(F.lit("V-"), "session_key"))
    csv = _recording(s, recordings.VEHICLE, {"velocity_kmh": F.col("value"), "acc_long_g": F.col("k") / 100})
    path = _round_trip(spark, _write_csv(csv, recordings.VEHICLE), "vehicle")
    raw = recordings._read(spark, path, recordings.VEHICLE, set())
    rows = recordings.with_source_row(raw.withColumn("path", F.regexp_extract("path", r"/V-([^/]+)\.csv$", 1)))
    return rows.select(F.col("path").alias("session_key"), "row_idx", "velocity_kmh", F.round(F.col("acc_long_g") * recordings.STANDARD_GRAVITY, 8).alias("acc_long"))


@query("SELECT session_key, count(*) AS rows, max(row_idx) AS last_row FROM samples GROUP BY 1", PRELUDE)
def s5_with_source_row(spark, d):
    s = samples(spark, d).select(F.col("session_key").alias("path"), F.col("t_s").alias("_order"))
    return recordings.with_source_row(s).groupBy(F.col("path").alias("session_key")).agg(F.count("*").alias("rows"), F.max("row_idx").alias("last_row"))


@query("SELECT vec_id, round(gyro_y, 6) AS gy, round(gravity_x, 6) AS grx FROM imu_vec", PRELUDE)
def s6_resolve_column(spark, d):
    v = imu_vec(spark, d).select("vec_id", F.col("gravity_x").alias("GRAVITY X (m/s2)"), F.col("gyro_x").alias("GYROSCOPE X (rad/s)"), F.col("gyro_y").alias("GYROSCOPE Y (rad/s)"))
    gy, grx = recordings.resolve_column(v.columns, "gyroscope", "y"), recordings.resolve_column(v.columns, "gravity", "x")
    return v.select("vec_id", F.round(f"`{gy}`", 6).alias("gy"), F.round(f"`{grx}`", 6).alias("grx"))


@query("""SELECT session_key, row_number() OVER (PARTITION BY session_key ORDER BY row_idx) - 1 AS row_idx, round(speed_kmh / 3.6, 6) AS speed_ms, round(velocity_kmh / 3.6, 6) AS velocity_ms FROM samples JOIN vehicle USING (driver_id, session_key, row_idx) WHERE velocity_kmh IS NOT NULL""", PRELUDE)
def s7_tidy_pairs(spark, d):
    from roadtrace.queries.views import vehicle

    out = recordings.tidy_pairs(samples(spark, d).select(*KEYS, "row_idx", "speed_kmh"), vehicle(spark, d).select(*KEYS, "row_idx", "velocity_kmh"), KEYS, ["speed_kmh", "velocity_kmh"])
    return out.select("session_key", "row_idx", F.round("speed_kmh", 6).alias("speed_ms"), F.round("velocity_kmh", 6).alias("velocity_ms"))


@query("SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'gnss' ELSE 'imu' END AS kind, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s8_read_drive_log(spark, d):
    e = table(spark, d, "events")
    gnss = F.col("event_type").isin("purchase", "signup")
    filled = {"kind": F.when(gnss, "gnss").otherwise("imu"), "t": F.col("event_id"), "ax": F.when(~gnss, F.col("value")), "speed": F.when(gnss, F.col("value"))}
    log = e.select(*[filled.get(c, F.lit(None)).cast("string").alias(c) for c in recordings.LOG])
    path = _round_trip(spark, lambda p: log.write.option("header", "true").csv(p), "log")
    imu_rows, fix_rows = recordings.split_log(recordings.read_drive_log(spark, path))
    both = imu_rows.select(F.lit("imu").alias("kind"), F.col("ax").alias("x")).unionByName(fix_rows.select(F.lit("gnss").alias("kind"), F.col("speed").alias("x")))
    return both.groupBy("kind").agg(F.count("*").alias("rows"), F.round(F.sum("x"), 4).alias("total"))


@query("SELECT driver_id, session_key, row_idx, round(CAST(value AS FLOAT)::DOUBLE, 4) AS value FROM samples", PRELUDE)
def s9_write_sessions(spark, d):
    path = _round_trip(spark, lambda p: sinks.write_sessions(samples(spark, d).select(*KEYS, "row_idx", "value"), p), "sessions")
    return spark.read.parquet(path).select("driver_id", F.col("session_key").cast("string").alias("session_key"), "row_idx", F.round(F.col("value").cast("double"), 4).alias("value"))


@query("SELECT session_key, count(*) AS rows, true AS same FROM samples GROUP BY 1", PRELUDE)
def s10_content_checksum(spark, d):
    s = samples(spark, d).select(*KEYS, "row_idx", "value", "k")
    a = validate.content_checksum(s, KEYS, ["row_idx", "value", "k"])
    b = validate.content_checksum(s.repartition(3, "row_idx"), KEYS, ["row_idx", "value", "k"]).select(*KEYS, F.col("checksum").alias("again"))
    return a.join(b, KEYS).select("session_key", "rows", (F.col("checksum") == F.col("again")).alias("same"))


@query("SELECT user_id AS way, count(*) AS points, min(CASE WHEN user_id % 4 = 0 THEN 'w' || user_id || '_' || row_idx ELSE CAST(event_id AS VARCHAR) END) AS first_node FROM samples GROUP BY user_id", PRELUDE)
def s11_read_road_ways(spark, d):
    s = samples(spark, d)
    p = F.array_sort(F.collect_list(F.struct("row_idx", "event_id", "lat", "lon")))
    w = s.groupBy(F.col("user_id").alias("id")).agg(p.alias("p"))
    w = w.select(F.lit("way").alias("type"), "id", F.when(F.pmod("id", F.lit(4)) != 0, F.transform("p", lambda x: x["event_id"])).alias("nodes"), F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("geometry"))
    doc = w.select(F.to_json(F.struct(F.array(F.struct("type", "id", "nodes", "geometry")).alias("elements"))).alias("value"))
    path = _round_trip(spark, lambda x: doc.write.text(x), "ways")
    # one document on each line here, where map files have one document each
    raw = spark.read.schema(recordings.WAYS).json(path).select(F.explode("elements").alias("x")).select("x.*")
    return recordings.explode_ways(raw).groupBy("way").agg(F.count("*").alias("points"), F.min("node").alias("first_node"))


@query("SELECT driver_id, count(DISTINCT session_key) AS sessions FROM samples GROUP BY 1", PRELUDE)
def s12_write_metadata(spark, d):
    t = samples(spark, d).groupBy("driver_id").agg(F.count_distinct("session_key").alias("sessions"))
    path = _round_trip(spark, lambda p: sinks.write_metadata({"drivers": t}, p), "metadata")
    return spark.read.schema("driver_id string, sessions long").option("header", "true").csv(f"{path}/drivers")


@query("""SELECT s.session_key, c.dist AS distance_m, c.s AS start, f.row_idx, CASE WHEN f.row_idx BETWEEN c.s AND c.e - 1 THEN 'BLACKOUT' ELSE 'GNSS' END AS mode, round(s.value, 1) AS speed_kmh, CASE WHEN f.row_idx BETWEEN c.s AND c.e - 1 THEN 3.0 ELSE 0 END::DOUBLE AS free_drift_m
FROM (SELECT session_key, dist, s, e, unnest(range(s - 10, e + 10, 2)) AS row_idx FROM scan WHERE ok) f JOIN scan c USING (session_key, dist, s) JOIN long_samples s ON s.session_key = f.session_key AND s.row_idx = f.row_idx""", SCAN)
def s13_export_replay(spark, d):
    """Frames of every blackout of every session."""
    # the SQL rounds ten times the value: 14.149999999999999 is 14.2, where round(value, 1) makes it 14.1
    s = long_samples(spark, d).withColumn("speed", F.round(F.col("value") * 10) / 10 / 3.6)
    e, n = geo.to_enu("lat", "lon", 52.0, -1.5)
    found = e3_distance_blackouts(spark, d)
    keys = [*KEYS, "distance_m"]
    dark = found.withColumn("row_idx", F.explode(F.expr('sequence(start, end - 1)')))
    track = dark.join(s.select(*KEYS, "row_idx", (e + 3).alias("e"), n.alias("n")), [*KEYS, "row_idx"])
    drives_ = s.join(found.select(*keys).distinct(), KEYS)
    out = sinks.replays(drives_, track, track, found, keys, 52.0, -1.5, 10, 10)
    return out.select("session_key", "distance_m", "start", "row_idx", "mode", "speed_kmh", "free_drift_m")


@query("""SELECT session_key, part, row_number() OVER (PARTITION BY session_key, part ORDER BY row_idx) AS number, round(lat / 60, 8) AS lat, round(-lon / 60, 8) AS lon FROM samples JOIN (
  SELECT session_key, part, CASE part WHEN 1 THEN 0 ELSE n // 2 END AS f, CASE part WHEN 1 THEN n // 3 ELSE n - 1 END AS l FROM (SELECT session_key, count(*) AS n FROM samples GROUP BY 1), (SELECT unnest([1, 2]) AS part)) r USING (session_key) WHERE row_idx BETWEEN f AND l AND (row_idx - f) % 5 = 0""", PRELUDE)
def s14_trim_and_decimate(spark, d):
    """The first third and the second half of every session, every fifth row."""
    s = samples(spark, d)
    n = s.groupBy("session_key").agg(F.count("*").alias("n"))
    ranges = F.array(F.struct(F.lit(1).alias("part"), F.lit(0).cast("long").alias("first"), F.expr("n div 3").alias("last")), F.struct(F.lit(2).alias("part"), F.expr("n div 2").alias("first"), (F.col("n") - 1).alias("last")))
    parts = n.select("session_key", F.explode(ranges).alias("r")).select("session_key", "r.*")
    out = sinks.trim_and_decimate(s, parts, ["session_key"], 5)
    return out.select("session_key", "part", "number", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


# --- device streams (their batch form; the tests replay them as streams)


@query("""SELECT i.event_id, CASE WHEN f.fix_t IS NULL OR i.t_s - f.fix_t > 50000 OR f.accuracy > 80 THEN 'denied' WHEN f.accuracy <= 40 THEN 'good' ELSE 'degraded' END AS health FROM imu i ASOF LEFT JOIN fixes f ON i.session_key = f.session_key AND i.t_s >= f.fix_t""", PRELUDE)
def r1_gnss_health(spark, d):
    return devices.gnss_health(imu(spark, d), fixes(spark, d), KEYS, "t_s", "fix_t", "accuracy", 50_000.0, 40.0, 80.0, "event_id").select("event_id", "health")


@query("""SELECT g.session_key, round(last_fix, 3) AS last_fix, round(coalesce("end", l) - last_fix - 50000, 3) AS seconds, round(coalesce(sum(dist), 0), 1) AS distance FROM (SELECT session_key, fix_t AS last_fix, lead(fix_t) OVER (PARTITION BY session_key ORDER BY fix_t) AS "end" FROM fixes) g
JOIN (SELECT session_key, max(t_s) AS l FROM imu GROUP BY 1) m USING (session_key)
LEFT JOIN (SELECT session_key, t_s, speed_kmh / 3.6 * coalesce(t_s - lag(t_s) OVER (PARTITION BY session_key ORDER BY t_s), 0) AS dist FROM imu) i ON i.session_key = g.session_key AND i.t_s > last_fix + 50000 AND i.t_s < coalesce("end", 1e18)
WHERE coalesce("end", l) - last_fix > 50000 GROUP BY ALL""", PRELUDE)
def r2_outages(spark, d):
    s = imu(spark, d).withColumn("v", F.col("speed_kmh") / 3.6)
    out = devices.outages(s, fixes(spark, d), KEYS, "t_s", "fix_t", "v", 50_000.0)
    return out.select("session_key", F.round("last_fix", 3).alias("last_fix"), F.round("seconds", 3).alias("seconds"), F.round("distance", 1).alias("distance"))


@query("""SELECT user_id, count(*) AS events FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s""")
def r3_session_windows(spark, d):
    return devices.device_sessions(table(spark, d, "events"), "user_id", "ts", "12 hours").select("user_id", "events")


@query("SELECT user_id, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, round(avg(value), 6) AS value_mean FROM events GROUP BY ALL")
def r4_tumbling_windows(spark, d):
    out = devices.tumbling_means(table(spark, d, "events"), "user_id", "ts", ["value"], "1 hour")
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start_us"), "n", F.round("value_mean", 6).alias("value_mean"))


@query("""SELECT user_id, start_us, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 8) AS variance FROM (
  SELECT user_id, value, unnest([h, h - 3600000000]) AS start_us FROM (SELECT user_id, value, epoch_us(date_trunc('hour', ts)) AS h FROM events)) GROUP BY ALL""")
def r5_sliding_windows(spark, d):
    out = devices.sliding_stats(table(spark, d, "events"), "user_id", "ts", "value", "2 hours", "1 hour")
    return out.select("user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', start)").alias("start_us"), "n", F.round("mean", 6).alias("mean"), F.round("variance", 8).alias("variance"))


@query("SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 30 DAY ELSE ts END AS ts) FROM events)) WHERE seen IS NULL OR ts >= seen - INTERVAL 10 DAY")
def r6_late_rows(spark, d):
    """Rows that a watermark of ten days per device keeps, in arrival order (event_id)."""
    from roadtrace.streaming import late

    e = table(spark, d, "events").withColumn("ts", F.when(F.pmod("event_id", F.lit(17)) == 0, F.col("ts") - F.expr("INTERVAL 30 DAYS")).otherwise(F.col("ts")))
    return late.within_watermark(e, ["user_id"], "ts", "event_id", "10 days").select("event_id")


def filter_rows(spark, d):
    """IMU samples and fixes of each session on a common clock of 0.2 seconds a row, with the stationary flag."""
    s = samples(spark, d)
    e, n = geo.to_enu("lat", "lon", 52.0, -1.5)
    fix = F.pmod("row_idx", F.lit(5)) == 0
    s = s.select("session_key", F.when(fix, "fix").otherwise("imu").alias("kind"), (F.col("row_idx") * 0.2).alias("t"), ((F.col("k") - 50) / 500).alias("omega"), ((F.col("value") - 40) / 100).alias("accel"), (e / 100).alias("e"), (n / 100).alias("n"), (F.col("speed_kmh") / 3.6 / 10).alias("speed"), F.radians("heading_deg").alias("course"), F.lit(5.0).alias("sigma"))
    s = s.withColumns({"linear_norm": F.abs("accel"), "gyro_norm": F.abs("omega")})
    # rows of 0.2 seconds and loud readings: a wider window and bounds than the phone's
    return features.stationary(s, ["session_key"], "t", "linear_norm", "gyro_norm", 1.0, 0.2, 3, 0.05, 0.6, 0.06).drop("linear_norm", "gyro_norm", "quiet")


@query("SELECT session_key, count(*) AS rows, count(*) FILTER (WHERE row_idx % 5 = 0) AS fixes, true AS finite FROM samples GROUP BY 1", PRELUDE)
def r7_fusion_filter(spark, d):
    out = devices.fusion_filter(filter_rows(spark, d), ["session_key"])
    ok = ~F.isnan("east") & ~F.isnan("north") & F.col("speed").between(-1e6, 1e6)
    return out.groupBy("session_key").agg(F.count("*").alias("rows"), F.count("verdict").alias("fixes"), F.bool_and(ok).alias("finite"))


@query(None)
def r7_filter_states(spark, d):
    """The filter's state after every row of every session, and what became of its fixes."""
    return devices.fusion_filter(filter_rows(spark, d), ["session_key"])


@query("""SELECT event_id, coalesce(r AND lag(r) OVER w AND lag(r, 2) OVER w AND abs(k - lag(k) OVER w) <= 40 AND abs(k - lag(k, 2) OVER w) <= 40 AND abs(lag(k) OVER w - lag(k, 2) OVER w) <= 40, false) AS anchors FROM (SELECT *, value > 20 AS r FROM samples) WINDOW w AS (PARTITION BY session_key ORDER BY row_idx)""", PRELUDE)
def r8_consistent_rejections(spark, d):
    s = samples(spark, d).withColumns({"rejected": F.col("value") > 20, "dn": F.lit(0.0)})
    return devices.consistent_rejections(s, KEYS, "k", "dn", "rejected", "row_idx", 40.0).select("event_id", "anchors")


@query(None)
def r9_recovery_stats(spark, d):
    rows = filter_rows(spark, d).where("kind = 'imu' or pmod(cast(t / 0.2 as int), 25) = 0")
    return devices.recovery_stats(devices.fusion_filter(rows, ["session_key"]), ["session_key"])


@query(None)
def r10_alignment_states(spark, d):
    """With a speed and without: rows in each state and the forward axes found."""
    v = imu_vec(spark, d).withColumn("speed", F.when(F.pmod("row_idx", F.lit(2)) == 0, 0.1).otherwise(5.0))
    v = v.withColumn("with_speed", F.lit(True)).unionByName(v.withColumns({"with_speed": F.lit(False), "speed": F.lit(None).cast("double")}))
    out = devices.alignment_states(v, [*KEYS, "with_speed"], tuple(AXES[:3]), tuple(AXES[6:]), "speed", window=5, acc_var=10.0, gyro_var=0.01)
    return out.groupBy("session_key", "with_speed", "state").agg(F.count("*").alias("rows"), F.array_sort(F.collect_set("axis")).alias("axes"))


@query("SELECT session_key, row_idx FROM trail", PRELUDE.replace("WITH telemetry", "WITH RECURSIVE telemetry") + """, places AS (
  SELECT session_key, row_idx, radians(lon + 1.5) * 6371000.0 * cos(radians(52)) AS e, radians(lat - 52) * 6371000.0 AS n FROM samples
), trail AS (
  SELECT session_key, row_idx, e, n FROM places WHERE row_idx = 0
  UNION ALL
  SELECT session_key, row_idx, e, n FROM (
    SELECT p.*, row_number() OVER (PARTITION BY p.session_key ORDER BY p.row_idx) AS r FROM trail t JOIN places p ON p.session_key = t.session_key AND p.row_idx > t.row_idx AND sqrt((p.e - t.e) ** 2 + (p.n - t.n) ** 2) >= 2000) WHERE r = 1
)""")
def r11_trail_thinning(spark, d):
    e, n = geo.to_enu("lat", "lon", 52.0, -1.5)
    s = samples(spark, d).select("session_key", F.col("row_idx").cast("long").alias("row_idx"), e.alias("e"), n.alias("n"))
    return devices.thin_trail(s, ["session_key"], "e", "n", "row_idx", 2000.0).select("session_key", "row_idx")


@query("SELECT session_key, event_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY fix_t DESC) AS recency FROM fixes) WHERE recency <= 5", PRELUDE)
def r11_last_fixes(spark, d):
    return devices.last_fixes(fixes(spark, d), KEYS, "fix_t", 5).select("session_key", "event_id", "recency")
