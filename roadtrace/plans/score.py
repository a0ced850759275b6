"""Blackout scores of a speed-change model against holding the last speed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.operators import aggregates, episodes, joins, ranking, rollout

SEGMENT = ["driver_id", "session_key", "segment_id"]
EPISODE = [*SEGMENT, "duration", "start"]


def score_blackouts(archive: DataFrame, segments: DataFrame, durations: list[int], history: int, horizon: int, speed_ms: str, elapsed: str, delta: str | None = None, rows_per_second: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(episodes, samples, summary) of all time blackouts, for the model (column ``delta``, the predicted change over the horizon) and the baseline.

    Only starts and ends are exploded; samples join them at the endpoints, and the
    true distance is the trapezoid over all rows of a blackout.
    """
    e = episodes.time_blackouts(segments, durations, history, rows_per_second).select(*EPISODE, "end")
    placed = archive.withColumn("position", (F.row_number().over(W.partitionBy(*SEGMENT).orderBy("archive_row")) - 1).cast("long"))
    columns = [F.col(speed_ms).alias("true_speed"), F.col(elapsed).alias("_t"), (F.col(delta) if delta else F.lit(0.0)).alias("_d")]
    rows = placed.select(*SEGMENT, "position", *columns)
    s = joins.endpoints(e, rows, SEGMENT, horizon, ["true_speed", "_t", "_d"])
    first = W.partitionBy(*EPISODE).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("elapsed", F.col("_t") - F.first("_t").over(first))
    dense = joins.endpoints(e, rows, SEGMENT, 1, ["true_speed", "_t"])
    dense = dense.withColumn("_a", rollout.trapezoid("true_speed", "_t", EPISODE)).groupBy(*EPISODE).agg(F.sum("_a").alias("true_distance_m"))
    models = [("hold_last_speed", rollout.hold_last(s, EPISODE, "true_speed"))]
    if delta:
        models.append(("model", rollout.clamped_rollout(s, EPISODE, "true_speed", "_d")))
    scores = samples = None
    for name, own in models:
        own = own.withColumn("model", F.lit(name))
        score = rollout.score_episodes(own, ["model", *EPISODE], dense.withColumn("model", F.lit(name)))
        scores = score if scores is None else scores.unionByName(score)
        samples = own if samples is None else samples.unionByName(own)
    samples = samples.withColumns({"elapsed_seconds": F.col("elapsed"), "velocity_error_kmh": (F.col("predicted") - F.col("true_speed")) * 3.6}).drop("_t", "_d")
    return scores, samples, aggregates.summarize_blackouts(scores, samples, ["model", "duration"])


def representative_episodes(scores: DataFrame) -> DataFrame:
    """For each model and duration the episode of median velocity error."""
    named = scores.withColumn("episode", F.concat_ws(":", *EPISODE))
    return ranking.representative(named, ["model", "duration"], "velocity_mae_kmh", "episode")
