"""Sorts, top rows and selections with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def position_rank(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def best_lag(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Of a lag sweep the row of highest speed_corr, then least median_separation, then lowest lag; with the gain over lag 0.

    A session without any correlation keeps lag 0 and a NULL gain.
    """
    has = F.col("speed_corr").isNotNull()
    zero = F.struct(F.col("speed_corr").alias("corr"), F.col("median_separation").alias("separation"))
    best = F.struct(F.col("lag").alias("lag"), F.col("speed_corr").alias("corr"), F.col("median_separation").alias("separation"), F.col("p95_separation").alias("p95"))
    order = F.struct(-F.col("speed_corr"), F.coalesce("median_separation", F.lit(float("inf"))), F.col("lag"))
    out = sweep.groupBy(*keys).agg(F.min_by(best, F.when(has, order)).alias("b"), F.max(F.when(F.col("lag") == 0, zero)).alias("z"))
    gain = F.col("b.corr") - F.col("z.corr")
    return out.select(*keys, F.coalesce("b.lag", F.lit(0)).alias("best_lag"), F.col("b.corr").alias("best_corr"), F.coalesce("b.separation", "z.separation").alias("best_separation"), F.col("b.p95").alias("best_p95"), F.col("z.corr").alias("zero_corr"), F.col("z.separation").alias("zero_separation"), gain.alias("gain"))


def lag_quality(corr0="zero_corr", separation0="zero_separation", best="best_corr", gain="gain") -> Column:
    """Four levels of evidence; a missing value never counts as evidence."""
    zero_ok = F.col(corr0) >= 0.8
    return (
        F.when(zero_ok & (F.col(separation0) <= 100), "verified_row_alignment")
        .when((F.col(best) >= 0.8) & (F.col(gain) >= 0.05), "lag_candidate_manual_review")
        .when(zero_ok, "strong_speed_manual_review")
        .otherwise("review")
    )


def best_channel(profiles: DataFrame, keys: list[str], far: int = 10) -> DataFrame:
    """Axis and lag of the largest absolute correlation (ties: the higher axis, the first lag) and its margin over lags more than ``far`` away on that axis."""
    strength = F.abs("corr")
    order = F.struct(strength, F.col("axis"), -F.col("lag"))
    best = profiles.where("corr is not null").groupBy(*keys).agg(F.max_by(F.struct("axis", "lag", "corr"), order).alias("b"))
    best = best.select(*keys, F.col("b.axis").alias("axis"), F.col("b.lag").alias("best_lag"), F.col("b.corr").alias("best_corr"))
    distant = profiles.join(best, [*keys, "axis"]).where(F.abs(F.col("lag") - F.col("best_lag")) > far)
    second = distant.groupBy(*keys).agg(F.max(strength).alias("second"))
    return best.join(second, keys, "left").withColumn("peak_margin", F.abs("best_corr") - F.coalesce("second", F.lit(0.0))).drop("second")


def representative(episodes: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The row at rank floor(n / 2) (from 0) by ``by`` in each group."""
    w = W.partitionBy(*keys)
    ranked = episodes.withColumns({"_r": F.row_number().over(w.orderBy(by, tie)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2)).drop("_r", "_n")


def demo_score(free_percent, map_percent, turn_degrees) -> Column:
    """Prefers blackouts where free reckoning fails, the map helps and there is some turning."""
    turn = F.col(turn_degrees)
    bonus = F.when((turn > 60) & (turn < 720), F.least(turn, F.lit(400.0)) * 0.05).otherwise(-20.0)
    return F.least(F.col(free_percent), F.lit(120.0)) - 8 * F.col(map_percent) + bonus


def top_one(df: DataFrame, score: Column, tie: list[str], largest: bool = True) -> DataFrame:
    """The row of the best score; ties by the least ``tie`` columns."""
    return df.orderBy(score.desc() if largest else score.asc(), *tie).limit(1)


def select_parameters(scores: DataFrame, parameters: list[str], score: str) -> DataFrame:
    """The setting of the least score; ties by the least setting."""
    best = scores.agg(F.min(F.struct(score, *parameters)).alias("b"))
    return best.select("b.*")
