"""Leakage-free splits, eligibility and the checks behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c
from roadtrace.functions.signals import stable_hash
from roadtrace.operators.joins import small_side

SPLITS = ("train", "validation", "test")


def scope_drives(drives: DataFrame, key: str, include: list[str], exclude: DataFrame, test: list[str], validation: list[str], min_rows: int) -> DataFrame:
    """Drives whose key begins with one of ``include``, is not excluded and has enough rows, with their split by key prefix."""
    begins = lambda prefixes: F.col(key).rlike("^(" + "|".join(prefixes) + ")") if prefixes else F.lit(False)
    kept = drives.where(begins(include) & (F.col("rows") >= min_rows)).join(exclude.select(key).distinct(), key, "left_anti")
    return kept.withColumn("split", F.when(begins(test), "test").when(begins(validation), "validation").otherwise("train"))


def select_sessions(manifest: DataFrame, drivers: dict[str, str] | None = None) -> DataFrame:
    """Sessions for training: flagged ``training_eligible`` where that column exists, else of verified alignment; optionally only drivers with an explicit split."""
    if "training_eligible" in manifest.columns:
        kept = manifest.where("training_eligible")
    else:
        kept = manifest.where("quality = 'verified_row_alignment'")
    if drivers:
        names = F.create_map(*[F.lit(x) for pair in drivers.items() for x in pair])
        kept = kept.withColumn("driver_holdout_split", F.try_element_at(names, F.col("driver_id"))).where("driver_holdout_split is not null")
    return kept


def driver_holdout(manifest: DataFrame, rows: str = "paired_rows") -> DataFrame:
    """Add driver_holdout_split: the driver with most rows trains, the next validates, the others test (ties by driver id).

    Fewer than three drivers raise an error when the rows are computed.
    """
    totals = manifest.groupBy("driver_id").agg(F.sum(rows).alias("_rows"))
    r = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("_rows"), "driver_id"))  # one row per driver
    n = F.count("*").over(W.partitionBy(F.lit(0)))
    few = F.raise_error(F.lit("at least three drivers are needed")).cast("string")
    split = F.when(n < 3, few).when(r == 1, "train").when(r == 2, "validation").otherwise("test")
    return manifest.join(small_side(totals.select("driver_id", split.alias("driver_holdout_split"))), "driver_id")


def _cut(rank: Column, n: Column, share: float) -> Column:
    held = F.greatest(F.lit(1), F.bround(n * F.lit(share), 0).cast("int"))
    return F.when(n == 1, "train").when(n == 2, F.when(rank == 1, "train").otherwise("test")).when(rank > n - held, "test").when(rank > n - 2 * held, "validation").otherwise("train")


def drive_holdout(manifest: DataFrame, seed: int = 42, share: float = 0.15) -> DataFrame:
    """Add drive_holdout_split: within a driver by the hash order of the session key, test and validation at the end (rounded half to even, at least one each)."""
    w = W.partitionBy("driver_id")
    rank = F.row_number().over(w.orderBy(stable_hash(seed, "driver_id", "session_key"), "session_key"))
    return manifest.withColumn("drive_holdout_split", _cut(rank, F.count("*").over(w), share))


def block_split(blocks: DataFrame, strategy: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Add split to units (drive_id, block_id): chronological within a drive, by whole drives, or blocks in hash order.

    The hash order stands for a random permutation, so that the result does not depend on partitions.
    """
    if strategy == "chronological":
        w = W.partitionBy("drive_id")
        rank, n = F.row_number().over(w.orderBy("block_id")) - 1, F.count("*").over(w)
        return blocks.withColumn("split", _share_cut(rank, n, train, validation))
    units = ["drive_id"] if strategy == "drive" else ["drive_id", "block_id"]
    keyed = blocks.select(*units).distinct().withColumn("_h", stable_hash(seed, *units))
    ranked = _global_rank(keyed, "_h", units)
    first = F.floor(F.col("_n") * train).cast("long")
    if strategy == "drive":
        first = F.greatest(F.lit(1), first)
        second = F.greatest(first + 1, F.floor(F.col("_n") * (train + validation)).cast("long"))
    else:
        second = F.floor(F.col("_n") * (train + validation)).cast("long")
    split = F.when(F.col("_r") < first, "train").when(F.col("_r") < second, "validation").otherwise("test")
    return blocks.join(ranked.select(*units, split.alias("split")), units)


def _share_cut(rank: Column, n: Column, train: float, validation: float) -> Column:
    return F.when(rank < F.floor(n * train), "train").when(rank < F.floor(n * (train + validation)), "validation").otherwise("test")


def _global_rank(df: DataFrame, order: str, tie: list[str]) -> DataFrame:
    """Rank from 0 (_r) and count (_n) over all rows: ranks within the first hex digits, offset by the counts of the lower ones."""
    df = df.withColumn("_p", F.substring(order, 1, 2))
    counts = df.groupBy("_p").agg(F.count("*").alias("_c"))
    every = W.partitionBy(F.lit(0)).orderBy("_p")  # at most 256 rows
    firsts = counts.select("_p", (F.sum("_c").over(every) - F.col("_c")).alias("_first"), F.sum("_c").over(W.partitionBy(F.lit(0))).alias("_n"))
    df = df.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy(order, *tie)) - 1)
    return df.join(F.broadcast(firsts), "_p").withColumn("_r", F.col("_r") + F.col("_first")).drop("_p", "_first")


def training_eligibility(segments: DataFrame, horizons: list[int], history: int) -> DataFrame:
    """Per segment and horizon (rows): first and last eligible archive row (-1: none) and their count."""
    out = segments.withColumn("horizon_rows", F.explode(F.array(*[F.lit(h) for h in horizons])))
    first = F.greatest(F.lit(history), F.col("horizon_rows"))
    n = F.greatest(F.lit(0), F.col("rows") - first).cast("long")
    return out.withColumns({
        "history_purge_rows": F.lit(history), "eligible_examples": n,
        "first_eligible_archive_row": F.when(n > 0, F.col("archive_row_start") + first).otherwise(-1).cast("long"),
        "last_eligible_archive_row": F.when(n > 0, F.col("archive_row_end")).otherwise(-1).cast("long"),
    })


def blackout_capacity(segments: DataFrame, durations: list[int], history: int, rows_per_second: int = 10) -> DataFrame:
    """Per segment and duration: how many blackouts fit without overlap."""
    out = segments.withColumn("blackout_seconds", F.explode(F.array(*[F.lit(d) for d in durations])))
    fits = F.floor((F.col("rows") - history) / (rows_per_second * F.col("blackout_seconds")))
    return out.withColumn("nonoverlapping_episodes", F.greatest(F.lit(0), fits).cast("long"))


def eligible_examples(df: DataFrame, purge: int, required: list[str], position: str = "position_in_block") -> DataFrame:
    """Rows far enough into their block, with all features and the target."""
    ok = _c(position) >= purge
    for c in required:
        ok = ok & _c(c).isNotNull()
    return df.where(ok)


def boundary_violations(examples: DataFrame, layout: DataFrame, history: int, horizon: int, keys: list[str] = ("drive_id",), order: str = "local_index") -> DataFrame:
    """Examples whose history or target begins in another block or split than they are in."""
    keys = list(keys)
    own = examples.select(*keys, order, "block_id", "split")
    out = None
    for name, back in (("history", history), ("target", horizon)):
        probe = own.withColumn("_at", _c(order) - back)
        there = layout.select(*keys, _c(order).alias("_at"), F.col("block_id").alias("_b"), F.col("split").alias("_s"))
        bad = probe.join(there, [*keys, "_at"], "left").where(~F.col("block_id").eqNullSafe(F.col("_b")) | ~F.col("split").eqNullSafe(F.col("_s")))
        bad = bad.select(*keys, order, F.lit(name).alias("reach"))
        out = bad if out is None else out.unionByName(bad)
    return out
