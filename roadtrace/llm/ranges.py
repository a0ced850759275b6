"""Ranges of rows by (id, hash) whose bounds depend on the rows alone, not on partitions, cores or samples.

The light keys of all rows (id, hash, bytes; equal ones summed up first) are sorted
by Spark, and their running bytes, exact whatever the sort's own partitions are,
say where a range of ``per_part`` bytes begins. Rows then look their range up among
the bounds (some 40 bytes each). Ranges grow with the root of the table's bytes, once
that is more than ``per_part``: 100 TB are a million ranges of 100 MB. There are
never more than about ``MAX_PARTS``.

Ids may repeat or be null: the hash of the row's contents parts them. Rows that are
wholly alike and fill more than a range travel once, with their number of copies.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.storage import materialize

MAX_PARTS, GROWTH = 1_000_000, 10
#: Tasks that ranges are dealt to; more ranges share a task, one after the other.
MAX_TASKS = 20_000
#: What a row counts besides its contents.
ROW_BYTES = 64
_LEAST = -(2**63)


def order_keys(id_col: str, contents: list[str]) -> tuple[Column, Column]:
    """Two longs that sort like the id (nulls first), then by a hash of ``contents``."""
    hashed = F.shiftrightunsigned(F.xxhash64(*contents), 1)
    null = F.col(id_col).isNull()
    return F.coalesce(F.col(id_col), F.lit(_LEAST)), F.when(null, hashed.bitwiseOR(F.lit(_LEAST))).otherwise(hashed)


class Ranges:
    """Bounds (first id and hash of each, ascending), the number of each one's first part, and which are a hot key of its own with so many copies a part."""

    def __init__(self, bounds: pd.DataFrame):
        self.ids, self.hashes = bounds["k"].to_numpy(np.int64), bounds["h"].to_numpy(np.int64)
        self.copies = bounds["copies"].to_numpy(np.int64)  # 0: not a hot key
        width = bounds["width"].to_numpy(np.int64)
        self.first = np.cumsum(width) - width
        self.n = int(width.sum())
        self.hot = bool((self.copies > 0).any())

    def find(self, k: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index of the last bound that is not above each key."""
        low, high = np.searchsorted(self.ids, k, "left"), np.searchsorted(self.ids, k, "right")
        at = low - 1
        for value in np.unique(k[high > low]):  # ids at which a range begins: the hash decides
            own = np.flatnonzero(k == value)
            a, b = low[own[0]], high[own[0]]
            at[own] = a + np.searchsorted(self.hashes[a:b], h[own], "right") - 1
        return np.maximum(at, 0)


def cut(rows: DataFrame, id_col: str, contents: list[str], size: Column, per_part: int) -> Ranges:
    """Ranges of about ``per_part`` bytes (``size`` is a row's) of all rows; a larger row has one of its own.

    Rows of one id are not parted, unless two ranges or more begin among them.
    """
    k, h = order_keys(id_col, contents)
    light = rows.select(k.alias("k"), h.alias("h"), (F.coalesce(size, F.lit(0)) + ROW_BYTES).cast("long").alias("b")).groupBy("k", "h").agg(F.sum("b").alias("b"), F.count("*").alias("n"))

    def run(batches):
        from pyspark import TaskContext

        p, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = at + np.cumsum(batch.column(2).to_numpy())
            starts = ends - batch.column(2).to_numpy()
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts), pa.array(np.full(len(starts), p))], names=["k", "h", "b", "n", "start", "p"])

    ordered = light.repartitionByRange("k", "h").sortWithinPartitions("k", "h").mapInArrow(run, "k long, h long, b long, n long, start long, p long")
    light = materialize(ordered, "keys")
    sums = light.groupBy("p").agg(F.max(F.col("start") + F.col("b")).alias("b")).orderBy("p").collect()  # one row for each partition of light keys
    total = sum(r["b"] for r in sums)
    per_part = max(per_part, round(GROWTH * total**0.5), -(-total // MAX_PARTS))
    before, at = [], 0
    for r in sums:
        before.append((r["p"], at))
        at += r["b"]
    offsets = rows.sparkSession.createDataFrame(before, "p long, before long")
    placed = light.join(F.broadcast(offsets), "p")
    part = F.floor((F.col("start") + F.col("before")) / per_part)
    # only the last key of a part can reach beyond it
    found = placed.groupBy(part.alias("part")).agg(F.min(F.struct("k", "h")).alias("first"), F.max(F.struct("k", "h", "b", "n")).alias("last"))
    found = found.select("part", "first.*", F.col("last.k").alias("lk"), F.col("last.h").alias("lh"), "last.b", "last.n").toPandas().sort_values("part")  # at most MAX_PARTS rows
    alike = found[(found["b"] > per_part) & (found["n"] > 1)]
    copies = np.maximum(1, per_part // np.maximum(1, alike["b"] // np.maximum(1, alike["n"])))
    alike = pd.DataFrame({"k": alike["lk"], "h": alike["lh"], "copies": copies, "width": -(-alike["n"] // copies)})
    firsts = found[["k", "h"]].assign(copies=0, width=1)
    led = (firsts["k"] == found["lk"]) & (firsts["h"] == found["lh"]) & found.index.isin(alike.index)  # parts of nothing but alike rows
    firsts.loc[~firsts["k"].duplicated(keep=False) & ~led, "h"] = _LEAST
    bounds = pd.concat([firsts, alike]).sort_values(["k", "h", "copies"]).drop_duplicates(["k", "h"], keep="last")
    return Ranges(bounds.astype("int64"))


def deal(rows: DataFrame, ranges: Ranges, id_col: str, contents: list[str], tails: bool = False, carried: tuple | list = ()) -> DataFrame:
    """Rows of ``id_col``, ``contents`` and ``carried`` (columns that are alike wherever those are) with _h, _n (copies) and _part, each part whole in one partition, in order of (_part, _tail, id, contents).

    With ``tails`` the rows of each part's first id also go to the part before it
    (those of the first part to the last), with ``_tail`` 1. Rows of one id are in
    order of their contents; where they fill several parts, within ranges of the hash.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(ranges)
    k, h = order_keys(id_col, contents)
    kept = [id_col, *contents, *carried]
    keyed = rows.select(*kept, k.alias("_k"), h.alias("_h"))

    @F.pandas_udf("struct<part: long, first: boolean, copies: long>")
    def look_up(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        r = shared.value
        a, b = k.to_numpy(np.int64), h.to_numpy(np.int64)
        at = r.find(a, b)
        same = r.ids[at] == a
        return pd.DataFrame({"part": r.first[at], "first": same, "copies": np.where(same & (r.hashes[at] == b), r.copies[at], 0)})

    found = keyed.withColumn("_at", look_up("_k", "_h"))
    plain = found.where("_at.copies = 0") if ranges.hot else found
    out = plain.select(*kept, "_h", F.lit(1).cast("long").alias("_n"), F.col("_at.part").alias("_part"), F.col("_at.first").alias("_first"))
    if ranges.hot:
        alike = found.where("_at.copies > 0").groupBy(*kept, "_h", F.col("_at.part").alias("_base"), F.col("_at.copies").alias("_c")).agg(F.count("*").alias("_all"))
        spread = alike.withColumn("_j", F.explode(F.expr("sequence(0L, (_all - 1) div _c)")))
        spread = spread.withColumns({"_n": F.least(F.col("_c"), F.col("_all") - F.col("_j") * F.col("_c")), "_part": F.col("_base") + F.col("_j"), "_first": F.lit(True)})
        out = out.unionByName(spread.select(*kept, "_h", "_n", "_part", "_first"))
    if tails:
        to = F.filter(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("t")), F.struct(F.when(F.col("_first"), F.pmod(F.col("_part") - 1, F.lit(max(1, ranges.n)))).alias("p"), F.lit(1).alias("t"))), lambda x: x["p"].isNotNull())
        out = out.withColumn("_to", F.explode(to)).withColumns({"_part": F.col("_to.p"), "_tail": F.col("_to.t")}).drop("_to")
    else:
        out = out.withColumn("_tail", F.lit(0))
    tasks = max(1, min(ranges.n, MAX_TASKS))
    out = out.drop("_first").repartitionById(tasks, F.expr(f"cast(_part * {tasks} div {max(1, ranges.n)} as int)"))
    return out.sortWithinPartitions("_part", "_tail", id_col, *contents)
