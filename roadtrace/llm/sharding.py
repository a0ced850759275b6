"""Extendible hashing: shards of at most ``limit`` bytes from prefixes of a hash.

A document's hash is 60 bits of the md5 of its id. Bytes are summed for the cells
of a fine prefix and folded up level by level, each level the pairs of the one
below; a bucket splits on its next bit only while it is over the limit, so the
directory maps a cell to its shortest prefix that fits. A task folds ``FOLD`` levels
of one subtree (at most 2 ** FOLD cells), and the subtrees' roots that fit are the
cells of the next round. Cells over the limit even at the fine prefix are looked at
again with more bits. Rows of one single hash (repeated ids) cannot be parted by
bits: they are cut into numbered parts by the running bytes of their contents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.llm.storage import join_hot, materialize

HASH_BITS = 60
#: Bits of the cells beyond those that evenly filled shards would need, and bits added for cells over the limit.
FINER, MORE_BITS = 6, 8
LIMIT = 1 << 20
#: Directory rows up to which it is broadcast (about 40 bytes each); a larger one is joined by a shuffle.
BROADCAST_CELLS = 200_000
#: Levels folded in one task.
FOLD = 12
#: Bytes of a single hash that one task puts in order, in limits.
LANE_LIMITS = 1000


def id_hash(doc_id: str = "doc_id") -> Column:
    """60 bits of md5(id as text); a null id hashes as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _cell(depth: int) -> Column:
    return F.shiftright("_h", HASH_BITS - depth)


def fold(cells: np.ndarray, n_bytes: np.ndarray, depth: int, top: int, limit: int) -> tuple[list[tuple[int, int, int]], bool]:
    """Leaves (depth, prefix, bytes) below the root of a subtree whose cells, ascending, have ``depth`` bits, and whether the root of ``top`` bits fits itself."""
    leaves, ok = [], n_bytes <= limit
    while depth > top:
        first = np.flatnonzero(np.concatenate([[True], cells[1:] >> 1 != cells[:-1] >> 1]))
        sums, fit = np.add.reduceat(n_bytes, first), np.logical_and.reduceat(ok, first)
        up = fit & (sums <= limit)
        stay = ok & ~np.repeat(up, np.diff([*first, len(cells)]))  # they fit and their parent does not
        leaves += [(depth, int(c), int(b)) for c, b in zip(cells[stay], n_bytes[stay], strict=True)]
        cells, n_bytes, ok, depth = cells[first] >> 1, sums, up, depth - 1
    return leaves, bool(ok[0])


def _folder(depth: int, top: int, low: int, limit: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("cell")
        own, fits = fold(f["cell"].to_numpy(), f["n_bytes"].to_numpy(), depth, top, limit)
        root = int(f["cell"].iloc[0]) >> (depth - top)
        rows = [(d, p, b, False) for d, p, b in own] + [(top, root, int(f["n_bytes"].sum()), True)] * (fits or top > low)
        return pd.DataFrame(rows, columns=["depth", "prefix", "shard_bytes", "root"])

    return run


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell, depth, prefix, shard_bytes: for each cell (of ``high`` bits) its shortest prefix of at least ``low`` bits within the limit."""
    found, level, depth = None, cells.select("cell", "n_bytes"), high
    while True:
        top = max(low, depth - FOLD)

        step = level.groupBy(F.shiftright("cell", depth - top)).applyInPandas(_folder(depth, top, low, limit), "depth int, prefix long, shard_bytes long, root boolean")
        step = materialize(step, "fold")
        own = step.where(F.lit(True) if top == low else ~F.col("root")).where(F.col("shard_bytes") <= limit).drop("root")
        found = own if found is None else found.unionByName(own)
        if top == low:
            break
        # a root over the limit stays in the next round, to say that its ancestors are over it as well
        level, depth = step.where("root").select(F.col("prefix").alias("cell"), F.col("shard_bytes").alias("n_bytes")), top
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]  # at most HASH_BITS
    up = cells.select("cell", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]).cast("array<int>")).alias("depth"))
    up = up.withColumn("prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    return up.join(found, ["depth", "prefix"]).select("cell", "depth", "prefix", "shard_bytes")


def directory(rows: DataFrame, limit: int = LIMIT) -> list[tuple[int, DataFrame]]:
    """Levels (bits of the cells, leaves of the cells) for ``rows`` of _h and _bytes; later levels hold what was too full before."""
    total = rows.agg(F.sum("_bytes")).head()[0] or 0
    low, high = 0, min(HASH_BITS, math.ceil(math.log2(max(1.0, total / limit))) + FINER)
    levels = []
    while True:
        cells = materialize(rows.groupBy(_cell(high).alias("cell")).agg(F.sum("_bytes").alias("n_bytes")), "cells")
        levels.append((high, materialize(_leaves(cells, low, high, limit), "directory")))
        over = cells.where(F.col("n_bytes") > limit)
        if high == HASH_BITS or over.isEmpty():
            return levels
        if over.count() <= BROADCAST_CELLS:
            over = F.broadcast(over)
        else:  # a hash that repeats is one row in the shuffle
            rows = rows.groupBy("_h").agg(F.sum("_bytes").alias("_bytes"))
        rows = rows.withColumn("cell", _cell(high)).join(over, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(HASH_BITS, high + MORE_BITS)


def shard_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All columns of ``docs`` in ``doc`` (struct), and shard (its prefix bits; numbered parts of one hash after a dot), depth, doc_bytes, shard_bytes.

    ``shard_bytes`` is at most ``limit`` except for a single document that is larger. A null
    text has 0 bytes. Every row gets a shard; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select(F.struct("*").alias("doc"), id_hash().alias("_h"), size.alias("doc_bytes"))
    levels = directory(rows.select("_h", F.col("doc_bytes").alias("_bytes")), limit)
    leaf = F.lit(None).cast("struct<depth:int,prefix:bigint,shard_bytes:bigint>")
    for i, (high, leaves) in enumerate(levels):
        side = leaves.select(F.col("cell").alias(f"_c{i}"), F.struct("depth", "prefix", "shard_bytes").alias(f"_l{i}"))
        side = F.broadcast(side) if leaves.count() <= BROADCAST_CELLS else side
        rows = rows.join(side, _cell(high) == F.col(f"_c{i}"), "left")
        leaf = F.coalesce(leaf, F.col(f"_l{i}"))
    rows = rows.select("doc", "_h", "doc_bytes", leaf.alias("_leaf"))
    bits = F.when(F.col("_leaf.depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("_leaf.prefix"), F.col("_leaf.depth"), "0"))
    fit = rows.where(F.col("_leaf").isNotNull()).select("doc", bits.alias("shard"), "_leaf.depth", "doc_bytes", "_leaf.shard_bytes")
    if levels[-1][0] < HASH_BITS:
        return fit
    return fit.unionByName(_parts(rows.where(F.col("_leaf").isNull()).select("doc", "_h", "doc_bytes"), limit))


def _parts(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of hashes that alone exceed the limit, cut by the running bytes of their contents, so that the cut depends on the rows alone.

    Rows that are wholly alike are counted first. The different ones of a hash are
    dealt out, by a hash of their contents, to lanes of some ``LANE_LIMITS`` limits each,
    and put in order there. Rows that start within one half-limit step of the running bytes, each of
    at most half the limit, stay within the limit together; a larger row stands alone.
    """
    rows = rows.withColumn("_key", F.sha2(F.to_json("doc"), 256))
    rows = rows.groupBy("_h", "_key").agg(F.first("doc").alias("doc"), F.first("doc_bytes").alias("doc_bytes"), F.count("*").alias("_n"))
    rows = materialize(rows, "overfull")
    lanes = rows.groupBy("_h").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.col("doc_bytes") * F.col("_n")) / (limit * LANE_LIMITS))).cast("int").alias("_lanes"), F.count("*").alias("_rows"))
    lanes = materialize(lanes, "lanes")
    rows = join_hot(rows, lanes, "_h", "_rows", lanes.agg(F.sum("_rows")).head()[0] or 0, ["_lanes"])
    rows = rows.withColumn("_lane", F.pmod(F.xxhash64("_key"), F.col("_lanes")))
    order = W.partitionBy("_h", "_lane").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    large, half = F.col("doc_bytes") * 2 > limit, max(1, limit // 2)
    size = F.when(large, 0).otherwise(F.col("doc_bytes"))
    before = lambda x: F.coalesce(F.sum(x).over(order), F.lit(0))
    rows = rows.withColumns({"_size": size, "_from": before(size * F.col("_n")), "_alone": before(F.when(large, F.col("_n")).otherwise(0)), "_large": large})
    # a row's copies over the parts where they start: those of part q are number ceil((q * half - from) / size) and on
    last = F.when(F.col("_large"), F.col("_alone") + F.col("_n") - 1).otherwise(F.floor((F.col("_from") + (F.col("_n") - 1) * F.col("_size")) / half))
    first = F.when(F.col("_large"), F.col("_alone")).otherwise(F.floor(F.col("_from") / half))
    rows = rows.withColumn("_q", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    upto = lambda q: F.least(F.col("_n"), F.greatest(F.lit(0), F.ceil((q * half - F.col("_from")) / F.greatest(F.lit(1), F.col("_size")))))
    copies = F.when(F.col("_large"), 1).when(F.col("_size") == 0, F.col("_n")).otherwise(upto(F.col("_q") + 1) - upto(F.col("_q")))
    rows = rows.withColumn("_copies", copies.cast("long")).where("_copies > 0")
    part = F.concat(F.when(F.col("_large"), "x").otherwise(""), F.col("_q").cast("string"))
    rows = rows.withColumn("shard", F.concat_ws(".", F.lpad(F.bin("_h"), HASH_BITS, "0"), F.col("_lane").cast("string"), part))
    total = F.sum(F.col("doc_bytes") * F.col("_copies")).over(W.partitionBy("shard"))
    rows = rows.select("doc", "shard", F.lit(HASH_BITS).alias("depth"), "doc_bytes", total.alias("shard_bytes"), "_copies")
    return rows.withColumn("_i", F.explode(F.expr("sequence(1L, _copies)"))).drop("_copies", "_i")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """One folder per shard with its documents."""
    sharded.select("doc.*", "shard").repartition("shard").write.partitionBy("shard").parquet(folder)


#: The same rows in DuckDB for tables without repeated ids.
ORACLE = f"""
WITH docs AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS doc_bytes,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents
), up AS (
  SELECT doc_id, doc_bytes, CAST(depth AS INTEGER) AS depth, h >> CAST(60 - depth AS INTEGER) AS prefix
  FROM docs, (SELECT unnest(range(0, 25)) AS depth) d
), sums AS (
  SELECT depth, prefix, sum(doc_bytes) AS shard_bytes FROM up GROUP BY depth, prefix HAVING sum(doc_bytes) <= {LIMIT}
), placed AS (
  SELECT doc_id, doc_bytes, depth, prefix, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS rank
  FROM up JOIN sums USING (depth, prefix)
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth,
       CAST(doc_bytes AS BIGINT) AS doc_bytes, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM placed WHERE rank = 1
"""
