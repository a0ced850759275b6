"""Set operations on sessions, columns, splits and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def numbered(rows: DataFrame, drive: str, order: str) -> DataFrame:
    """Rows of many drives with ``local_index``, their place in their own drive from 0."""
    return rows.withColumn("local_index", (F.row_number().over(W.partitionBy(drive).orderBy(order)) - 1).cast("long"))


def union_sessions(sessions: dict[str, DataFrame], order: str) -> DataFrame:
    """All sessions under one another with drive_id and local_index."""
    parts = [df.withColumn("drive_id", F.lit(name)) for name, df in sorted(sessions.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out, "drive_id", order)


def overlap(features: DataFrame, reference: DataFrame) -> DataFrame:
    """Names in both lists; it must be empty."""
    return features.intersect(reference)


def missing(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required values that are absent."""
    return required.subtract(present)


def undirected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distinct edges whatever their direction; loops are dropped."""
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).dropDuplicates()
