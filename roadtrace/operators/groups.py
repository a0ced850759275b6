"""Contiguous groups inside a sorted partition, for small groups that share a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One shuffle by ``keys``; each partition sorted, so that a group's rows follow one another."""
    return df.repartition(*keys).sortWithinPartitions(*keys, order)


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """One shuffle by ``keys`` into a number of partitions of its own: many small groups are few bytes, but long work, and are not to be put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def frames(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """One frame per group of a clustered partition; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.ones(len(batch), bool)
        new[1:] = (batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
            part = batch.iloc[a:b]
            if held and (held[-1][keys].iloc[-1].to_numpy() != part[keys].iloc[0].to_numpy()).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def apart_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``apart`` with each partition sorted, so that a group's rows follow one another (without an order at its end); for ``whole_groups``."""
    return apart(df, keys).sortWithinPartitions(*keys, F.col(order).asc_nulls_last())


def starts_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """First rows of the groups in an Arrow batch of a clustered partition; row 0 is one whether or not the last batch's group goes on."""
    if batch.num_rows == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Arrow batches of whole groups of a clustered partition, many small groups at once, and the places where they begin and the last ends."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = joined(parts)
        return batch, np.append(starts_of(batch, keys), batch.num_rows)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(starts_of(batch, keys)[-1])
        goes_on = held and len(starts_of(joined([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)) == 1
        if last == 0 and goes_on:
            held.append(batch)
            continue
        if done := [*held, *([batch.slice(0, last)] if last else [])]:
            yield out(done)
        held = [batch.slice(last)]
    if held:
        yield out(held)


def doubles(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns of doubles as an array [column, row]; null is NaN."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def of_groups(batch: pa.RecordBatch, keys: list[str], at, values: dict[str, pa.Array]) -> pa.RecordBatch:
    """The keys of the rows ``at``, with ``values``."""
    at = pa.array(np.asarray(at, np.int64))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *values.values()], [*keys, *values])


def key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)
