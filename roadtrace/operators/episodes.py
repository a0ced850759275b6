"""Simulated blackouts by time and by distance."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.operators.groups import apart_in_order, doubles, of_groups, whole_groups


def time_blackouts(segments: DataFrame, durations: list[int], history: int, rows_per_second: int = 10) -> DataFrame:
    """Non-overlapping blackouts of each duration (seconds) in every segment: start and end positions in the segment.

    Only starts and ends are made here; samples are joined later.
    """
    d = segments.withColumn("duration", F.explode(F.array(*[F.lit(x) for x in durations])))
    d = d.withColumn("_len", F.col("duration") * rows_per_second).withColumn("_last", F.col("rows") - F.col("_len") - 1)
    d = d.where(F.col("_last") >= history).withColumn("start", F.explode(F.sequence(F.lit(history).cast("bigint"), F.col("_last"), F.col("_len").cast("bigint"))))
    return d.withColumn("end", F.col("start") + F.col("_len")).drop("_len", "_last")


def strided_examples(segments: DataFrame, durations: list[int], context: int, bias: int, stride: int, rows_per_second: int = 10) -> DataFrame:
    """Overlapping examples every ``stride`` rows from bias + context on; start and length."""
    d = segments.withColumn("duration", F.explode(F.array(*[F.lit(x) for x in durations])))
    d = d.withColumn("length", F.col("duration") * rows_per_second).withColumn("_last", F.col("rows") - F.col("length"))
    d = d.where(F.col("_last") >= bias + context)
    return d.withColumn("start", F.explode(F.sequence(F.lit(bias + context).cast("bigint"), F.col("_last"), F.lit(stride).cast("bigint")))).drop("_last")


#: Rows of a drive that one task scans, besides the rows it looks back and ahead (rounded up to whole spans).
BLOCK = 50_000
#: Rows of a run: distances are sums over runs, runs of runs and so on from the start of a drive.
RUN = 16


def _runs(x: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``x``, each from its first value on; the last is filled up with zeros."""
    return np.cumsum(np.concatenate([x, np.zeros(-len(x) % RUN)]).reshape(-1, RUN), axis=1)[:, -1]


def _sums_before(x: np.ndarray, start: np.ndarray, span: int) -> np.ndarray:
    """Sum of all values before each of ``x`` and behind the last; ``start`` has that of each ``span`` (a power of ``RUN``) of values, and of the next.

    The longest runs are added first, so a place has the same sum to the last bit wherever its drive is cut.
    """
    levels = [np.concatenate([x, np.zeros(len(start) * span - len(x))])]
    while span > RUN:
        levels.append(_runs(levels[-1]))
        span //= RUN
    before = start
    for nodes in reversed(levels):
        before = np.cumsum(np.concatenate([before[:, None], nodes.reshape(-1, RUN)], axis=1), axis=1)[:, :RUN].ravel()
    return before[: len(x) + 1]


def _positions(df: DataFrame, keys: list[str], order: str, speed: str, extra: list[str]) -> DataFrame:
    """Rows with a speed, with _pos (0, 1, ... in the order of their drive) and _n (rows of the drive).

    ``order`` is a number; rows are counted in pieces of a drive, and only the pieces' counts of a drive meet.
    """
    rows = df.where(F.col(speed).isNotNull() & ~F.isnan(F.col(speed).cast("double"))).select(*keys, F.col(order).alias("_order"), F.col(speed).cast("double").alias("_v"), *extra)
    rows = rows.withColumn("_piece", F.floor(F.col("_order") / BLOCK))
    counts = rows.groupBy(*keys, "_piece").agg(F.count("*").alias("_rows"))
    drive = W.partitionBy(*keys)
    before = F.coalesce(F.sum("_rows").over(drive.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_piece").alias("_p"), before.alias("_before"), F.sum("_rows").over(drive).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(counts, [*same, F.col("_piece") == F.col("_p")])
    rank = F.row_number().over(W.partitionBy(*keys, "_piece").orderBy("_order"))
    return joined.select(*keys, "_order", "_v", *extra, (F.col("_before") + rank - 1).cast("long").alias("_pos"), F.col("_n").cast("long").alias("_n"))


def _in_blocks(rows: DataFrame, block: int, before: int, after: int) -> DataFrame:
    """Each row to the block of its position, and to those that look back ``before`` or ahead ``after`` rows as far as it."""
    last = F.expr(f"(_n - 1) div {block}")
    first, final = F.greatest(F.lit(0), F.floor((F.col("_pos") - after) / block)), F.least(last, F.floor((F.col("_pos") + before) / block))
    return rows.withColumn("_block", F.explode(F.sequence(first.cast("long"), final.cast("long"))))


class _Chain:
    """The rule of a greedy scan: a row's end, whether it is taken, and the row looked at next.

    Everything follows from at most ``reach`` rows ahead and ``history`` rows back, so a
    block with that much of its neighbours knows its rows' successors. A frame ``f`` is a block's columns as arrays.
    """

    def __init__(self, distances: list[float], history: int, rate: float, min_speed: float, step: int | None, retry: int, tail: int, min_rows: int, min_history: float):
        if min_speed <= 0:
            raise ValueError("min_speed bounds the length of a blackout and must be positive")
        self.distances, self.history, self.rate, self.min_speed, self.step, self.retry, self.tail, self.min_rows, self.min_history = distances, history, rate, min_speed, step, retry, tail, min_rows, min_history
        self.reach = math.ceil(2 * max(distances) * rate / min_speed) + 2
        #: No row's successor is further away; so the first such rows of a block are its only ways in.
        self.jump = max(self.reach, retry, step or 0, history + 1)
        least = max(BLOCK, 4 * self.jump)
        self.span = RUN
        while self.span * RUN <= least:
            self.span *= RUN
        self.block = -(-least // self.span) * self.span

    def successors(self, f: dict[str, np.ndarray], distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End, taken and next place (all within the frame) of each row of a block in order."""
        v, pos, n = f["_v"], f["_pos"], int(f["_n"][0])
        at = np.arange(len(v))
        end, covered = at.copy(), np.zeros(len(v))
        # rows from before the block are history only
        own = int(np.searchsorted(pos, int(f["_block"][0]) * self.block))
        step, head = v[own:] / self.rate, slice(own, None, self.span)
        cum = _sums_before(step, np.append(f["_from"][head], f["_to"][-1:]), self.span)[1:]
        # sums of runs and of rows are rounded differently, so the sum may shrink by a last bit where the car stands
        end[own:] = own + np.searchsorted(np.maximum.accumulate(cum), cum + distance)
        covered[own:] = cum[np.maximum(end[own:] - own - 1, 0)] - cum + step
        length = end - at
        moving = np.ones(len(v), bool)
        if self.history:
            moving[:] = False
            if len(v) > self.history:
                moving[self.history :] = np.lib.stride_tricks.sliding_window_view(v, self.history)[: len(v) - self.history].min(axis=1) >= self.min_history
        fast = covered * self.rate / np.maximum(length, 1) >= self.min_speed
        ok = (end < len(v)) & (pos + length < n - self.tail) & (length >= self.min_rows) & (length <= self.reach) & fast & moving & (pos >= self.history) & (pos < n - 5)
        return end, ok, np.where(ok, end if self.step is None else at + self.step, at + self.retry)

    def bounds(self, f: dict[str, np.ndarray]) -> tuple[int, int, int]:
        """Place of the block's first row in its frame, and the places from which a scan leaves the block or the drive."""
        pos, b, n = f["_pos"], int(f["_block"][0]), int(f["_n"][0])
        first, stop = np.searchsorted(pos, [b * self.block, min((b + 1) * self.block, max(n - 5, 0))])
        return int(first), int(stop), int(pos[0])

    def ways(self, f: dict[str, np.ndarray]) -> list[np.ndarray]:
        """For each distance: where scans that enter at the first ``jump`` rows of the block leave it, as positions (-1: the drive ends)."""
        first, stop, at0 = self.bounds(f)
        n, out = int(f["_n"][0]), []
        for distance in self.distances:
            _, _, nxt = self.successors(f, distance)
            to = np.arange(first, max(stop, first) + self.jump + 1) - first
            inside = max(stop - first, 0)
            to[:inside] = nxt[first : first + inside] - first
            while (to[:inside] < inside).any():  # pointer doubling: all paths at once
                to[:inside] = to[to[:inside]]
            left = to[: min(self.jump, inside)] + first + at0
            out.append(np.where(left >= n - 5, -1, left))
        return out

    def taken(self, f: dict[str, np.ndarray], distance: float, entry: int) -> list[tuple[int, int]]:
        """Places of the blackouts of the scan that enters the block at position ``entry``."""
        _, stop, at0 = self.bounds(f)
        end, ok, nxt = self.successors(f, distance)
        s, out = entry - at0, []
        while s < stop:
            if ok[s]:
                out.append((s, int(end[s])))
            s = int(nxt[s])
        return out


def _with_starts(rows: DataFrame, keys: list[str], chain: _Chain) -> DataFrame:
    """Add the distances before each row's span and before the next one (_from, _to); only drives of several spans are summed for it."""
    types = dict(rows.dtypes)
    k = ", ".join(f"`{x}` {types[x]}" for x in keys)

    def totals(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_pos", ignore_index=True)
        x, size = f["_v"].to_numpy() / chain.rate, 1
        while size < chain.span:
            x, size = _runs(x), size * RUN
        out = pd.DataFrame({"_span": f["_pos"].iloc[0] // chain.span + np.arange(len(x)), "_total": x})
        for key in keys:
            out[key] = f[key].iloc[0]
        return out[[*keys, "_span", "_total"]]

    def starts(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_span", ignore_index=True)
        size = RUN
        while size <= len(f):
            size *= RUN
        before = _sums_before(f["_total"].to_numpy(), np.zeros(1), size)
        return f[[*keys, "_span"]].assign(_from=before[:-1], _to=before[1:])

    several = rows.where(F.col("_n") >= chain.span).select(*keys, "_pos", "_v", F.expr(f"_pos div {chain.block}").alias("_b"))
    sums = several.groupBy(*keys, "_b").applyInPandas(totals, f"{k}, _span long, _total double")
    found = sums.groupBy(*keys).applyInPandas(starts, f"{k}, _span long, _from double, _to double")
    found = found.select(*[F.col(x).alias(f"_key_{x}") for x in keys], "_span", "_from", "_to")
    same = [F.col(x).eqNullSafe(F.col(f"_key_{x}")) for x in keys]
    joined = rows.join(found, [*same, F.expr(f"_pos div {chain.span}") == F.col("_span")], "left")
    return joined.select(*rows.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("_from", "_to")])


def _greedy(df: DataFrame, keys: list[str], speed: str, order: str, chain: _Chain, extra: list[str], values) -> DataFrame:
    """keys, distance_m, start, end (values of ``order``; the end's row is the first behind) and ``values`` (of a frame and places) of what the scan of each drive takes.

    A drive of less than a span of rows is scanned at once, many of them by one call. For the others: 1. Blocks of a drive, with their neighbours' rows as far as they matter, say for each
       way in where a scan would leave them. 2. Only these lists of a drive meet, in
       order, and give each block its entry. 3. Blocks scan from there.
    """
    types = dict(df.dtypes)
    k = ", ".join(f"`{x}` {types[x]}" for x in keys)
    schema = f"{k}, distance_m double, start long, `end` long, value double"
    rows = _positions(df, keys, order, speed, extra)
    short = apart_in_order(rows.where(F.col("_n") < chain.span).withColumn("_order", F.col("_order").cast("long")), keys, "_pos")

    def at_once(batches):
        for batch, at in whole_groups(batches, keys):
            own, found = dict(zip(["_v", *extra], doubles(batch, ["_v", *extra]), strict=True)) | {c: batch.column(c).to_numpy() for c in ("_pos", "_n")}, []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if chain.history < b - a - 5:
                    f = {c: x[a:b] for c, x in own.items()} | {"_block": np.zeros(1, np.int64), "_from": np.zeros(1), "_to": np.zeros(1)}
                    for distance in chain.distances:
                        found += [(a + s, distance, a + e, values(f, s, e)) for s, e in chain.taken(f, distance, chain.history)]
            starts, distances, ends, value = zip(*found, strict=True) if found else [()] * 4
            place = lambda at: batch.column("_order").take(pa.array(at, pa.int64()))  # noqa: B023, E731
            yield of_groups(batch, keys, starts, {"distance_m": pa.array(distances, pa.float64()), "start": place(starts), "end": place(ends), "value": pa.array(value, pa.float64(), from_pandas=True)})

    rows = _with_starts(rows.where(F.col("_n") >= chain.span), keys, chain)
    rows = _in_blocks(rows, chain.block, chain.history, chain.reach + max(chain.retry, chain.step or 0))
    rows = rows.repartition(*keys, "_block")

    def arrays(f: pd.DataFrame) -> dict[str, np.ndarray]:
        return {c: f[c].to_numpy() for c in f if c not in keys}

    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("_pos", ignore_index=True)
        own = pd.DataFrame({"_i": range(len(chain.distances)), "_left": [w.tolist() for w in chain.ways(arrays(f))]})
        for x in [*keys, "_block", "_n"]:
            own[x] = f[x].iloc[0]
        return own[[*keys, "_block", "_n", "_i", "_left"]]

    ways = rows.groupBy(*keys, "_block").applyInPandas(leave, f"{k}, _block long, _n long, _i int, _left array<long>")
    ordered = ways.repartition(*keys, "_i").sortWithinPartitions(*keys, "_i", "_block")

    def enter(batches):
        drive = entry = None
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                this = (*r[: len(keys)], r[len(keys) + 2])
                if this != drive:
                    drive, entry = this, chain.history
                block, n, left = r[len(keys)], r[len(keys) + 1], r[len(keys) + 3]
                inside = entry - block * chain.block
                if entry >= 0 and entry < n - 5 and 0 <= inside < len(left):
                    found.append((*r[: len(keys)], block, this[-1], entry))
                    entry = int(left[inside])
            yield pd.DataFrame(found, columns=[*keys, "_block", "_i", "_entry"])

    entries = ordered.mapInPandas(enter, f"{k}, _block long, _i int, _entry long")

    def scan(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(frame) and len(own):
            f = arrays(frame.sort_values("_pos", ignore_index=True))
            place = f["_order"]
            for i, entry in own[["_i", "_entry"]].itertuples(index=False):
                for s, e in chain.taken(f, chain.distances[i], entry):
                    found.append((chain.distances[i], place[s], place[e], values(f, s, e)))
        out = pd.DataFrame(found, columns=["distance_m", "start", "end", "value"])
        for x in keys:
            out[x] = frame[x].iloc[0] if len(frame) else None
        return out[[*keys, "distance_m", "start", "end", "value"]]

    long = rows.groupBy(*keys, "_block").cogroup(entries.groupBy(*keys, "_block")).applyInPandas(scan, schema)
    return short.mapInArrow(at_once, schema).unionByName(long)


def distance_blackouts(df: DataFrame, keys: list[str], speed: str, distances: list[float], history: int = 250, rate: float = 10.0, min_speed: float = 3.0, step_s: float = 5.0, tail: int = 0, min_rows: int = 5, min_history: float = 1.0, order: str = "row_idx") -> DataFrame:
    """Greedy blackouts of given lengths in metres: keys, distance_m, start and end (values of ``order``, the end behind the last row).

    The next start depends on whether the last was taken, so each drive is one chain
    of successors; it is followed in blocks of ``BLOCK`` rows, whatever its length. A
    blackout ends at the first row where the distance is reached; it is taken if
    it is long and fast enough and the car was moving for ``history`` rows before it.

    Rows without a speed (null or NaN) are no part of a drive: the chain goes on over
    them, and history and lengths count the others. Speeds are not negative. A blackout has at most
    2 x distance x rate / ``min_speed`` rows (slower ones fail ``min_speed`` anyway, unless one
    row alone covers the distance). Drives of at most ``history`` rows, and empty tables, have none.
    """
    chain = _Chain([float(x) for x in distances], history, rate, min_speed, None, max(1, int(rate * step_s)), tail, min_rows, min_history)
    return _greedy(df, keys, speed, order, chain, [], lambda f, s, e: 0.0).drop("value")


def straightest_segment(df: DataFrame, keys: list[str], speed: str, turn: str, distance: float, history: int = 250, rate: float = 10.0, min_speed: float = 3.0, step_s: float = 2.0, retry_s: float = 3.0, order: str = "row_idx") -> DataFrame:
    """Per drive the run of about ``distance`` metres with the least total turning (``turn``: cumulative absolute turning): keys, start, end, turning.

    Runs are tried every ``step_s`` seconds, ``retry_s`` after one that is too slow or cut
    off. Of runs that turn alike (to nine places) the earliest counts. Rows without a speed
    are no part of a drive, as in ``distance_blackouts``; a run at whose ends the turning is null is not taken.
    """
    chain = _Chain([float(distance)], history, rate, min_speed, max(1, int(rate * step_s)), max(1, int(rate * retry_s)), 0, 5, 1.0)

    def turning(f: dict[str, np.ndarray], s: int, e: int) -> float:
        return round(float(f["_turn"][e - 1] - f["_turn"][s]), 9)

    runs = _greedy(df.withColumn("_turn", F.col(turn).cast("double")), keys, speed, order, chain, ["_turn"], turning)
    best = F.min(F.struct(F.col("value").alias("turning"), "start", "end")).alias("best")
    return runs.where("value is not null and not isnan(value)").groupBy(*keys).agg(best).select(*keys, "best.start", "best.end", "best.turning")
