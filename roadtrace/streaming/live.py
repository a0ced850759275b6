"""Live devices: fix health, outages, fusion filter, mounting and trails, with state and event-time timers per device.

Rows wait in the state until the watermark has passed them, so fixes and samples may
arrive in any order within it, and the stream says what the batch says of the
same rows (``devices.gnss_health``, ``devices.outages``). A timer at the last fix plus
``stale`` seconds says that a device has lost its fix although nothing arrives from it.

The session needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from roadtrace.streaming.devices import CARRY, FILTERED, GOOD_M, MOUNTING, STALE_S, TRAIL, WORST_M, align_step, filter_step, spaced_in_time, thin_rows

WATCHED = "event string, t double, id long, health string, last_fix double, `start` double, `end` double, seconds double, distance double"
_NAMES = [c.split(" ")[0].strip("`") for c in WATCHED.split(", ")]
_PENDING = "fix boolean, t double, id long, speed double, accuracy double, accepted boolean"
#: Last fix and its accuracy, whether it has become stale, last accepted fix, last sample, metres since the outage began, samples in it that were told of (-1: not told of), next timer.
_STATE = "fix_t double, accuracy double, told boolean, ok_t double, sample_t double, distance double, dark long, wake long"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def watch(rows: pd.DataFrame, state: dict, until: float, stale: float = STALE_S, good: float = GOOD_M, worst: float = WORST_M) -> tuple[pd.DataFrame, dict]:
    """What is to say of a device's ``rows`` (all that is known up to the time ``until``) after ``state``, and the state behind them.

    Each sample has the health of the latest fix at or before it. ``denied``: a usable fix
    has become ``stale`` seconds old. ``open`` and ``closed``: outages between accepted
    fixes; an open one is told again when samples in it have come. Rows without a time are skipped;
    a sample without a speed adds no distance; a null accuracy is denied.
    """
    rows = rows[rows["t"].notna()].sort_values(["t", "fix"], ascending=[True, False], kind="stable")
    is_fix = rows["fix"].to_numpy(bool)
    fixes, samples = rows[is_fix], rows[~is_fix]
    t = samples["t"].to_numpy(float)
    some = lambda name: np.array([] if state.get(name) is None else [state[name]], float)
    out = []

    def say(event: str, **columns) -> None:
        out.append(pd.DataFrame({"event": event} | {c: columns.get(c) for c in _NAMES[1:]}, index=range(len(next(iter(columns.values()))))))

    known = np.concatenate([some("fix_t"), fixes["t"].to_numpy(float)])
    accuracy = np.concatenate([np.full(len(some("fix_t")), np.nan if state.get("accuracy") is None else state["accuracy"]), fixes["accuracy"].to_numpy(float, na_value=np.nan)])
    if len(t):
        at = np.searchsorted(known, t, "right") - 1
        acc = np.where(at >= 0, np.append(accuracy, np.nan)[at], np.nan)
        age = t - np.append(known, np.nan)[at]
        health = np.select([(at < 0) | np.isnan(acc) | (age > stale) | (acc > worst), acc <= good], ["denied", "good"], "degraded")
        say("sample", t=t, id=samples["id"].to_numpy(), health=health, last_fix=np.where(at >= 0, np.append(known, np.nan)[at], np.nan))
    old = np.append(known[1:], max(until, known[-1])) - known > stale if len(known) else np.zeros(0, bool)
    lost, told = old & (accuracy <= worst), bool(len(old) and old[-1])
    if len(some("fix_t")) and state.get("told"):
        lost[0] = False
    if lost.any():
        say("denied", t=known[lost] + stale, health="denied", last_fix=known[lost])

    ok = np.concatenate([some("ok_t"), fixes.loc[fixes["accepted"].to_numpy(bool), "t"].to_numpy(float)])
    distance, dark_n = 0.0, -1
    if len(ok):
        at = np.searchsorted(ok, t, "right") - 1
        dark = (at >= 0) & (t > np.append(ok, np.nan)[at] + stale)
        step = np.diff(t, prepend=some("sample_t") if len(some("sample_t")) else t[:1])
        metres = np.bincount(at[dark], np.nan_to_num(samples["speed"].to_numpy(float, na_value=np.nan)[dark] * step[dark]), len(ok))
        count = np.bincount(at[dark], minlength=len(ok))
        if len(some("ok_t")):
            metres[0] += state.get("distance") or 0.0
        closed = np.flatnonzero(np.diff(ok) > stale)
        if len(closed):
            start = ok[closed] + stale
            say("closed", t=ok[closed + 1], last_fix=ok[closed], start=start, end=ok[closed + 1], seconds=ok[closed + 1] - start, distance=metres[closed])
        before = state.get("dark") if len(ok) == 1 and len(some("ok_t")) and state.get("dark") is not None else -1
        dark_n, distance = before, float(metres[-1])
        begin = ok[-1] + stale
        if until > begin or count[-1]:
            dark_n = max(before, 0) + int(count[-1])
            if before < 0 or count[-1]:
                last = float(t[-1]) if len(t) else float(some("sample_t")[0]) if len(some("sample_t")) else begin
                say("open", t=[max(begin, last)], last_fix=[ok[-1]], start=[begin], seconds=[max(0.0, last - begin)], distance=[distance])
    new = {
        "fix_t": float(known[-1]) if len(known) else None, "accuracy": None if not len(known) or math.isnan(accuracy[-1]) else float(accuracy[-1]), "told": told,
        "ok_t": float(ok[-1]) if len(ok) else None, "sample_t": float(t[-1]) if len(t) else state.get("sample_t"), "distance": distance, "dark": dark_n,
    }
    if not out:
        return pd.DataFrame(columns=_NAMES), new
    return pd.DataFrame({c: np.concatenate([x[c].to_numpy(object) for x in out]) for c in _NAMES}), new


class FixWatch(StatefulProcessor):
    """``watch`` for each device, woken by a timer at its earliest waiting row or at the time when its last fix becomes stale."""

    def __init__(self, device: str, limits: dict):
        self.device, self.limits = device, limits

    def init(self, handle) -> None:
        self.handle = handle
        self.state, self.pending = handle.getValueState("state", _STATE), handle.getListState("pending", _PENDING)

    def _load(self) -> dict:
        return dict(zip([c.split(" ")[0] for c in _STATE.split(", ")], self.state.get(), strict=True)) if self.state.exists() else {}

    def _store(self, state: dict, times: list[float]) -> None:
        """Keep the state and set the timer to the next time at which there is something to say."""
        stale = self.limits["stale"]
        if state.get("fix_t") is not None and not state.get("told"):
            times = [*times, state["fix_t"] + stale]
        if state.get("ok_t") is not None and state.get("dark", -1) == -1:
            times = [*times, state["ok_t"] + stale]
        wake = math.floor(min(times) * 1000) + 1 if times else None
        if wake != state.get("wake"):
            if state.get("wake") is not None:
                self.handle.deleteTimer(state["wake"])
            if wake is not None:
                self.handle.registerTimer(wake)
        names = [c.split(" ")[0] for c in _STATE.split(", ")]
        self.state.update(tuple((state | {"wake": wake}).get(n) for n in names))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        frame = pd.concat(list(rows))
        frame = frame[(frame["t"] > watermark) | (watermark <= 0)]  # what is older has been told of without it
        if len(frame):
            plain = frame[[c.split(" ")[0] for c in _PENDING.split(", ")]].astype(object)
            self.pending.appendList([tuple(r) for r in plain.where(plain.notna(), None).itertuples(index=False)])
            state = self._load()
            wake = state.get("wake")
            self._store(state, [float(frame["t"].min()), *([] if wake is None else [(wake - 1) / 1000])])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        rows = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=[c.split(" ")[0] for c in _PENDING.split(", ")])
        due = rows["t"].astype(float) <= until
        told, state = watch(rows[due], self._load(), until, **self.limits)
        if due.any():
            self.pending.put([tuple(r) for r in rows[~due].itertuples(index=False)]) if not due.all() else self.pending.clear()
        self._store(state, rows.loc[~due, "t"].tolist())
        if len(told):
            told.insert(0, self.device, key[0])
            yield told

    def close(self) -> None:
        pass


def watch_fixes(rows: DataFrame, device: str, ts: str, watermark: str = "10 seconds", stale: float = STALE_S, good: float = GOOD_M, worst: float = WORST_M) -> DataFrame:
    """Events of each device of a stream: ``sample`` (health of each sample), ``denied`` (a fix became stale), ``open`` and ``closed`` outages.

    ``rows``: kind (``fix``, else a sample), t (seconds; ``ts`` is the same time as a timestamp), id, speed,
    accuracy, accepted (null: yes). Rows later than the watermark are left out. An open
    outage is told of when it opens and again with new samples in it; its last row counts.
    """
    use_rocksdb(rows.sparkSession)
    own = rows.select(device, ts, (F.col("kind") == "fix").alias("fix"), F.col("t").cast("double"), F.col("id").cast("long"), F.col("speed").cast("double"), F.col("accuracy").cast("double"), F.coalesce("accepted", F.lit(True)).alias("accepted"))
    own = own.where(F.col("t").isNotNull()).withWatermark(ts, watermark)
    limits = {"stale": stale, "good": good, "worst": worst}
    schema = f"`{device}` {dict(rows.dtypes)[device]}, {WATCHED}"
    return own.groupBy(device).transformWithStateInPandas(FixWatch(device, limits), schema, "update", "EventTime")


def gnss_health_stream(rows: DataFrame, device: str, ts: str, **limits) -> DataFrame:
    """Health of each sample, and a row without an id for each fix that became stale."""
    return watch_fixes(rows, device, ts, **limits).where("event in ('sample', 'denied')").select(device, "t", "id", "health", "last_fix")


def outages_stream(rows: DataFrame, device: str, ts: str, **limits) -> DataFrame:
    """Outages as they open and close."""
    return watch_fixes(rows, device, ts, **limits).where("event in ('open', 'closed')").select(device, "event", "last_fix", "start", "end", "seconds", "distance")


class InOrder(StatefulProcessor):
    """Rows wait until the watermark has passed them; then ``step(frame, carry)`` takes them in order of time, and its carry, of typed fields, goes on with the device."""

    def __init__(self, device: str, step, carry: str, pending: str):
        self.device, self.step, self.carry, self.waiting = device, step, carry, pending

    def init(self, handle) -> None:
        self.handle = handle
        self.state, self.pending, self.wake = handle.getValueState("carry", self.carry), handle.getListState("pending", self.waiting), handle.getValueState("wake", "at long")

    @staticmethod
    def _names(schema: str) -> list[str]:
        return [c.split(" ")[0] for c in schema.split(", ")]

    def _wake_at(self, t: float) -> None:
        at, old = math.floor(t * 1000) + 1, self.wake.get()[0] if self.wake.exists() else None
        if old is None or at < old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        frame = pd.concat(list(rows))
        frame = frame[(frame["t"] > watermark) | (watermark <= 0)]
        if len(frame):
            plain = frame[self._names(self.waiting)].astype(object)
            self.pending.appendList([tuple(r) for r in plain.where(plain.notna(), None).itertuples(index=False)])
            self._wake_at(float(frame["t"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() / 1000
        rows = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=self._names(self.waiting))
        due = rows["t"].astype(float) <= until
        self.wake.clear()
        if due.all():
            self.pending.clear()
        else:
            rest = rows[~due]
            self.pending.put([tuple(r) for r in rest.astype(object).where(rest.notna(), None).itertuples(index=False)])
            self._wake_at(float(rest["t"].min()))
        if due.any():
            names = self._names(self.carry)
            carry = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else None
            out, carry = self.step(rows[due].sort_values("t", kind="stable", ignore_index=True), carry)
            self.state.update(tuple(carry.get(c) for c in names))
            if len(out):
                out = out.copy()
                out.insert(0, self.device, key[0])
                yield out

    def close(self) -> None:
        pass


def in_order_stream(rows: DataFrame, device: str, ts: str, columns: str, step, carry: str, out: str, watermark: str = "10 seconds") -> DataFrame:
    """``step`` over a stream's devices: ``columns`` (DDL, with t in seconds) are what it takes, ``carry`` what it hands on, ``out`` what it gives."""
    use_rocksdb(rows.sparkSession)
    names = [c.split(" ")[0] for c in columns.split(", ")]
    own = rows.select(device, ts, *[F.col(c) for c in names]).where(F.col("t").isNotNull()).withWatermark(ts, watermark)
    schema = f"`{device}` {dict(rows.dtypes)[device]}, {out}"
    return own.groupBy(device).transformWithStateInPandas(InOrder(device, step, carry, columns), schema, "append", "EventTime")


_IMU = "t double, ax double, ay double, az double, gx double, gy double, gz double, speed double"


def alignment_stream(rows: DataFrame, device: str, ts: str, watermark: str = "10 seconds", **limits) -> DataFrame:
    """``devices.alignment_states`` of a stream of t, ax, ay, az, gx, gy, gz and speed: device, t, state and forward axis of each row."""
    step = align_step(["t"], ("ax", "ay", "az"), ("gx", "gy", "gz"), "speed", limits)
    return in_order_stream(rows, device, ts, _IMU, step, MOUNTING, "t double, state string, axis array<double>", watermark)


def trail_step(spacing: float, every: float, n_fixes: int):
    """Per row whether it is a new point of the trail and whether it is emitted; per fix the last ``n_fixes`` ones."""

    def step(f: pd.DataFrame, carry: dict | None):
        carry = carry or {"e": None, "n": None, "t": None, "fixes": []}
        e, n, t = (f[c].to_numpy(float, na_value=np.nan) for c in ("e", "n", "t"))
        fix = f["fix"].to_numpy(bool)
        shown = np.flatnonzero(~fix)
        kept = shown[thin_rows(e[shown], n[shown], spacing, None if carry["e"] is None else (carry["e"], carry["n"]))]
        sent = shown[spaced_in_time(t[shown], every, carry["t"])]
        fixes = np.concatenate([np.array(carry["fixes"], float).reshape(-1, 3), np.stack([t, e, n], axis=1)[fix]])[-n_fixes:]
        out = f[["t", "e", "n"]].assign(kept=np.isin(np.arange(len(f)), kept), emitted=np.isin(np.arange(len(f)), sent), fixes=None)
        told = np.concatenate([kept, sent])
        if fix.any():
            last = int(np.flatnonzero(fix)[-1])
            out.at[last, "fixes"] = [float(x) for x in fixes.ravel()]
            told = np.append(told, last)
        new = {"e": float(e[kept[-1]]) if len(kept) else carry["e"], "n": float(n[kept[-1]]) if len(kept) else carry["n"], "t": float(t[sent[-1]]) if len(sent) else carry["t"], "fixes": [float(x) for x in fixes.ravel()]}
        return out.iloc[np.unique(told)], new

    return step


def trail_stream(rows: DataFrame, device: str, ts: str, watermark: str = "10 seconds", spacing: float = 3.0, every: float = 0.1, n_fixes: int = 90) -> DataFrame:
    """Of a stream of t, e, n and fix (true: a fix, else a place to show): rows that are kept in the trail (``spacing`` metres from the last kept one), emitted (``every`` seconds after the last emitted one), or bring the last ``n_fixes`` fixes (t, e, n of each, newest last)."""
    return in_order_stream(rows, device, ts, "t double, e double, n double, fix boolean", trail_step(spacing, every, n_fixes), TRAIL, "t double, e double, n double, kept boolean, emitted boolean, fixes array<double>", watermark)


_FILTER = "kind string, t double, omega double, accel double, e double, n double, speed double, course double, sigma double, stationary boolean"


def fusion_filter_stream(rows: DataFrame, device: str, ts: str, watermark: str = "10 seconds") -> DataFrame:
    """``devices.fusion_filter`` of a stream: its rows for each device, whatever the order of arrival within the watermark.

    ``rows``: kind, t, omega, accel, e, n, speed, course, sigma, and stationary if it is known.
    Rows later than the watermark and rows without a time are left out. An idle device's
    waiting rows are filtered by their timer.
    """
    own = rows if "stationary" in rows.columns else rows.withColumn("stationary", F.lit(None).cast("boolean"))
    return in_order_stream(own, device, ts, _FILTER, filter_step, CARRY, FILTERED, watermark)
