"""Live device streams: windows, fix health, outages, recovery, and a fusion filter with state per device.

The numpy cores serve batch (grouped by session) and stream (grouped by device)
alike, so a replayed stream gives the batch result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo
from roadtrace.functions.geo import _c
from roadtrace.operators.joins import as_of

STALE_S, GOOD_M, WORST_M = 2.0, 20.0, 40.0


def fix_health(accuracy, age, stale: float = STALE_S, good: float = GOOD_M, worst: float = WORST_M):
    """denied without a fix, or one that is old or bad; good up to ``good`` metres; else degraded."""
    a, g = _c(accuracy), _c(age)
    return F.when(a.isNull() | g.isNull() | (g > stale) | (a > worst), "denied").when(a <= good, "good").otherwise("degraded")


def gnss_health(samples: DataFrame, fixes: DataFrame, keys: list[str], time: str, fix_time: str, accuracy: str, stale: float = STALE_S, good: float = GOOD_M, worst: float = WORST_M, tie: str | None = None) -> DataFrame:
    """Health of each sample from the latest fix at or before it."""
    return as_of(samples, fixes, keys, time, fix_time, [accuracy], tie).withColumn("health", fix_health(accuracy, "fix_age", stale, good, worst))


def outages(samples: DataFrame, fixes: DataFrame, keys: list[str], time: str, fix_time: str, speed: str, stale: float = STALE_S, rule: str = "after_stale") -> DataFrame:
    """Per gap between accepted fixes that is longer than ``stale``: start, end (NULL: still open), seconds and distance (speed times step).

    An outage starts ``stale`` seconds after the last fix (rule at_fix: at the fix).
    """
    w = W.partitionBy(*keys).orderBy(fix_time)
    gaps = fixes.select(*keys, _c(fix_time).alias("last_fix"), F.lead(fix_time).over(w).alias("end"))
    last = samples.groupBy(*keys).agg(F.max(time).alias("_last"))
    gaps = gaps.join(last, keys, "left").withColumn("_until", F.coalesce("end", "_last"))
    gaps = gaps.where(F.col("_until") - F.col("last_fix") > stale)
    gaps = gaps.withColumn("start", F.col("last_fix") + (stale if rule == "after_stale" else 0.0))
    s = samples.select(*keys, _c(time).alias("t"), _c(speed).alias("v"))
    s = s.withColumn("_dt", _c("t") - F.lag("t").over(W.partitionBy(*keys).orderBy("t")))
    held = as_of(s, gaps.select(*keys, "last_fix", "start", "end"), keys, "t", "last_fix", ["start", "end"])
    dark = held.where((F.col("t") > F.col("start")) & (F.col("end").isNull() | (F.col("t") < F.col("end"))))
    walked = dark.groupBy(*keys, F.col("fix_t").alias("last_fix")).agg(F.sum(F.col("v") * F.coalesce("_dt", F.lit(0.0))).alias("distance"))
    out = gaps.join(walked, [*keys, "last_fix"], "left")
    return out.select(*keys, "last_fix", "start", "end", (F.col("_until") - F.col("start")).alias("seconds"), F.coalesce("distance", F.lit(0.0)).alias("distance"))


def device_sessions(events: DataFrame, device: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Runs of a device's events without a pause longer than ``gap``; works on batches and streams."""
    e = events.withWatermark(ts, watermark) if watermark else events
    return e.groupBy(device, F.session_window(ts, gap)).agg(F.count("*").alias("events")).select(device, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def tumbling_means(events: DataFrame, device: str, ts: str, values: list[str], size: str = "1 second", watermark: str | None = None) -> DataFrame:
    """Mean of each value per device and time block."""
    e = events.withWatermark(ts, watermark) if watermark else events
    out = e.groupBy(device, F.window(ts, size)).agg(F.count("*").alias("n"), *[F.avg(v).alias(f"{v}_mean") for v in values])
    return out.select(device, F.col("window.start").alias("start"), "n", *[f"{v}_mean" for v in values])


def sliding_stats(events: DataFrame, device: str, ts: str, value: str, size: str = "2 seconds", slide: str = "100 milliseconds", watermark: str | None = None) -> DataFrame:
    """Mean and population variance over overlapping windows."""
    e = events.withWatermark(ts, watermark) if watermark else events
    out = e.groupBy(device, F.window(ts, size, slide)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    return out.select(device, F.col("window.start").alias("start"), "n", "mean", "variance")


# --- fusion filter

DIM = 6


FILTERED = "t double, kind string, east double, north double, heading double, speed double, gyro_bias double, accel_bias double, pos_sigma double, verdict string, outage_s double, outage_m double, error_m double, drift_percent double"


class FilterBank:
    """Extended Kalman filters of east, north, heading, speed, yaw-rate bias and acceleration bias, one for each of ``n`` sessions, which take their steps together."""

    GYRO, ACCEL, ACCEL_HOLD, GYRO_WALK, ACCEL_WALK, POS_WALK, DRIFT = 0.02, 0.8, 2.5, 2e-4, 1e-2, 0.2, 0.03
    STILL = 0.05
    MAX_SPEED, GATE, MAX_GYRO_BIAS, MAX_ACCEL_BIAS, LEARN = 60.0, 13.8, 0.05, 0.6, 0.8

    def __init__(self, n: int):
        self.x, self.P, self.ready = np.zeros((n, DIM)), np.zeros((n, DIM, DIM)), np.zeros(n, bool)
        self.t, self.fix_t, self.walked = np.full(n, np.nan), np.full(n, np.nan), np.zeros(n)
        self.offsets, self.n_offsets = np.zeros((n, 3, 2)), np.zeros(n, np.int64)  # of rejected fixes, newest last

    _NAMES = ("x", "P", "ready", "t", "fix_t", "walked", "offsets", "n_offsets")

    def carry(self, i: int) -> dict:
        """What one filter has to hand on, as plain values (``CARRY``)."""
        value = lambda x: None if np.isnan(x) else float(x)
        out = {"t": value(self.t[i]), "fix_t": value(self.fix_t[i]), "walked": float(self.walked[i]), "n_offsets": int(self.n_offsets[i]), "ready": bool(self.ready[i])}
        return out | {c: getattr(self, c)[i].reshape(-1).tolist() for c in ("offsets", "x", "P")}

    def go_on(self, i: int, carry: dict) -> None:
        for c in ("t", "fix_t"):
            getattr(self, c)[i] = np.nan if carry[c] is None else carry[c]
        self.walked[i], self.n_offsets[i], self.ready[i] = carry["walked"], carry["n_offsets"], carry["ready"]
        for c in ("offsets", "x", "P"):
            own = getattr(self, c)
            own[i] = np.array(carry[c], float).reshape(own.shape[1:])

    def copy_from(self, i: int, other: FilterBank, j: int) -> None:
        for name in self._NAMES:
            getattr(self, name)[i] = getattr(other, name)[j]

    def _predict(self, i, omega, accel, dt, dark):
        known = ~np.isnan(accel)
        e, n, h, v, bg, ba = self.x[i].T
        a = np.where(known, accel - ba, 0.0)
        a = np.where(known & (dark > 0), np.copysign(np.maximum(0.0, np.abs(a) - 0.15), a), a)
        s, c = np.sin(h), np.cos(h)
        turned = h + (omega - bg) * dt
        self.x[i] = np.stack([e + v * s * dt, n + v * c * dt, np.arctan2(np.sin(turned), np.cos(turned)), np.clip(v + a * dt, 0.0, self.MAX_SPEED), bg, ba], axis=1)
        f = np.tile(np.eye(DIM), (len(i), 1, 1))
        f[:, 0, 2], f[:, 0, 3], f[:, 1, 2], f[:, 1, 3], f[:, 2, 4] = v * c * dt, s * dt, -v * s * dt, c * dt, -dt
        f[known, 3, 5] = -dt[known]
        place = self.POS_WALK**2 * dt + (self.DRIFT * v) ** 2 * dark * dt
        q = np.stack([place, place, (self.GYRO * dt) ** 2, (np.where(known, self.ACCEL, self.ACCEL_HOLD) * dt) ** 2, self.GYRO_WALK**2 * dt, self.ACCEL_WALK**2 * dt], axis=1)
        self.P[i] = f @ self.P[i] @ f.transpose(0, 2, 1) + q[:, :, None] * np.eye(DIM)

    def _correct(self, i, which: list[int], y: np.ndarray, r: np.ndarray) -> None:
        P = self.P[i]
        gain = P[:, :, which] @ np.linalg.inv(P[:, which][:, :, which] + r[:, None, None] * np.eye(len(which)))
        self.x[i] += (gain @ y[:, :, None])[:, :, 0]
        keep = np.tile(np.eye(DIM), (len(i), 1, 1))
        keep[:, :, which] -= gain
        P = keep @ P @ keep.transpose(0, 2, 1) + r[:, None, None] * (gain @ gain.transpose(0, 2, 1))
        self.P[i] = (P + P.transpose(0, 2, 1)) / 2

    def _limit(self, i) -> None:
        self.x[i, 4] = np.clip(self.x[i, 4], -self.MAX_GYRO_BIAS, self.MAX_GYRO_BIAS)
        self.x[i, 5] = np.clip(self.x[i, 5], -self.MAX_ACCEL_BIAS, self.MAX_ACCEL_BIAS)

    def _fix_speed(self, i, v: np.ndarray, sigma: float) -> None:
        y = v - self.x[i, 3]
        cut = i[np.abs(y) > self.LEARN]
        row = self.P[cut, 5, :5]
        self.P[cut, 5, :5] = self.P[cut, :5, 5] = 0
        self._correct(i, [3], y[:, None], np.full(len(i), sigma**2))
        self.P[cut, 5, :5] = self.P[cut, :5, 5] = row
        self.x[i, 3] = np.maximum(self.x[i, 3], 0.0)
        self._limit(i)

    def _fix_course(self, i, h: np.ndarray, sigma: np.ndarray) -> None:
        d = h - self.x[i, 2]
        self._correct(i, [2], np.arctan2(np.sin(d), np.cos(d))[:, None], sigma**2)
        self.x[i, 2] = np.arctan2(np.sin(self.x[i, 2]), np.cos(self.x[i, 2]))
        self._limit(i)

    def _fix_position(self, i, at: np.ndarray, sigma: np.ndarray, consistent_m: float = 25.0) -> np.ndarray:
        y = at - self.x[i, :2]
        s = self.P[i, :2, :2] + sigma[:, None, None] ** 2 * np.eye(2)
        good = (y * np.linalg.solve(s, y[:, :, None])[:, :, 0]).sum(axis=1) <= self.GATE
        if good.any():
            self._correct(i[good], [0, 1], y[good], sigma[good] ** 2)
        bad = i[~good]
        self.offsets[bad, :2] = self.offsets[bad, 1:]
        self.offsets[bad, 2] = y[~good]
        self.n_offsets[bad] += 1
        o = self.offsets[i]
        apart = np.stack([np.hypot(*(o[:, a] - o[:, b]).T) for a, b in ((0, 1), (0, 2), (1, 2))]).max(axis=0)
        anchored = ~good & (self.n_offsets[i] >= 3) & (apart <= consistent_m)
        now = i[anchored]
        self.x[now, :2] = at[anchored]
        self.P[now, :2, :] = 0
        self.P[now, :, :2] = 0
        self.P[now, 0, 0] = self.P[now, 1, 1] = sigma[anchored] ** 2
        self.n_offsets[i[good | anchored]] = 0
        return np.where(good, "accepted", np.where(anchored, "anchored", "rejected")).astype(object)

    def step(self, i: np.ndarray, r: dict[str, np.ndarray], stale: float) -> dict[str, np.ndarray]:
        """One row of each of the sessions ``i``: what became of its fix, and the figures of an outage that it ends."""
        dt = np.where(np.isnan(self.t[i]), 0.0, np.clip(r["t"] - self.t[i], 0.001, 0.25))
        verdict = np.full(len(i), None, object)
        out = {n: np.full(len(i), np.nan) for n in ("outage_s", "outage_m", "error_m", "drift_percent")}
        k = np.flatnonzero(~r["fix"])
        if len(k):
            own = i[k]
            dark = np.nan_to_num(np.maximum(0.0, r["t"][k] - self.fix_t[own] - stale))
            go = self.ready[own] & (dt[k] > 0)
            if go.any():
                self._predict(own[go], r["omega"][k][go], r["accel"][k][go], dt[k][go], dark[go])
            rest = self.ready[own] & r["stationary"][k]
            if rest.any():
                self._fix_speed(own[rest], np.zeros(int(rest.sum())), self.STILL)
            self.walked[own] = np.where(dark > 0, self.walked[own] + self.x[own, 3] * dt[k], 0.0)
            self.t[own] = r["t"][k]
        k = np.flatnonzero(r["fix"])
        if len(k):
            new, k = k[~self.ready[i[k]]], k[self.ready[i[k]]]
            if len(new):
                heading = np.where(r["speed"][new] > 2, r["course"][new], np.nan)
                self.x[i[new]] = np.stack([r["e"][new], r["n"][new], np.nan_to_num(heading), r["speed"][new], np.zeros(len(new)), np.zeros(len(new))], axis=1)
                start = np.tile(np.diag([25.0, 25.0, 0.01, 1.0, 4e-4, 0.09]), (len(new), 1, 1))
                start[np.isnan(heading), 2, 2] = math.pi**2
                self.P[i[new]], self.ready[i[new]], verdict[new] = start, True, "started"
            if len(k):
                own, at = i[k], np.stack([r["e"][k], r["n"][k]], axis=1)
                away = np.hypot(*(at - self.x[own, :2]).T)
                verdict[k] = self._fix_position(own, at, r["sigma"][k])
                good = k[verdict[k] == "accepted"]
                if len(good):
                    self._fix_speed(i[good], r["speed"][good], 0.5)
                fast = good[r["speed"][good] > 2]
                if len(fast):
                    self._fix_course(i[fast], r["course"][fast], 0.06 + 0.5 / r["speed"][fast])
                over = (verdict[k] != "rejected") & (r["t"][k] - self.fix_t[own] > stale)
                e, walked = k[over], self.walked[own[over]]
                out["outage_s"][e], out["outage_m"][e], out["error_m"][e] = r["t"][e] - self.fix_t[i[e]] - stale, walked, away[over]
                out["drift_percent"][e] = np.where(walked >= 1, 100 * away[over] / np.maximum(walked, 1), np.nan)
            taken = np.concatenate([new, k])
            taken = taken[verdict[taken] != "rejected"]
            self.fix_t[i[taken]], self.walked[i[taken]] = r["t"][taken], 0.0
        return out | {"verdict": verdict}

    def run(self, rows: dict[str, np.ndarray], first: np.ndarray, size: np.ndarray, stale: float = STALE_S) -> dict[str, np.ndarray]:
        """All rows of the sessions, which lie at first[i]:first[i] + size[i] in time order: the state behind each, what became of a fix, and recovery figures on the fix that ends an outage.

        Rows are samples (omega, accel; ``stationary``: a zero-velocity update) and fixes (e, n, speed, course, sigma).
        """
        n = len(rows["t"])
        out = {c: np.full(n, np.nan) for c in ("outage_s", "outage_m", "error_m", "drift_percent")} | {"verdict": np.full(n, None, object)}
        states, sigma = np.zeros((n, DIM)), np.zeros(n)
        longest = np.argsort(-size, kind="stable")
        for s in range(int(size.max(initial=0))):
            i = longest[: np.searchsorted(-size[longest], -s, "left")]
            at = first[i] + s
            for c, values in self.step(i, {c: v[at] for c, v in rows.items()}, stale).items():
                out[c][at] = values
            states[at], sigma[at] = self.x[i], np.sqrt(np.maximum(0.0, self.P[i, 0, 0] + self.P[i, 1, 1]))
        return {c: states[:, j] for j, c in enumerate(("east", "north", "heading", "speed", "gyro_bias", "accel_bias"))} | {"pos_sigma": sigma} | out


#: Rows that are gathered before their sessions take their steps together.
GATHER_ROWS = 50_000


def fusion_filter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Batch replay: one filter per session (kind, t, omega, accel, e, n, speed, course, sigma, and stationary if it is known); a fix comes before a sample of its time.

    Sessions of a task take their steps together (``FilterBank``). Rows come in
    order and in pieces of some ``GATHER_ROWS``, and an open session's state goes
    on to the next piece, so a session may be of any length.
    """
    given = ["kind", "t", "omega", "accel", "e", "n", "speed", "course", "sigma"]
    flag = F.coalesce("stationary", F.lit(False)) if "stationary" in rows.columns else F.lit(False)
    own = rows.select(*keys, *given, flag.alias("stationary")).repartition(*keys).sortWithinPartitions(*keys, "t", "kind")
    types = dict(rows.dtypes)
    names = [c.split(" ")[0] for c in FILTERED.split(", ")]

    def run(batches):
        held, n, bank, last = [], 0, None, None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
                n += len(batch)
            if not n or (batch is not None and n < GATHER_ROWS):
                continue
            f, held, n = pd.concat(held, ignore_index=True), [], 0
            values = f[keys].to_numpy(object)
            first = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1])
            size = np.diff([*first, len(f)])
            before, bank = bank, FilterBank(len(first))
            if last is not None and (values[0] == last).all():
                bank.copy_from(0, before, len(before.ready) - 1)
            last = values[-1]
            columns = {c: f[c].to_numpy(float, na_value=np.nan) for c in given[1:]} | {"fix": (f["kind"] == "fix").to_numpy(), "stationary": f["stationary"].to_numpy(bool)}
            out = f[[*keys, "t", "kind"]].assign(**bank.run(columns, first, size))
            yield out[[*keys, *names]]

    return own.mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), FILTERED]))


#: What a device's filter hands on (``FilterBank.carry``).
CARRY = "t double, fix_t double, walked double, n_offsets long, ready boolean, offsets array<double>, x array<double>, P array<double>"
_NUMBERS = ["t", "omega", "accel", "e", "n", "speed", "course", "sigma"]


def filter_step(frame: pd.DataFrame, carry: dict | None) -> tuple[pd.DataFrame, dict]:
    """Rows of one device (as in ``fusion_filter``) after ``carry``: the filter's rows, in order of time with fixes before samples, and the carry behind them."""
    f = frame.sort_values(["t", "kind"], kind="stable", ignore_index=True)
    bank = FilterBank(1)
    if carry:
        bank.go_on(0, carry)
    still = f["stationary"].eq(True).to_numpy(bool) if "stationary" in f else np.zeros(len(f), bool)
    columns = {c: f[c].to_numpy(float, na_value=np.nan) for c in _NUMBERS} | {"fix": (f["kind"] == "fix").to_numpy(), "stationary": still}
    out = f[["t", "kind"]].assign(**bank.run(columns, np.zeros(1, np.int64), np.array([len(f)])))
    return out[[c.split(" ")[0] for c in FILTERED.split(", ")]], bank.carry(0)


def fusion_filter_stream(rows: DataFrame, device: str, ts: str, watermark: str = "10 seconds") -> DataFrame:
    """The same filter over a stream, at once: a batch's rows are sorted by time and filtered as they come, and rows from before a device's last one are dropped.

    ``live.fusion_filter_stream`` waits for the watermark instead and gives the batch's rows in any order of arrival.
    """

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names = [p.split(" ")[0] for p in CARRY.split(", ")]
        old = dict(zip(names, state.get, strict=True)) if state.exists else None
        frame = pd.concat(list(frames))
        if old and old["t"] is not None:
            frame = frame[frame["t"] >= old["t"]]  # the filter cannot go back
        out, new = filter_step(frame, old)
        state.update(tuple(new[n] for n in names))
        out.insert(0, device, key[0])
        yield out

    out = f"`{device}` {dict(rows.dtypes)[device]}, {FILTERED}"
    return rows.withWatermark(ts, watermark).groupBy(device).applyInPandasWithState(run, out, CARRY, "append", "NoTimeout")


def recovery_stats(filtered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows where an outage ended: its seconds, distance, error and drift."""
    return filtered.where("outage_s is not null").select(*keys, "t", "outage_s", "outage_m", "error_m", "drift_percent")


def consistent_rejections(fixes: DataFrame, keys: list[str], de: str, dn: str, rejected: str, order: str, within: float = 25.0) -> DataFrame:
    """Add anchors: the third of three rejected fixes in a row whose offsets lie within ``within`` metres of each other."""
    w = W.partitionBy(*keys).orderBy(order)
    at = [(F.lag(de, i).over(w), F.lag(dn, i).over(w), F.lag(rejected, i).over(w)) if i else (_c(de), _c(dn), _c(rejected)) for i in range(3)]
    near = lambda a, b: F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) <= within
    ok = at[0][2] & at[1][2] & at[2][2] & near(at[0], at[1]) & near(at[0], at[2]) & near(at[1], at[2])
    return fixes.withColumn("anchors", F.coalesce(ok, F.lit(False)))


# --- mounting


def _next(found: np.ndarray, start: int) -> int:
    """Place of the first true value from ``start`` on (the length, if there is none), looked for in pieces that double."""
    width = 256
    while start < len(found):
        some = np.flatnonzero(found[start : start + width])
        if len(some):
            return start + int(some[0])
        start, width = start + width, 2 * width
    return len(found)


#: What is known of a device's mounting between two pieces of its rows; lists are flattened vectors.
MOUNTING = "state string, up array<double>, axis array<double>, held array<double>, acc array<double>, gyro array<double>"


def align_rows(acc: np.ndarray, gyro: np.ndarray, speed: np.ndarray, carry: dict | None = None, window: int = 20, acc_var: float = 0.05, gyro_var: float = 0.01, yaw_limit: float = 0.05, pca_rows: int = 100, knock: float = 50.0) -> tuple[np.ndarray, list, dict]:
    """State and forward axis (None: not known) after each row, and what goes on to the device's next rows (``MOUNTING``).

    UNCALIBRATED, Z_ALIGNED once at rest for ``window`` rows, FULLY_ALIGNED once the forward axis is known, back after a
    knock. With a speed (not NaN) the forward axis is the horizontal acceleration while
    driving straight; without it the first principal axis of ``pca_rows`` straight rows
    (``forward_axis``). Work goes from one change of state to the next, over whole arrays.
    """
    now = carry or {"state": "UNCALIBRATED", "up": None, "axis": None, "held": [], "acc": [], "gyro": []}
    state, n = now["state"], len(acc)
    up, axis = (None if now[x] is None else np.array(now[x], float) for x in ("up", "axis"))
    held = np.array(now["held"], float).reshape(-1, 3)
    a, g = (np.concatenate([np.array(now[x], float).reshape(-1, 3), y]) for x, y in (("acc", acc), ("gyro", gyro)))
    full = max(0, len(a) - window + 1)  # rows with a whole window behind them, the last ones of a
    skip = n - full
    quiet, knocked, mean = np.zeros(n, bool), np.zeros(n, bool), np.zeros((n, 3))
    if full:
        over = lambda x: np.lib.stride_tricks.sliding_window_view(x, window, axis=0)
        turning, v = over(g).var(axis=-1).sum(axis=1), speed[skip:]
        mean[skip:] = over(a).mean(axis=-1)
        with np.errstate(invalid="ignore"):
            quiet[skip:] = (over(a).var(axis=-1).sum(axis=1) < acc_var) & np.where(np.isnan(v), turning < gyro_var, v < 0.2) & (np.linalg.norm(mean[skip:], axis=1) > 0)
            knocked[skip:] = turning > knock * gyro_var
    states, axes, i, width = np.empty(n, object), [axis] * n, max(0, min(skip, n)), 256
    states[:i] = state
    while i < n:
        if state == "UNCALIBRATED":
            j = _next(quiet, i)
            states[i:j] = state
            if j < n:
                up, state = mean[j] / np.linalg.norm(mean[j]), "Z_ALIGNED"
        elif state == "FULLY_ALIGNED":
            j = _next(knocked, i)
            states[i:j] = state
            if j < n:
                state, held, axis = "UNCALIBRATED", held[:0], None
        else:
            end = min(n, i + width)
            straight = np.abs(gyro[i:end] @ up) < yaw_limit
            flat = acc[i:end] - 9.81 * up
            flat = flat - (flat @ up)[:, None] * up
            silent, size = np.isnan(speed[i:end]), np.linalg.norm(flat, axis=1)
            pushed = straight & ~silent & (np.nan_to_num(speed[i:end]) > 1.0) & (size > 0.5)
            kept = straight & silent
            enough = kept & (len(held) + np.cumsum(kept) >= pca_rows)
            j = i + _next(pushed | enough, 0)
            held = np.concatenate([held, flat[: j + 1 - i][kept[: j + 1 - i]]])
            states[i:j] = state
            if j >= end:
                i, width = end, 2 * width
                continue
            axis = flat[j - i] / size[j - i] if pushed[j - i] else forward_axis(held)
            state, width = "FULLY_ALIGNED", 256
        if j < n:
            states[j] = state
            axes[j:] = [axis] * (n - j)
        i = j + 1
    plain = lambda x: None if x is None else [float(y) for y in np.ravel(x)]
    tail = max(0, len(a) - window + 1)
    return states, axes, {"state": state, "up": plain(up), "axis": plain(axis), "held": plain(held), "acc": plain(a[tail:]), "gyro": plain(g[tail:])}


def forward_axis(flat: np.ndarray) -> np.ndarray:
    """First principal axis of horizontal accelerations, its sign set so that the largest spike along it, which is braking, is negative."""
    _, vectors = np.linalg.eigh(np.cov(flat - flat.mean(axis=0), rowvar=False))
    axis = vectors[:, -1]
    p = flat @ axis
    return axis if abs(p.min()) > p.max() else -axis


def in_order(rows: DataFrame, keys: list[str], order: list[str], step, schema: str) -> DataFrame:
    """``step(frame, carry)`` gives a frame and the next carry for each piece of a key's rows in ``order``; carry is None at a key's first piece.

    A key passes one task in order, but never as a whole: pieces are Arrow batches, so memory does not depend on its length.
    """
    own = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        last, carry = None, None
        for f in batches:
            if not len(f):
                continue
            values, out = f[keys].to_numpy(object), []
            first = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1])
            for a, b in zip(first, [*first[1:], len(f)], strict=True):
                if last is None or (values[a] != last).any():
                    carry = None
                frame, carry = step(f.iloc[a:b], carry)
                out.append(frame)
                last = values[a]
            yield pd.concat(out, ignore_index=True)

    return own.mapInPandas(run, schema)


def alignment_states(rows: DataFrame, keys: list[str], acc: tuple, gyro: tuple, speed: str, order: str = "row_idx", **limits) -> DataFrame:
    """keys, order, state and forward axis (NULL: not known) of each row. A null acceleration or rotation is never quiet, straight or a knock."""
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, order]), "state string, axis array<double>"])
    return in_order(rows.select(*keys, order, *acc, *gyro, speed), keys, [order], align_step([*keys, order], acc, gyro, speed, limits), schema)


def align_step(kept: list[str], acc: tuple, gyro: tuple, speed: str, limits: dict):
    """``align_rows`` as a step over frames in order, for batch and stream."""

    def step(f: pd.DataFrame, carry: dict | None):
        states, axes, carry = align_rows(*(f[list(c)].to_numpy(float, na_value=np.nan) for c in (acc, gyro)), f[speed].to_numpy(float, na_value=np.nan), carry, **limits)
        return f[kept].assign(state=states, axis=[None if x is None else x.tolist() for x in axes]), carry

    return step


#: The last kept point of a trail and the time of the last emitted row; the last fixes (t, e, n of each), newest last.
TRAIL = "e double, n double, t double, fixes array<double>"


def thin_rows(e: np.ndarray, n: np.ndarray, spacing: float, last: tuple[float, float] | None = None) -> np.ndarray:
    """Places of the points that are ``spacing`` or more from the last kept one, ``last`` to begin with; points without a place are passed over."""
    ok = ~(np.isnan(e) | np.isnan(n))
    kept, i, width = [], 0, 64
    if last is None and ok.any():
        i = int(np.argmax(ok))
        kept.append(i)
        last = e[i], n[i]
        i += 1
    while last is not None and i < len(e):
        far = np.flatnonzero(np.hypot(e[i : i + width] - last[0], n[i : i + width] - last[1]) >= spacing)  # NaN is not
        if len(far):
            i += int(far[0])
            kept.append(i)
            last, i, width = (e[i], n[i]), i + 1, 64
        else:
            i, width = i + width, min(2 * width, 1 << 16)
    return np.array(kept, np.int64)


def spaced_in_time(t: np.ndarray, every: float, last: float | None = None) -> np.ndarray:
    """Places of ascending times that are ``every`` seconds or more after the last chosen one."""
    out, i = [], 0 if last is None else int(np.searchsorted(t - last, every - 1e-9))
    while i < len(t):
        out.append(i)
        i = max(i + 1, int(np.searchsorted(t - t[i], every - 1e-9)))
    return np.array(out, np.int64)


def thin_trail(points: DataFrame, keys: list[str], e: str, n: str, order: str, spacing: float = 3.0) -> DataFrame:
    """Points at least ``spacing`` metres from the last kept one: greedy, in order, in pieces that hand the last kept point on. Points without a place are left out."""

    def step(f: pd.DataFrame, carry: dict | None):
        x, y = f[e].to_numpy(float, na_value=np.nan), f[n].to_numpy(float, na_value=np.nan)
        kept = thin_rows(x, y, spacing, carry and carry["last"])
        return f.iloc[kept], {"last": (x[kept[-1]], y[kept[-1]])} if len(kept) else carry

    own = points.select(*keys, order, e, n)
    return in_order(own, keys, [order], step, own.schema)


def emitted_rows(rows: DataFrame, keys: list[str], t: str, every: float = 0.1) -> DataFrame:
    """Rows at least ``every`` seconds after the last one that was emitted. Rows without a time are left out."""

    def step(f: pd.DataFrame, carry: float | None):
        at = f[t].to_numpy(float)
        kept = spaced_in_time(at, every, carry)
        return f.iloc[kept], float(at[kept[-1]]) if len(kept) else carry

    return in_order(rows.where(F.col(t).isNotNull()), keys, [t], step, rows.schema)


def last_fixes(fixes: DataFrame, keys: list[str], order: str, n: int = 90) -> DataFrame:
    """The last ``n`` fixes of each device, newest first."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return fixes.withColumn("recency", r).where(F.col("recency") <= n)


def local_fix(lat, lon, lat0, lon0):
    """East and north of a fix, for the filter's input."""
    return geo.to_enu(lat, lon, lat0, lon0)
