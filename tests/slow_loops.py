"""Plain loops that the operators are held against."""

import math

import numpy as np
import pandas as pd

from roadtrace.streaming.devices import DIM, STALE_S, forward_axis


def scan(speed: np.ndarray, distance: float, history: int, rate: float, min_speed: float, step_s: float, tail: int, min_rows: int, min_history: float) -> list[tuple[int, int]]:
    cum, n, s, out = np.cumsum(speed) / rate, len(speed), history, []
    while s < n - 5:
        e = int(np.searchsorted(cum, cum[s] + distance))
        if e >= n - tail or e - s < min_rows or speed[s:e].mean() < min_speed or speed[s - history : s].min() < min_history:
            s += max(1, int(rate * step_s))
            continue
        out.append((s, e))
        s = e
    return out


def alignment_path(acc: np.ndarray, gyro: np.ndarray, speed: np.ndarray, window: int = 20, acc_var: float = 0.05, gyro_var: float = 0.01, yaw_limit: float = 0.05, pca_rows: int = 100, knock: float = 50.0) -> tuple[list[str], list[np.ndarray | None]]:
    """State and forward axis (None: not known) after each sample: UNCALIBRATED, Z_ALIGNED once at rest, FULLY_ALIGNED once the forward axis is known, back after a knock.

    With a speed (not NaN) the forward axis is the horizontal acceleration while
    driving straight; without it the first principal axis of ``pca_rows`` straight
    samples (``forward_axis``).
    """
    state, up, held, axis, out, axes = "UNCALIBRATED", None, [], None, [], []
    for i in range(len(acc)):
        if i + 1 < window:
            out.append(state)
            axes.append(axis)
            continue
        a, g, v = acc[i + 1 - window : i + 1], gyro[i + 1 - window : i + 1], speed[i]
        turning = float(g.var(axis=0).sum())
        if state == "UNCALIBRATED":
            quiet = a.var(axis=0).sum() < acc_var and (v < 0.2 if not math.isnan(v) else turning < gyro_var)
            size = float(np.linalg.norm(a.mean(axis=0)))
            if quiet and size > 0:
                up, state = a.mean(axis=0) / size, "Z_ALIGNED"
        elif state == "Z_ALIGNED":
            if abs(float(gyro[i] @ up)) < yaw_limit:
                flat = acc[i] - 9.81 * up
                flat = flat - (flat @ up) * up
                if not math.isnan(v):
                    if v > 1.0 and np.linalg.norm(flat) > 0.5:
                        state, axis = "FULLY_ALIGNED", flat / np.linalg.norm(flat)
                else:
                    held.append(flat)
                    if len(held) >= pca_rows:
                        state, axis = "FULLY_ALIGNED", forward_axis(np.array(held))
        elif turning > knock * gyro_var:
            state, held, axis = "UNCALIBRATED", [], None
        out.append(state)
        axes.append(axis)
    return out, axes


class FusionFilter:
    """Extended Kalman filter of east, north, heading, speed, yaw-rate bias and acceleration bias."""

    GYRO, ACCEL, ACCEL_HOLD, GYRO_WALK, ACCEL_WALK, POS_WALK, DRIFT = 0.02, 0.8, 2.5, 2e-4, 1e-2, 0.2, 0.03
    STILL = 0.05
    MAX_SPEED, GATE, MAX_GYRO_BIAS, MAX_ACCEL_BIAS, LEARN = 60.0, 13.8, 0.05, 0.6, 0.8

    def __init__(self, state: tuple | None = None):
        self.x, self.P, self.ready = np.zeros(DIM), np.zeros((DIM, DIM)), False
        self.rejected: list[tuple[float, float]] = []
        if state:
            self.x, self.P, self.ready = np.array(state[0], float), np.array(state[1], float).reshape(DIM, DIM), True

    def start(self, e: float, n: float, heading: float | None, speed: float) -> None:
        self.x = np.array([e, n, heading or 0.0, speed, 0.0, 0.0])
        self.P = np.diag([25.0, 25.0, math.pi**2 if heading is None else 0.01, 1.0, 4e-4, 0.09])
        self.ready = True

    def predict(self, omega: float, accel: float | None, dt: float, deadband: float = 0.0, learn: bool = True, outage: float = 0.0) -> None:
        if not self.ready or dt <= 0:
            return
        e, n, h, v, bg, ba = self.x
        a = 0.0
        if accel is not None:
            a = accel - ba
            if deadband > 0:
                a = math.copysign(max(0.0, abs(a) - deadband), a)
        s, c = math.sin(h), math.cos(h)
        turned = h + (omega - bg) * dt
        self.x = np.array([e + v * s * dt, n + v * c * dt, math.atan2(math.sin(turned), math.cos(turned)), min(max(v + a * dt, 0.0), self.MAX_SPEED), bg, ba])
        f = np.eye(DIM)
        f[0, 2], f[0, 3], f[1, 2], f[1, 3], f[2, 4] = v * c * dt, s * dt, -v * s * dt, c * dt, -dt
        if accel is not None and learn:
            f[3, 5] = -dt
        place = self.POS_WALK**2 * dt + (self.DRIFT * v) ** 2 * outage * dt
        sa = self.ACCEL if accel is not None else self.ACCEL_HOLD
        q = [place, place, (self.GYRO * dt) ** 2, (sa * dt) ** 2, self.GYRO_WALK**2 * dt, self.ACCEL_WALK**2 * dt]
        self.P = f @ self.P @ f.T + np.diag(q)

    def _correct(self, which: list[int], y: list[float], r: float) -> None:
        h = np.eye(DIM)[which]
        gain = self.P @ h.T @ np.linalg.inv(h @ self.P @ h.T + r * np.eye(len(which)))
        self.x = self.x + gain @ np.array(y)
        keep = np.eye(DIM) - gain @ h
        self.P = keep @ self.P @ keep.T + r * gain @ gain.T
        self.P = (self.P + self.P.T) / 2

    def _limit(self) -> None:
        self.x[4] = min(max(self.x[4], -self.MAX_GYRO_BIAS), self.MAX_GYRO_BIAS)
        self.x[5] = min(max(self.x[5], -self.MAX_ACCEL_BIAS), self.MAX_ACCEL_BIAS)

    def fix_position(self, e: float, n: float, sigma: float, consistent_m: float = 25.0) -> str:
        """accepted, rejected, or anchored after three rejected fixes in a row whose offsets agree."""
        y = np.array([e, n]) - self.x[:2]
        s = self.P[:2, :2] + sigma**2 * np.eye(2)
        if float(y @ np.linalg.solve(s, y)) <= self.GATE:
            self._correct([0, 1], list(y), sigma**2)
            self.rejected = []
            return "accepted"
        self.rejected = [*self.rejected, (float(y[0]), float(y[1]))][-3:]
        agree = all(math.dist(a, b) <= consistent_m for i, a in enumerate(self.rejected) for b in self.rejected[i + 1 :])
        if len(self.rejected) < 3 or not agree:
            return "rejected"
        self.x[:2] = e, n
        self.P[:2, :] = self.P[:, :2] = 0
        self.P[0, 0] = self.P[1, 1] = sigma**2
        self.rejected = []
        return "anchored"

    def fix_speed(self, v: float, sigma: float) -> None:
        y = v - self.x[3]
        row = self.P[5].copy()
        cut = abs(y) > self.LEARN  # a large gap is a transient, not a bias
        if cut:
            self.P[5, :5] = self.P[:5, 5] = 0
        self._correct([3], [y], sigma**2)
        if cut:
            self.P[5, :5] = self.P[:5, 5] = row[:5]
        self.x[3] = max(self.x[3], 0.0)
        self._limit()

    def fix_course(self, h: float, sigma: float) -> None:
        d = h - self.x[2]
        self._correct([2], [math.atan2(math.sin(d), math.cos(d))], sigma**2)
        self.x[2] = math.atan2(math.sin(self.x[2]), math.cos(self.x[2]))
        self._limit()


def run_filter(rows: pd.DataFrame, state: dict | None = None, stale: float = STALE_S) -> tuple[pd.DataFrame, dict]:
    """Filter rows of one device in time order: kind imu (omega, accel) or fix (e, n, speed, course, sigma).

    A sample whose ``stationary`` (``features.stationary``; may be missing) holds is a zero-velocity update.
    Returns one row per input row (state, sigma, what became of a fix) with recovery
    figures on the fix that ends an outage, and the state to go on with.
    """
    st = dict(state or {})
    f = FusionFilter((st["x"], st["P"]) if "x" in st else None)
    f.rejected = [tuple(p) for p in st.get("rejected", [])]
    last_t, last_fix, walked = st.get("t"), st.get("fix_t"), st.get("walked", 0.0)
    out = []
    for r in rows.itertuples(index=False):
        dt = min(max(r.t - last_t, 0.001), 0.25) if last_t is not None else 0.0
        verdict = seconds = distance = error = drift = None
        if r.kind == "imu":
            dark = max(0.0, r.t - last_fix - stale) if last_fix is not None else 0.0
            f.predict(r.omega, None if r.accel is None or math.isnan(r.accel) else r.accel, dt, 0.15 if dark > 0 else 0.0, True, dark)
            if f.ready and getattr(r, "stationary", None) == True:  # noqa: E712 (None and NaN are not)
                f.fix_speed(0.0, f.STILL)
            walked = walked + f.x[3] * dt if dark > 0 else 0.0
            last_t = r.t
        else:
            if not f.ready:
                f.start(r.e, r.n, r.course if r.speed > 2 else None, r.speed)
                verdict = "started"
            else:
                away = math.dist((r.e, r.n), f.x[:2])
                verdict = f.fix_position(r.e, r.n, r.sigma)
                if verdict == "accepted":
                    f.fix_speed(r.speed, 0.5)
                    if r.speed > 2:
                        f.fix_course(r.course, 0.06 + 0.5 / r.speed)
                if verdict != "rejected" and last_fix is not None and r.t - last_fix > stale:
                    seconds, distance, error = r.t - last_fix - stale, walked, away
                    drift = 100 * away / walked if walked >= 1 else None
            if verdict != "rejected":
                last_fix, walked = r.t, 0.0
        out.append((r.t, r.kind, *f.x.tolist(), math.sqrt(max(0.0, f.P[0, 0] + f.P[1, 1])), verdict, seconds, distance, error, drift))
    names = ["t", "kind", "east", "north", "heading", "speed", "gyro_bias", "accel_bias", "pos_sigma", "verdict", "outage_s", "outage_m", "error_m", "drift_percent"]
    keep = {"t": last_t, "fix_t": last_fix, "walked": walked, "rejected": [list(p) for p in f.rejected]}
    if f.ready:
        keep |= {"x": f.x.tolist(), "P": f.P.reshape(-1).tolist()}
    return pd.DataFrame(out, columns=names), keep
