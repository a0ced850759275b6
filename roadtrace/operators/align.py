"""Recovery of lags between two recordings of a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadtrace.functions import geo, stats
from roadtrace.functions.geo import _c
from roadtrace.operators import ranking
from roadtrace.session import written_once

SWEEP = "lag int, speed_corr double, median_separation double, p95_separation double"


#: Phone rows of ``lag_sweep_exact`` in a task, each with its pairs at all lags.
SWEPT = 20_000


def lag_sweep_exact(phone: DataFrame, vehicle: DataFrame, keys: list[str], max_lag: int, min_n: int = 20) -> DataFrame:
    """Speed correlation and separation at every lag from the pairs of rows themselves: the rows are multiplied by the lags, so it is for short sweeps and checks.

    A window over both recordings of a session finds the vehicle rows around each phone row, so rows are shuffled and pairs are not.
    """
    at = F.col("row_idx").cast("long")
    seen = F.struct(at.alias("at"), "velocity_kmh", "vehicle_lat", "vehicle_lon").alias("_v")
    own = phone.select(*keys, at.alias("_at"), F.struct("speed_kmh", "lat", "lon").alias("_p"))
    both = own.unionByName(vehicle.select(*keys, at.alias("_at"), seen), allowMissingColumns=True).dropna(subset=[*keys, "_at"])
    tasks = max(int(phone.sparkSession.conf.get("spark.sql.shuffle.partitions")), phone.count() // SWEPT)
    around = F.collect_list("_v").over(W.partitionBy(*keys).orderBy("_at").rangeBetween(-max_lag, max_lag))
    near = both.repartition(tasks, *keys).withColumn("_near", around).where("_p is not null")
    p = near.select(*keys, "_at", "_p.*", F.explode("_near").alias("_v")).select(*keys, (F.col("_v.at") - F.col("_at")).cast("int").alias("lag"), "speed_kmh", "lat", "lon", "_v.*")
    p = p.withColumn("_sep", geo.haversine_m("lat", "lon", "vehicle_lat", "vehicle_lon"))
    return p.groupBy(*keys, "lag").agg(stats.safe_corr("speed_kmh", "velocity_kmh", min_n).alias("speed_corr"), F.percentile("_sep", 0.5).alias("median_separation"), F.percentile("_sep", 0.95).alias("p95_separation"))


def _haversine(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0)))


def _percentiles(x: np.ndarray, q: tuple[float, ...]) -> list[np.ndarray]:
    """Interpolated percentiles of the finite values of each row; NaN for a row without any."""
    x = np.sort(np.where(np.isfinite(x), x, np.nan), axis=1)  # NaN sorts to the end
    n = np.isfinite(x).sum(axis=1)
    rows, out = np.arange(len(x)), []
    for p in q:
        at = p * np.maximum(n - 1, 0)
        low = np.floor(at).astype(int)
        a, b = x[rows, low], x[rows, np.minimum(low + 1, np.maximum(n - 1, 0))]
        out.append(np.where(n > 0, a + (b - a) * (at - low), np.nan))
    return out


def _row_corr(x: np.ndarray, y: np.ndarray, min_n: int) -> np.ndarray:
    """Correlation of each pair of rows over their jointly finite values; NaN where there are too few or one does not vary."""
    ok = np.isfinite(x) & np.isfinite(y)
    n = np.maximum(ok.sum(axis=1), 1)
    dx, dy = (np.where(ok, v - (np.where(ok, v, 0).sum(axis=1) / n)[:, None], 0.0) for v in (x, y))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (dx * dy).sum(axis=1) / np.sqrt((dx * dx).sum(axis=1) * (dy * dy).sum(axis=1))
    vary = (np.abs(dx).max(axis=1) > 0) & (np.abs(dy).max(axis=1) > 0)
    return np.where((ok.sum(axis=1) >= max(1, min_n)) & vary, r, np.nan)


#: Values of the shifted recordings that are laid out together.
LAID_OUT = 1 << 20


def _sweep_whole(phone: DataFrame, vehicle: DataFrame, keys: list[str], max_lag: int, min_n: int) -> DataFrame:
    """Each session's two recordings meet once in one task of that session."""

    def sweep(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(p) and len(v):
            p, v = p.sort_values("row_idx"), v.sort_values("row_idx")
            n = min(len(p), len(v))
            ps, pla, plo = (p[c].to_numpy(float)[:n] for c in ("speed_kmh", "lat", "lon"))
            vs, vla, vlo = (v[c].to_numpy(float)[:n] for c in ("velocity_kmh", "vehicle_lat", "vehicle_lon"))
            lags = np.arange(-max_lag, max_lag + 1)
            lags = lags[np.abs(lags) < n]
            step = max(1, LAID_OUT // n)
            for part in np.split(lags, range(step, len(lags), step)):
                at = np.arange(n) + part[:, None]
                inside = (at >= 0) & (at < n)
                shifted = lambda v, at=at, inside=inside: np.where(inside, v[np.clip(at, 0, n - 1)], np.nan)
                sep = _haversine(pla, plo, shifted(vla), shifted(vlo))
                rows += zip(part.tolist(), _row_corr(np.broadcast_to(ps, at.shape), shifted(vs), min_n).tolist(), *(q.tolist() for q in _percentiles(sep, (0.5, 0.95))), strict=True)
        out = pd.DataFrame(rows, columns=["lag", "speed_corr", "median_separation", "p95_separation"])
        for k in keys:
            out[k] = p[k].iloc[0] if len(p) else None
        return out[[*keys, "lag", "speed_corr", "median_separation", "p95_separation"]]

    types = dict(phone.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), SWEEP])
    left = phone.select(*keys, "row_idx", "speed_kmh", "lat", "lon").groupBy(*keys)
    right = vehicle.select(*[F.col(c).alias(c) for c in (*keys, "row_idx", "velocity_kmh", "vehicle_lat", "vehicle_lon")]).groupBy(*keys)
    swept = left.cogroup(right).applyInPandas(sweep, schema)
    return swept.withColumns({c: stats.finite(c) for c in ("speed_corr", "median_separation", "p95_separation")})


#: Rows of a session that a task of ``lag_sweep`` takes.
BLOCK = 100_000
#: Bits of a separation that a round of ``_sweep_blocks`` looks at; a separation is not negative, so its bits are in its order.
ROUNDS = (16, 24, 24)
QUANTILES = (0.5, 0.95)
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "x0", "x1", "y0", "y1")


def lag_sweep(phone: DataFrame, vehicle: DataFrame, keys: list[str], max_lag: int = 50, min_n: int = 20, block: int = BLOCK) -> DataFrame:
    """``lag_sweep_exact`` at scale: rows are read once for all lags, in a task for each session, or for each block of a session of more than ``block`` rows.

    Whether there is such a session is looked up before the plan is made. In it ``row_idx``
    numbers the rows from 0 without a gap, as readers make it. Sessions with a null key are not cut.
    Both recordings are then written once, and so is what each round finds, so that no round is computed twice.
    """
    left = phone.select(*keys, "row_idx", "speed_kmh", "lat", "lon")
    right = vehicle.select(*[F.col(c).alias(c) for c in (*keys, "row_idx", "velocity_kmh", "vehicle_lat", "vehicle_lon")])
    beyond = left.where(F.col("row_idx") >= block).dropna(subset=keys)
    if beyond.isEmpty():
        return _sweep_whole(left, right, keys, max_lag, min_n)
    left, right = written_once(left, "phone"), written_once(right, "vehicle")
    long = left.where(F.col("row_idx") >= block).dropna(subset=keys).select(*keys).distinct()
    kept = lambda df, how: df.join(long, keys, how)
    whole = _sweep_whole(kept(left, "left_anti"), kept(right, "left_anti"), keys, max_lag, min_n)
    return whole.unionByName(_sweep_blocks(kept(left, "left_semi"), kept(right, "left_semi"), keys, max_lag, min_n, block))


def _block(p: pd.DataFrame, v: pd.DataFrame, max_lag: int, block: int):
    """Lags, both speeds and separations of a block's phone rows with the vehicle rows at each lag, some lags at a time; ``v`` has ``max_lag`` rows more on either side."""
    n, start = int(p["n"].iloc[0]), int(p["_b"].iloc[0]) * block
    size = min(block, n - start)

    def laid_out(f: pd.DataFrame, columns: list[str], size: int, first: int) -> list[np.ndarray]:
        out = np.full((len(columns), size), np.nan)
        out[:, f["row_idx"].to_numpy() - first] = f[columns].to_numpy(float, na_value=np.nan).T
        return list(out)

    ps, pla, plo = laid_out(p, ["speed_kmh", "lat", "lon"], size, start)
    vs, vla, vlo = (np.lib.stride_tricks.sliding_window_view(x, size) for x in laid_out(v, ["velocity_kmh", "vehicle_lat", "vehicle_lon"], size + 2 * max_lag, start - max_lag))
    lags = np.arange(-max_lag, max_lag + 1)
    lags = lags[np.abs(lags) < n]
    step = max(1, LAID_OUT // size)
    for part in np.split(lags, range(step, len(lags), step)):
        i = part + max_lag
        yield part, ps, vs[i], _haversine(pla, plo, vla[i], vlo[i])


def _sums(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """``_SUMS`` of each row of ``y`` with ``x``, over their jointly finite values; extremes are NaN where there are none."""
    ok = np.isfinite(x) & np.isfinite(y)
    x, y = np.broadcast_to(x, y.shape), np.where(ok, y, 0.0)
    a, n = np.where(ok, x, 0.0), ok.sum(axis=1)
    with_none = lambda v: np.where(n > 0, v, np.nan)
    ends = [with_none(f(v, axis=1, where=ok, initial=i)) for v in (a, y) for f, i in ((np.min, np.inf), (np.max, -np.inf))]
    return dict(zip(_SUMS, (n, a.sum(axis=1), y.sum(axis=1), (a * a).sum(axis=1), (y * y).sum(axis=1), (a * y).sum(axis=1), *ends), strict=True))


def _sweep_blocks(left: DataFrame, right: DataFrame, keys: list[str], max_lag: int, min_n: int, block: int) -> DataFrame:
    """The sweep of long sessions: blocks give sums, and percentiles are narrowed down bit by bit.

    Each round counts a block's separations by their next bits (``ROUNDS``), only of those
    that still begin like one of the wanted order statistics; the counts of all blocks say how these go on.
    After the last round all bits are known, so the percentiles are exact.
    """
    each = [*keys, "lag"]
    types = dict(left.dtypes)
    typed = ", ".join(f"`{k}` {types[k]}" for k in keys)
    ends = lambda df, *more: df.groupBy(*keys).agg((F.max("row_idx") + 1).alias("rows"), *more)
    mean = lambda c, name: F.avg(stats.finite(c)).alias(name)
    n = F.least("rows", "vehicle_rows").cast("long").alias("n")
    sizes = ends(left, mean("speed_kmh", "mx")).join(ends(right, mean("velocity_kmh", "my")).withColumnRenamed("rows", "vehicle_rows"), keys).select(*keys, n, F.coalesce("mx", F.lit(0.0)).alias("mx"), F.coalesce("my", F.lit(0.0)).alias("my"))
    inside = F.col("row_idx") < F.col("n")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: blocks are few bytes, but long work, and are not to be put together
    apart = lambda df: df.repartition(tasks, *keys, "_b")
    p = apart(left.join(sizes, keys).where(inside).withColumn("_b", F.floor(F.col("row_idx") / block)))
    near = F.sequence(F.greatest(F.floor((F.col("row_idx") - max_lag) / block), F.lit(0).cast("long")), F.least(F.floor((F.col("row_idx") + max_lag) / block), F.floor((F.col("n") - 1) / block)))
    v = right.join(sizes.select(*keys, "n"), keys).where(inside).withColumn("_b", F.explode(near)).drop("n")

    def counted(f: pd.DataFrame, p: pd.DataFrame, names: list[str]) -> pd.DataFrame:
        for k in keys:
            f[k] = p[k].iloc[0]
        return f[[*keys, *names]]

    first = ["lag", "bin", "count", *_SUMS]

    def begin(p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p):
            mx, my = float(p["mx"].iloc[0]), float(p["my"].iloc[0])
            for lags, x, ys, seps in _block(p, v, max_lag, block):
                out.append(pd.DataFrame({"lag": lags, "bin": -1, "count": 0} | _sums(x - mx, ys - my)))
                i, j = np.nonzero(np.isfinite(seps))
                code, count = np.unique((i << ROUNDS[0]) | (seps[i, j].view(np.int64) >> (64 - ROUNDS[0])), return_counts=True)
                out.append(pd.DataFrame({"lag": lags[code >> ROUNDS[0]], "bin": code & ((1 << ROUNDS[0]) - 1), "count": count}))
        return counted(pd.concat(out, ignore_index=True), p, first) if out else pd.DataFrame(columns=[*keys, *first])

    schema = f"{typed}, lag int, bin long, count long, " + ", ".join(f"{c} double" for c in _SUMS)
    group = lambda df: df.groupBy(*keys, "_b")
    least = lambda c: c in ("x0", "y0")
    begun = group(p).cogroup(group(apart(v))).applyInPandas(begin, schema).groupBy(*each, "bin").agg(F.sum("count").alias("count"), *[(F.min if least(c) else F.max if c in ("x1", "y1") else F.sum)(c).alias(c) for c in _SUMS])
    begun = written_once(begun, "sweep")

    # where the wanted order statistics lie
    up = W.partitionBy(*each).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    bins = begun.where("bin >= 0").select(*each, "bin", "count", F.sum("count").over(up).alias("upto"), F.sum("count").over(W.partitionBy(*each)).alias("total"))
    at = lambda q: F.lit(q) * (F.col("total") - 1)
    ranks = [F.struct(F.lit(2 * i + j).alias("target"), F.least(F.floor(at(q)) + j, F.col("total") - 1).alias("rank")) for i, q in enumerate(QUANTILES) for j in (0, 1)]
    found = bins.withColumn("_r", F.explode(F.array(*ranks))).select(*each, "total", "_r.target", F.col("bin").alias("prefix"), (F.col("_r.rank") - (F.col("upto") - F.col("count"))).alias("rest"), "count")
    found = found.where((F.col("rest") >= 0) & (F.col("rest") < F.col("count"))).drop("count")
    left_bits = 64 - ROUNDS[0]
    for bits in ROUNDS[1:]:
        found = _narrow(written_once(found, "ranks"), p, v, sizes, keys, typed, counted, apart, left_bits, bits, max_lag, block)
        left_bits -= bits

    found = written_once(found, "ranks")
    value = lambda t: F.max(F.when(F.col("target") == t, F.col("value")))
    q = found.groupBy(*each).agg(F.max("total").alias("total"), *[value(t).alias(f"_v{t}") for t in range(2 * len(QUANTILES))])
    share = lambda q: at(q) - F.floor(at(q))
    q = q.select(*each, *[(F.col(f"_v{2 * i}") + (F.col(f"_v{2 * i + 1}") - F.col(f"_v{2 * i}")) * share(x)).alias(name) for i, (x, name) in enumerate(zip(QUANTILES, ("median_separation", "p95_separation"), strict=True))])
    dev = lambda a: F.col(f"s{a}{a}") - F.col(f"s{a}") ** 2 / F.col("n")
    corr = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(dev("x") * dev("y")))
    vary = (F.col("n") >= max(1, min_n)) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return begun.where("bin = -1").select(*each, F.when(vary, corr).alias("speed_corr")).join(q, each, "left")


def _narrow(found: DataFrame, p: DataFrame, v: DataFrame, sizes: DataFrame, keys: list[str], typed: str, counted, apart, left_bits: int, bits: int, max_lag: int, block: int) -> DataFrame:
    """The next ``bits`` of the order statistics ``found`` (prefix: all bits above the last ``left_bits``; rest: rank among the values of that prefix)."""
    each, names = [*keys, "lag", "target"], ["lag", "target", "bin", "count", "value"]
    wanted = found.groupBy(*keys).agg(F.collect_list(F.struct("lag", "target", "prefix")).alias("_w")).join(sizes.select(*keys, "n"), keys)
    wanted = wanted.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))).alias("_b"), "_w").select(*keys, "_b", F.explode("_w").alias("_w")).select(*keys, "_b", "_w.*")

    def run(p: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(p):
            is_row = both["row_idx"].notna()
            v, w = both[is_row].astype({"row_idx": "int64"}), both[~is_row]
            # the wanted prefixes as an array [target, lag]; no separation begins with -1
            prefix = np.full((2 * len(QUANTILES), 2 * max_lag + 1, 1), -1, np.int64)
            prefix[w["target"].to_numpy(np.int64), w["lag"].to_numpy(np.int64) + max_lag, 0] = w["prefix"].to_numpy(np.int64)
            for lags, _, _, seps in _block(p, v, max_lag, block):
                raw = np.where(np.isfinite(seps), seps, -1.0).view(np.int64)
                t, i, j = np.nonzero(raw >> left_bits == prefix[:, lags + max_lag])
                own = raw[i, j]
                code, where, count = np.unique((t * len(lags) + i << bits) | (own >> (left_bits - bits) & ((1 << bits) - 1)), return_index=True, return_counts=True)
                group = code >> bits
                out.append(pd.DataFrame({"lag": lags[group % len(lags)], "target": group // len(lags), "bin": code & ((1 << bits) - 1), "count": count, "value": own[where].view(float)}))
        if not out:
            return pd.DataFrame(columns=[*keys, *names])
        return counted(pd.concat(out, ignore_index=True), p, names)

    right = apart(v.unionByName(wanted, allowMissingColumns=True))
    counts = p.groupBy(*keys, "_b").cogroup(right.groupBy(*keys, "_b")).applyInPandas(run, f"{typed}, lag int, target int, bin long, count long, value double")
    counts = counts.groupBy(*each, "bin").agg(F.sum("count").alias("count"), F.max("value").alias("value"))
    upto = F.sum("count").over(W.partitionBy(*each).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    narrowed = counts.withColumn("upto", upto).join(found.select(*each, "total", "prefix", "rest"), each).withColumn("before", F.col("upto") - F.col("count"))
    narrowed = narrowed.where((F.col("rest") >= F.col("before")) & (F.col("rest") < F.col("upto")))
    return narrowed.select(*each, "total", (F.col("prefix") * (1 << bits) + F.col("bin")).alias("prefix"), (F.col("rest") - F.col("before")).alias("rest"), "value")


def verify_pairs(sweep: DataFrame, keys: list[str]) -> DataFrame:
    """Best lag of each session and the quality of its row alignment; nothing is shifted here."""
    return ranking.best_lag(sweep, keys).withColumn("quality", ranking.lag_quality())


def profile(left: np.ndarray, right: np.ndarray, max_lag: int, min_n: int = 500) -> np.ndarray:
    """Cross-correlation at lags -max_lag..max_lag of the jointly valid rows put together, each z-scored, divided by their number (not by the overlap); NaN where there is no signal."""
    ok = np.isfinite(left) & np.isfinite(right)
    x, y = left[ok], right[ok]
    n = len(x)
    out = np.full(2 * max_lag + 1, np.nan)
    if n < min_n or x.std() < 1e-7 or y.std() < 1e-7:
        return out
    x, y = (x - x.mean()) / x.std(), (y - y.mean()) / y.std()
    size = 1 << (2 * n - 1).bit_length()
    full = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size) / n
    lags = np.arange(-max_lag, max_lag + 1)
    reach = np.abs(lags) < n
    out[reach] = full[lags[reach] % size]
    return out


def lag_profile(df: DataFrame, keys: list[str], channels: list[str], target: str, max_lag: int = 100, min_n: int = 500, order: str = "row_idx", block: int = 1 << 16) -> DataFrame:
    """(keys, axis, lag, corr) of each channel against the target, as ``profile`` gives it; a signal that lags the target has a positive lag.

    A session of any length is cut into blocks of ``block`` rows of ``order``, which numbers
    them: its valid rows are ranked block by block, and blocks of ranks, with ``max_lag`` ranks
    of the target on either side, give sums that are added up.
    """
    each = [*keys, "axis"]
    pairs = df.select(*keys, _c(order).alias("_o"), _c(target).cast("double").alias("y"), F.posexplode(F.array(*[_c(c).cast("double") for c in channels])).alias("axis", "x"))
    pairs = pairs.withColumns({"_ok": stats.finite("x").isNotNull() & stats.finite("y").isNotNull(), "_b": F.floor(F.col("_o") / block)})
    good = lambda c: F.when(F.col("_ok"), F.col(c))
    moments = pairs.groupBy(*each).agg(F.count_if("_ok").alias("n"), F.avg(good("x")).alias("mx"), F.avg(good("y")).alias("my"), F.stddev_pop(good("x")).alias("sx"), F.stddev_pop(good("y")).alias("sy"))
    signal = (F.col("n") >= min_n) & (F.col("sx") >= 1e-7) & (F.col("sy") >= 1e-7)
    valid = pairs.where("_ok")
    before = F.coalesce(F.sum("m").over(W.partitionBy(*each).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = valid.groupBy(*each, "_b").agg(F.count("*").alias("m")).select(*each, "_b", before.alias("before"))
    ranked = valid.withColumn("i", F.row_number().over(W.partitionBy(*each, "_b").orderBy("_o")) - 1)
    ranked = ranked.join(blocks.join(moments.where(signal), each), [*each, "_b"])
    ranked = ranked.select(*each, (F.col("i") + F.col("before")).alias("i"), ((F.col("x") - F.col("mx")) / F.col("sx")).alias("x"), ((F.col("y") - F.col("my")) / F.col("sy")).alias("y"))
    to = F.explode(F.sequence(F.floor((F.col("i") - max_lag) / block), F.floor((F.col("i") + max_lag) / block)))
    dealt = ranked.withColumn("_b", to)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["i"].to_numpy() - int(frame["_b"].iloc[0]) * block
        own = (at >= 0) & (at < block)
        n = int(at[own].max(initial=0)) + 1
        x, y = np.zeros(n), np.zeros(n + 2 * max_lag)
        x[at[own]] = frame["x"].to_numpy()[own]
        near = at < n + max_lag
        y[at[near] + max_lag] = frame["y"].to_numpy()[near]
        out = pd.DataFrame({"lag": np.arange(max_lag, -max_lag - 1, -1), "part": np.correlate(y, x, "valid")})
        for k in each:
            out[k] = frame[k].iloc[0]
        return out[[*each, "lag", "part"]]

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "axis int, lag int, part double"])
    sums = dealt.groupBy(*each, "_b").applyInPandas(run, schema).groupBy(*each, "lag").agg(F.sum("part").alias("part"))
    lags = moments.withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))))
    out = lags.join(sums, [*each, "lag"], "left")
    return out.select(*each, "lag", F.when(F.abs("lag") < F.col("n"), F.col("part") / F.col("n")).alias("corr"))


def lag_profile_exact(df: DataFrame, keys: list[str], channel: str, target: str, max_lag: int, min_n: int = 500, order: str = "row_idx") -> DataFrame:
    """The same profile of one channel by a self-join on the shifted position: for checks."""
    w = W.partitionBy(*keys)
    d = df.where(F.col(channel).isNotNull() & F.col(target).isNotNull()).select(*keys, order, F.col(channel).alias("x"), F.col(target).alias("y"))
    d = d.withColumns({"i": F.row_number().over(w.orderBy(order)), "n": F.count("*").over(w), "sx": F.stddev_pop("x").over(w), "sy": F.stddev_pop("y").over(w), "mx": F.avg("x").over(w), "my": F.avg("y").over(w)})
    d = d.where((F.col("n") >= min_n) & (F.col("sx") >= 1e-7) & (F.col("sy") >= 1e-7))
    x = d.select(*keys, "n", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), "i", ((F.col("x") - F.col("mx")) / F.col("sx")).alias("zx")).withColumn("j", F.col("i") - F.col("lag"))
    y = d.select(*keys, F.col("i").alias("j"), ((F.col("y") - F.col("my")) / F.col("sy")).alias("zy"))
    return x.join(y, [*keys, "j"]).groupBy(*keys, "lag").agg((F.sum(F.col("zx") * F.col("zy")) / F.max("n")).alias("corr"))


def recover_alignment(acceleration: DataFrame, yaw: DataFrame, keys: list[str], max_lag: int = 100, acc_threshold: float = 0.25, yaw_threshold: float = 0.35, agreement: int = 5) -> DataFrame:
    """Tier and vehicle offset from the best channels of two lag profiles (``lag_profile``).

    The offset is the weighted lag, rounded half to even, with the opposite sign.
    """
    named = lambda df, p: ranking.best_channel(df, keys).select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("axis", "best_lag", "best_corr", "peak_margin")])
    j = named(acceleration, "acc").join(named(yaw, "yaw"), keys, "full")
    a, y = F.abs("acc_best_corr"), F.abs("yaw_best_corr")
    apart = F.abs(F.col("acc_best_lag") - F.col("yaw_best_lag"))
    inside = F.greatest(F.abs("acc_best_lag"), F.abs("yaw_best_lag")) < max_lag - 2
    high = (a >= acc_threshold) & (y >= yaw_threshold) & (apart <= agreement) & inside
    moderate = inside & (((a >= 0.12) & (y >= 0.60) & (apart <= 7)) | ((a >= 0.25) & (y >= 0.80) & (apart <= 15)))
    tier = F.when(F.coalesce(high, F.lit(False)), "high").when(F.coalesce(moderate, F.lit(False)), "moderate").otherwise("insufficient")
    lag = F.bround(F.try_divide(F.col("acc_best_lag") * a + F.col("yaw_best_lag") * y, a + y), 0).cast("int")
    return j.withColumn("tier", tier).withColumn("vehicle_offset", F.when(F.col("tier") != "insufficient", -lag).otherwise(0))
