"""Fix quality, gates, clocks, stable hashes and JSON helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c

# Base standard deviations of position, altitude and velocity; chi-square gates of 6 and 2 degrees of freedom.
SIGMA_POS, SIGMA_ALT, SIGMA_VEL = 2.5, 5.0, 0.1
GATE_6, GATE_2 = 16.81, 13.8


def gnss_quality(hdop, satellites, fix_type, cn0, hdop_limit: float = 4.0, cn0_limit: float = 25.0) -> dict[str, Column]:
    """Health (GOOD, DEGRADED, DENIED), variance scale, and the scaled position, altitude and velocity variances."""
    hdop, satellites, fix_type, cn0 = map(_c, (hdop, satellites, fix_type, cn0))
    denied = (fix_type == "none") | (satellites < 4)
    degraded = (hdop >= hdop_limit) | (cn0 < cn0_limit)
    health = F.when(denied, "DENIED").when(degraded, "DEGRADED").otherwise("GOOD")
    scale = F.when(denied, 1e6).when(degraded, F.pow(F.greatest(F.lit(1.0), hdop / 2), 2)).otherwise(1.0)
    return {"health": health, "scale": scale, "var_pos": scale * SIGMA_POS**2, "var_alt": scale * SIGMA_ALT**2, "var_vel": scale * SIGMA_VEL**2}


def nis_diagonal(innovations: list, variances: list) -> Column:
    """Normalised innovation squared for independent components."""
    parts = [F.try_divide(_c(y) * _c(y), _c(v)) for y, v in zip(innovations, variances, strict=True)]
    return sum(parts[1:], parts[0])


def nis_2x2(y0, y1, s00, s01, s11) -> Column:
    """Normalised innovation squared for a symmetric 2 x 2 covariance."""
    y0, y1, s00, s01, s11 = map(_c, (y0, y1, s00, s01, s11))
    det = s00 * s11 - s01 * s01
    det = F.when(F.abs(det) < 1e-12, 1e-12).otherwise(det)
    return (y0 * (s11 * y0 - s01 * y1) + y1 * (s00 * y1 - s01 * y0)) / det


def parse_phone_timestamp(text) -> Column:
    """``yyyy-MM-dd HH:mm:ss:f`` (1 to 6 fraction digits); NULL where it is anything else."""
    text = F.trim(_c(text))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss:SSSSSS"))


def elapsed_seconds(milliseconds) -> Column:
    return _c(milliseconds).cast("double") / 1000


def epoch_seconds(ts) -> Column:
    """Seconds since 1970 of a timestamp without time zone, to the microsecond."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`) / 1e6")


def stable_hash(seed: int, *parts) -> Column:
    """Order key: the first 16 hex digits of sha256('seed:part:part'); as text they sort as the unsigned number does."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[_c(p).cast("string") for p in parts]), 256), 1, 16)


def driver_of(path) -> Column:
    """X of a path that holds ``(Driver X)``, or ``unknown``."""
    found = F.trim(F.regexp_extract(_c(path), r"\(Driver\s+([^)]+)\)", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", "unknown").otherwise(found)


def content_hash(columns: list[str]) -> Column:
    """Hash of a row's content as a decimal, whose sum over rows does not depend on their order."""
    return F.xxhash64(F.to_json(F.struct(*columns))).cast("decimal(38,0)")
