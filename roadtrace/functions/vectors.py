"""Small 3-vectors as triples of Columns: gravity frame, rotations, mounting angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadtrace.functions.geo import _c

Vec = tuple[Column, Column, Column]


def vec(*columns) -> Vec:
    x, y, z = (_c(c) for c in columns)
    return x, y, z


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def scale(a: Vec, k: Column) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def unit(a: Vec, floor: float = 1e-6) -> Vec:
    return scale(a, 1 / F.greatest(norm(a), F.lit(floor)))


def gravity_frame(acc: Vec, gravity: Vec) -> dict[str, Column]:
    """Linear acceleration, gravity direction, and the vertical and horizontal parts of the former."""
    linear, up = minus(acc, gravity), unit(gravity)
    vertical = dot(linear, up)
    flat = minus(linear, scale(up, vertical))
    names = ("linear_x", "linear_y", "linear_z"), ("up_x", "up_y", "up_z")
    return dict(zip(names[0], linear, strict=True)) | dict(zip(names[1], up, strict=True)) | {"linear_vertical": vertical, "linear_horizontal": norm(flat)}


def mounting_invariant(acc: Vec, gravity: Vec, gyro: Vec) -> dict[str, Column]:
    """Six channels that do not depend on how the phone is mounted."""
    frame = gravity_frame(acc, gravity)
    linear, up = vec_of(frame, "linear"), vec_of(frame, "up")
    yaw = dot(gyro, up)
    flat = minus(gyro, scale(up, yaw))
    return {"linear_norm": norm(linear), "linear_vertical": frame["linear_vertical"], "linear_horizontal": frame["linear_horizontal"], "gyro_norm": norm(gyro), "yaw_rate": yaw, "gyro_horizontal": norm(flat)}


def vec_of(columns: dict[str, Column], prefix: str) -> Vec:
    return columns[f"{prefix}_x"], columns[f"{prefix}_y"], columns[f"{prefix}_z"]


def rotate_euler_zxy(yaw, pitch, roll, v: Vec) -> Vec:
    """Turn by yaw about z, then pitch about x, then roll about y of the fixed axes (degrees)."""
    (cz, sz), (cx, sx), (cy, sy) = ((F.cos(F.radians(_c(a))), F.sin(F.radians(_c(a)))) for a in (yaw, pitch, roll))
    x, y, z = v[0] * cz - v[1] * sz, v[0] * sz + v[1] * cz, v[2]
    y, z = y * cx - z * sx, y * sx + z * cx
    return x * cy + z * sy, y, z * cy - x * sy


def rotate_plane(x, y, angle) -> tuple[Column, Column]:
    """Turn (x, y) by an angle in radians."""
    x, y, angle = map(_c, (x, y, angle))
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def compass_azimuth(mag: Vec, up: Vec) -> Column:
    """Azimuth of the phone's +Y axis clockwise from magnetic north; null where the field or the axis has no horizontal part."""
    y = (F.lit(0.0), F.lit(1.0), F.lit(0.0))
    mh = minus(mag, scale(up, dot(mag, up)))
    yh = minus(y, scale(up, dot(y, up)))
    ok = (dot(mag, mag) >= 1e-6) & (norm(mh) >= 1e-3) & (norm(yh) >= 1e-3)
    return F.when(ok, F.atan2(-dot(cross(unit(mh, 1e-12), unit(yh, 1e-12)), up), dot(unit(mh, 1e-12), unit(yh, 1e-12))))


def phone_to_vehicle(v: Vec, forward: Vec, left: Vec, up: Vec) -> Vec:
    """Components of ``v`` along the vehicle axes, which are given in phone coordinates."""
    return dot(v, forward), dot(v, left), dot(v, up)


def mount_angles(up: Vec, forward: Vec) -> dict[str, Column]:
    """Pitch, roll and yaw in degrees of the phone on its mount."""
    f, u = unit(forward), unit(up)
    left = unit(cross(u, f))
    pitch = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), -f[2])))
    return {"pitch": F.degrees(pitch), "roll": F.degrees(F.atan2(left[2], u[2])), "yaw": F.degrees(F.atan2(f[1], f[0]))}


def soft_deadband(a, band) -> Column:
    """0 inside +-band, outside it the excess."""
    a, band = _c(a), _c(band)
    return F.when(a > band, a - band).when(a < -band, a + band).when(a.isNotNull(), 0.0)
