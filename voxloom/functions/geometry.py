"""Column functions for points, rays, colours and rings. All stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI = math.pi


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def dot(a, b) -> Column:
    """Dot product of two 3-tuples of columns."""
    return col(a[0]) * col(b[0]) + col(a[1]) * col(b[1]) + col(a[2]) * col(b[2])


def cross(a, b) -> tuple[Column, Column, Column]:
    a, b = [col(c) for c in a], [col(c) for c in b]
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a, floor: float = 1e-10) -> tuple[Column, Column, Column]:
    n = F.greatest(norm(a), F.lit(floor))
    return tuple(col(c) / n for c in a)


def sub(a, b) -> tuple[Column, Column, Column]:
    return tuple(col(x) - col(y) for x, y in zip(a, b, strict=True))


def clamp(x, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def half_even(x, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.bround(col(x) / F.lit(step)) * F.lit(step)


def world_to_camera(p, rot: list[list], t) -> tuple[Column, Column, Column]:
    """R (p - t) for row-wise R of columns or numbers."""
    d = sub(p, t)
    return tuple(dot(tuple(col(c) for c in row), d) for row in rot)


def equirect(p, width: int, height: int) -> tuple[Column, Column, Column]:
    """(u, v, depth): u falls with azimuth, v grows with the angle from +z."""
    x, y, z = (col(c) for c in p)
    u = (F.lit(1.0) - (F.atan2(y, x) + F.lit(PI)) / F.lit(2 * PI)) * F.lit(float(width))
    v = F.atan2(F.sqrt(x * x + y * y), z) / F.lit(PI) * F.lit(float(height))
    return u, v, norm(p)


def sphere_to_uv(p) -> tuple[Column, Column]:
    """Unit vector to (u, v) in [-1, 1]."""
    x, y, z = (col(c) for c in p)
    u = -F.atan2(y, x) / F.lit(PI)
    v = F.atan2(F.sqrt(x * x + y * y), z) / F.lit(PI) * 2 - 1
    return u, v


def uv_to_sphere(u, v) -> tuple[Column, Column, Column]:
    theta, phi = (col(v) + 1) / 2 * F.lit(PI), -col(u) * F.lit(PI)
    return F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta)


def pinhole(p, focal: float, cx: float, cy: float, near: float = 0.1) -> tuple[Column, Column, Column]:
    """(u, v, in front): null pixels behind ``near``."""
    x, y, z = (col(c) for c in p)
    front = z > near
    return F.when(front, x / z * focal + cx), F.when(front, y / z * focal + cy), front


def in_bounds(u, v, width: int, height: int, margin: float = 0.0) -> Column:
    return col(u).between(-margin, width - 1 + margin) & col(v).between(-margin, height - 1 + margin)


def cell(value, n: int) -> Column:
    """Index of an image cell: truncated, then kept within 0..n-1."""
    return F.least(F.greatest(col(value).cast("int"), F.lit(0)), F.lit(n - 1))


def histogram_bin(value, low: float, high: float, n: int) -> Column:
    """Bin of a histogram with closed last bin; null outside."""
    inside = col(value).between(low, high)
    return F.when(inside, F.least(F.floor((col(value) - low) / ((high - low) / n)).cast("int"), F.lit(n - 1)))


def edge_crossing(px, py, ax, ay, bx, by) -> Column:
    """Whether a ray to +x from (px, py) crosses the edge a-b (half-open in y)."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    return ((ay > py) != (by > py)) & (px < F.try_divide((bx - ax) * (py - ay), by - ay) + ax)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment in the plane."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    t = clamp(F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0)), 0.0, 1.0)
    ex, ey = ax + t * dx - px, ay + t * dy - py
    return F.sqrt(ex * ex + ey * ey)


def rotation_from_ypr(yaw, pitch, roll) -> list[list[Column]]:
    """Rz(yaw) Ry(pitch) Rx(roll), row-wise."""
    cy, sy, cp, sp, cr, sr = F.cos(col(yaw)), F.sin(col(yaw)), F.cos(col(pitch)), F.sin(col(pitch)), F.cos(col(roll)), F.sin(col(roll))
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def ypr_of(rot: list[list]) -> tuple[Column, Column, Column]:
    """(yaw, pitch, roll) of such a rotation; pitch within a quarter turn."""
    r = [[col(c) for c in row] for row in rot]
    return F.atan2(r[1][0], r[0][0]), F.asin(clamp(-r[2][0], -1.0, 1.0)), F.atan2(r[2][1], r[2][2])


def snap_cardinal(nx, ny, nz) -> Column:
    """Nearest horizontal axis ('+x', '-x', '+z', '-z') of a wall normal, or 'floor' / 'ceiling' (y up). Ties go to z."""
    nx, ny, nz = col(nx), col(ny), col(nz)
    side = F.when(F.abs(nx) > F.abs(nz), F.when(nx >= 0, "+x").otherwise("-x")).otherwise(F.when(nz >= 0, "+z").otherwise("-z"))
    return F.when(ny > 0.5, "floor").when(ny < -0.5, "ceiling").otherwise(side)
