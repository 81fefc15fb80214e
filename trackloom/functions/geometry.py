"""Camera geometry as column expressions: no UDF, so all of it stays in whole-stage code.

Divisions by a vanishing denominator give NULL.  ``c`` is an array column of 11
(space) or 8 (plane) direct-linear-transformation coefficients.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def project(c: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Pixel (u, v) of a point in space."""
    below = x * c[8] + y * c[9] + z * c[10] + 1
    return ratio(x * c[0] + y * c[1] + z * c[2] + c[3], below), ratio(x * c[4] + y * c[5] + z * c[6] + c[7], below)


def project_plane(c: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """Pixel (u, v) of a point of the calibrated plane."""
    below = x * c[6] + y * c[7] + 1
    return ratio(x * c[0] + y * c[1] + c[2], below), ratio(x * c[3] + y * c[4] + c[5], below)


def on_ray(c: Column, u: Column, v: Column, z: float) -> tuple[Column, Column]:
    """(x, y) at height ``z`` of the ray through a pixel: a 2 x 2 Cramer solution."""
    a, b, p = u * c[8] - c[0], u * c[9] - c[1], c[3] - u - (u * c[10] - c[2]) * z
    d, e, q = v * c[8] - c[4], v * c[9] - c[5], c[7] - v - (v * c[10] - c[6]) * z
    det = a * e - b * d
    return ratio(p * e - b * q, det), ratio(a * q - p * d, det)


def epipolar_line(c1: Column, c2: Column, u: Column, v: Column, reach: float = 500.0) -> tuple[Column, Column]:
    """Slope and intercept in the second image of the ray through a pixel of the first; NULL if vertical."""
    ends = [project(c2, *on_ray(c1, u, v, z), F.lit(z)) for z in (reach, -reach)]
    (u1, v1), (u2, v2) = ends
    slope = ratio(v2 - v1, u2 - u1)
    return slope, v1 - slope * u1


def distort(u: Column, v: Column, f1: Column, f2: Column, cx: Column, cy: Column, k: list[Column]) -> tuple[Column, Column]:
    """The forward lens model in closed form: where an undistorted pixel is seen."""
    f = (f1 + f2) / 2
    x, y = (u - cx) / f, (v - cy) / f
    radial, dx, dy = lens_terms(x, y, k)
    return (x * radial + dx) * f + cx, (y * radial + dy) * f + cy


def lens_terms(x: Column, y: Column, k: list[Column]) -> tuple[Column, Column, Column]:
    r2 = x * x + y * y
    radial = 1 + k[0] * r2 + k[1] * r2 * r2 + k[4] * r2 * r2 * r2
    return radial, 2 * k[2] * x * y + k[3] * (r2 + 2 * x * x), k[2] * (r2 + 2 * y * y) + 2 * k[3] * x * y


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def euler_matrix(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Inertial-to-body rotation for yaw, then pitch, then roll (radians); its transpose goes back."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return [
        [cp * cy, cp * sy, -sp],
        [sr * sp * cy - cr * sy, sr * sp * sy + cr * cy, sr * cp],
        [cr * sp * cy + sr * sy, cr * sp * sy - sr * cy, cr * cp],
    ]


def transpose(m: list[list[Column]]) -> list[list[Column]]:
    return [list(row) for row in zip(*m)]


def apply_matrix(m: list[list[Column]], x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    return tuple(row[0] * x + row[1] * y + row[2] * z for row in m)


def rotate_about(point: tuple[Column, ...], axis: tuple[Column, ...], angle: Column) -> tuple[Column, ...]:
    """Rotation about a unit axis with the cross product point x axis, so positive angles turn left-handed."""
    (x, y, z), (a, b, c) = point, axis
    dot, co, si = a * x + b * y + c * z, F.cos(angle), F.sin(angle)
    cross = (y * c - z * b, z * a - x * c, x * b - y * a)
    return tuple(p * co + q * si + n * dot * (1 - co) for p, q, n in zip(point, cross, axis))


def wing_vertex(vertex: tuple[Column, ...], axes: list[tuple[Column, ...]], angles: list[Column], root: tuple[Column, ...], body: list[list[Column]], center: tuple[Column, ...]) -> tuple[Column, ...]:
    """World position of a wire-frame vertex: three axis rotations, the root, the body's attitude, its center."""
    for axis, angle in zip(axes, angles):
        vertex = rotate_about(vertex, axis, angle)
    vertex = tuple(p + r for p, r in zip(vertex, root))
    return tuple(p + c for p, c in zip(apply_matrix(transpose(body), *vertex), center))


def video_frame(frame: Column, rate: Column, first_rate: Column, offset: Column, n_frames: Column) -> Column:
    """Frame of a camera's own video at a master frame; NULL before its first or after its last."""
    own = F.round(frame * ratio(rate, first_rate) + F.coalesce(offset, F.lit(0.0))).cast("int")
    return F.when(own.between(F.lit(1), n_frames), own)


def gamma_scale(value: Column, low: Column, high: Column, gamma: float) -> Column:
    """Rescale to 0..1 and raise to ``gamma``; a flat patch is 0."""
    return F.coalesce(F.pow(ratio(value - low, high - low), F.lit(gamma)), F.lit(0.0))


def clamp_input(value: Column, low: Column, high: Column, before: Column) -> Column:
    """A typed number rounded and clamped; what is no number leaves the value before."""
    number = F.round(value.try_cast("double"))
    return F.when(number.isNotNull() & ~F.isnan(number), F.greatest(low, F.least(high, number))).otherwise(before)  # least() passes over NULL
