"""Scalar geometry as column expressions: rigid and similarity transforms, cameras, spheres."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", names: Sequence[str] = ("x", "y", "z")) -> Vec:
    return tuple(F.col(f"{prefix}{n}") for n in names)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


class Similarity:
    """``p -> scale * R p + t``; a rigid transform has scale 1."""

    def __init__(self, rotation=None, translation=(0.0, 0.0, 0.0), scale: float = 1.0, tolerance=1e-6):
        self.r = np.eye(3) if rotation is None else np.asarray(rotation, dtype=float)
        self.t = np.asarray(translation, dtype=float)
        self.scale = float(scale)
        if np.abs(self.r.T @ self.r - np.eye(3)).max() > tolerance or np.linalg.det(self.r) < 0:
            raise ValueError("not a rotation")

    @classmethod
    def from_matrix(cls, matrix) -> Similarity:
        m = np.asarray(matrix, dtype=float)
        scale = np.cbrt(np.linalg.det(m[:3, :3]))
        return cls(m[:3, :3] / scale, m[:3, 3], scale)

    def inverse(self) -> Similarity:
        back = self.r.T
        return Similarity(back, -(back @ self.t) / self.scale, 1 / self.scale)

    def __matmul__(self, other: Similarity) -> Similarity:
        return Similarity(
            self.r @ other.r, self.scale * self.r @ other.t + self.t, self.scale * other.scale
        )

    def directions(self, v: Vec) -> Vec:
        """Rotation only."""
        return tuple(sum(float(self.r[i, j]) * v[j] for j in range(3)) for i in range(3))

    def apply(self, v: Vec) -> Vec:
        turned = self.directions(v)
        return tuple(self.scale * turned[i] + float(self.t[i]) for i in range(3))


def axis_rotation(axis: str, degrees: float) -> np.ndarray:
    """Rotation about x, y or z."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(3)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def quaternion_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion, which is scaled to length one."""
    n = w * w + x * x + y * y + z * z
    s = F.lit(2.0) / n
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y)],
    ]


def matrix_quaternion(m: Sequence[Sequence[Column]]) -> tuple[Column, Column, Column, Column]:
    """(w, x, y, z) with w >= 0, from the largest of the four squared components."""
    trace = m[0][0] + m[1][1] + m[2][2]
    squares = [1 + trace] + [1 + 2 * m[i][i] - trace for i in range(3)]
    largest = F.greatest(*squares)
    root = F.sqrt(F.greatest(largest, F.lit(0.0))) * 2  # four times the largest component
    d = [m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1]]
    s = {(0, 1): m[0][1] + m[1][0], (0, 2): m[0][2] + m[2][0], (1, 2): m[1][2] + m[2][1]}

    def component(k: int) -> Column:
        picked = F
        for big in range(4):
            if big == k:
                value = root / 4
            elif big == 0 or k == 0:
                value = d[max(big, k) - 1] / root
            else:
                value = s[tuple(sorted((big - 1, k - 1)))] / root
            picked = picked.when(squares[big] == largest, value)
        return picked

    q = [component(k) for k in range(4)]
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return tuple(sign * c for c in q)


def spherical(v: Vec) -> tuple[Column, Column, Column]:
    """(azimuth in [0, 2 pi), elevation, range); elevation 0 at the origin."""
    r = norm(v)
    azimuth = F.pmod(F.atan2(v[1], v[0]), F.lit(2 * math.pi))
    ratio = F.least(F.greatest(F.try_divide(v[2], r), F.lit(-1.0)), F.lit(1.0))
    return azimuth, F.when(r > 0, F.asin(ratio)).otherwise(0.0), r


def cartesian(azimuth: Column, elevation: Column, r: Column) -> Vec:
    flat = r * F.cos(elevation)
    return flat * F.cos(azimuth), flat * F.sin(azimuth), r * F.sin(elevation)


def equirect_uv(v: Vec, sign: int = 1, flip: bool = False, offset: float = 0.0) -> tuple[Column, Column]:
    """Unit panorama coordinates of a direction; u wraps, v runs from top (0) to bottom (1)."""
    azimuth, elevation, _ = spherical(v)
    turn = sign * azimuth / (2 * math.pi) + offset
    u = F.pmod(turn, F.lit(1.0))
    down = 0.5 - elevation / math.pi
    return u, (1 - down) if flip else down


def equirect_direction(u: Column, v: Column, sign: int = 1, flip: bool = False, offset: float = 0.0) -> Vec:
    down = (1 - v) if flip else v
    return cartesian(sign * (u - offset) * (2 * math.pi), (0.5 - down) * math.pi, F.lit(1.0))


def pinhole(v: Vec, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Image coordinates of a point in camera coordinates; a depth near 0 counts as 1e-12."""
    z = F.when(F.abs(v[2]) < 1e-12, F.lit(1e-12)).otherwise(v[2])
    return fx * v[0] / z + cx, fy * v[1] / z + cy


def visible(u: Column, v: Column, z: Column, width, height, near: float = 0.05) -> Column:
    return (z > near) & (u >= 0) & (u < width) & (v >= 0) & (v < height)


def back_project(u: Column, v: Column, depth: Column, fx, fy, cx, cy, pixel_centre: bool = False) -> Vec:
    """Camera coordinates of an image point; pixel indices (``pixel_centre``) count from their middle."""
    shift = 0.5 if pixel_centre else 0.0
    return (u + shift - cx) / fx * depth, (v + shift - cy) / fy * depth, depth


def rotation_errors(m: Sequence[Sequence[Column]]) -> tuple[Column, Column, Column]:
    """(determinant, largest deviation of RᵀR from the identity, verdict ok / warn / invalid)."""
    rows = [tuple(r) for r in m]
    determinant = dot(rows[0], cross(rows[1], rows[2]))
    columns = [tuple(m[i][j] for i in range(3)) for j in range(3)]
    gaps = [
        F.abs(dot(columns[i], columns[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)
    ]
    worst = F.greatest(*gaps)
    off = F.greatest(worst, F.abs(determinant - 1))
    verdict = F.when(off > 1e-4, "invalid").when(off > 1e-9, "warn").otherwise("ok")
    return determinant, worst, verdict


def signed_permutations() -> list[tuple[str, np.ndarray]]:
    """The 24 axis-aligned rotations in a fixed order, each with its label, e.g. ``+x-z+y``."""
    import itertools

    found = []
    for order in itertools.permutations(range(3)):
        for signs in itertools.product((1, -1), repeat=3):
            m = np.zeros((3, 3))
            for row, (axis, sign) in enumerate(zip(order, signs, strict=True)):
                m[row, axis] = sign
            if np.linalg.det(m) > 0:
                label = "".join("+-"[s < 0] + "xyz"[a] for a, s in zip(order, signs, strict=True))
                found.append((label, m))
    return found
