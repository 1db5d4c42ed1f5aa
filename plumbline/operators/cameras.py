"""Normalising transforms of a set of cameras and of a cloud; sums and medians are aggregates, 3 x 3 algebra
is done on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError
from .transforms import Similarity


def _rotated(r: np.ndarray, v) -> list:
    return [sum(F.lit(float(r[i, j])) * v[j] for j in range(3)) for i in range(3)]


def _medians(df: DataFrame, columns: dict) -> np.ndarray:
    return np.array(df.agg(*[F.percentile(c, F.lit(0.5)).alias(n) for n, c in columns.items()]).first(), dtype=float)


def _upright(up: np.ndarray) -> np.ndarray:
    """The least rotation that brings ``up`` to (0, -1, 0); half a turn about z if it is the opposite."""
    to = np.array([0.0, -1.0, 0.0])
    cosine = float(up @ to)
    if cosine <= -1 + 1e-12:
        return np.diag([-1.0, -1.0, 1.0])
    x, y, z = np.cross(up, to)
    turn = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + turn + turn @ turn / (1 + cosine)


def normalising(cameras: DataFrame, strict: bool = False, centre: str = "focus") -> Similarity:
    """World to a normal frame: the mean up of the cameras becomes -y, what they look at (the median of the
    points of their axes nearest to the origin, or of their places if ``centre`` is "poses") the origin, and the
    median (``strict``: greatest) distance of their places 1.

    ``cameras``: r00 .. r22 (camera to world), tx, ty, tz.
    """
    if centre not in ("focus", "poses"):
        raise ContractError(f"centre is focus or poses, not {centre}")
    n, *up = cameras.agg(F.count("*"), *[-F.avg(f"r{i}1") for i in range(3)]).first()
    if not n:
        raise ContractError("no cameras")
    up = np.array(up, dtype=float)
    if np.linalg.norm(up) < 1e-12:
        raise ContractError("the cameras' up directions cancel")
    r = _upright(up / np.linalg.norm(up))
    place = _rotated(r, [F.col(f"t{c}") for c in "xyz"])
    ahead = _rotated(r, [F.col(f"r{i}2") for i in range(3)])
    along = sum(a * b for a, b in zip(ahead, place, strict=True))
    of = [p - along * a for p, a in zip(place, ahead, strict=True)] if centre == "focus" else place
    shift = -_medians(cameras, dict(zip("xyz", of, strict=True)))
    distance = F.sqrt(sum((p + float(s)) ** 2 for p, s in zip(place, shift, strict=True)))
    size = cameras.agg(F.max(distance) if strict else F.percentile(distance, F.lit(0.5))).first()[0]
    if not size:
        raise ContractError("the cameras stand in one place")
    return Similarity(r, shift / size, 1 / size)


def principal_frame(points: DataFrame) -> Similarity:
    """World to the principal axes of a cloud, longest first, about its median."""
    centre = _medians(points, {c: F.col(c) for c in "xyz"})
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    at = [F.col(c) - float(m) for c, m in zip("xyz", centre, strict=True)]
    row = points.agg(*[F.covar_samp(at[i], at[j]).alias(f"c{i}{j}") for i, j in pairs]).first()
    if row[0] is None:
        raise ContractError("too few points")
    cov = np.zeros((3, 3))
    for (i, j), value in zip(pairs, row, strict=True):
        cov[i, j] = cov[j, i] = value
    values, vectors = np.linalg.eigh(cov)
    vectors = vectors[:, values.argsort()[::-1]]
    if np.linalg.det(vectors) < 0:
        vectors[:, 0] *= -1
    return Similarity(vectors.T, -vectors.T @ centre)
