"""Linear referencing: chainage along an axis, points and frames on it, projection of points to it."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import EPS, ContractError
from .intervals import in_ranges, touches
from .transforms import Vec, cross, dot, minus, norm

#: Segments that are inlined as literals, which code generation unrolls; longer axes go through Arrow batches.
#: Distances from points to segments that a worker holds at once.
PAIRS = 1 << 20
INLINE_SEGMENTS = 8


def chainage(vertices: DataFrame, order_by: str, keys: Sequence[str] = (), offset: float = 0.0) -> DataFrame:
    """Vertices with their chainage ``s``; one that repeats its predecessor is dropped."""
    order = Window.partitionBy(*keys).orderBy(order_by)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(order)) ** 2 for c in "xyz"))
    kept = vertices.withColumn("_step", step).filter(F.col("_step").isNull() | (F.col("_step") >= EPS))
    return kept.withColumn("s", offset + F.sum(F.coalesce("_step", F.lit(0.0))).over(order)).drop("_step")


def segments(vertices: DataFrame, order_by: str, keys: Sequence[str] = (), offset: float = 0.0) -> DataFrame:
    """``seg_idx, s0, s1, ax..az, bx..bz`` of the polyline."""
    order = Window.partitionBy(*keys).orderBy("s")
    ahead = lambda c: F.lead(c).over(order)
    return (
        chainage(vertices, order_by, keys, offset)
        .select(
            *keys,
            (F.row_number().over(order) - 1).alias("seg_idx"),
            F.col("s").alias("s0"),
            ahead("s").alias("s1"),
            *[F.col(c).alias(f"a{c}") for c in "xyz"],
            *[ahead(c).alias(f"b{c}") for c in "xyz"],
        )
        .filter(F.col("s1").isNotNull())
    )


@dataclass
class Axis:
    """A polyline on the driver: chainages and vertices of at most some thousand rows."""

    s: np.ndarray
    xyz: np.ndarray

    @classmethod
    def collect(cls, vertices: DataFrame, order_by: str, offset: float = 0.0, most: int = 100_000) -> Axis:
        rows = chainage(vertices, order_by, offset=offset).select("s", "x", "y", "z").orderBy("s")
        found = rows.limit(most + 1).collect()
        if len(found) > most:
            raise ContractError(f"an axis of over {most} vertices")
        if len(found) < 2:
            raise ContractError("an axis needs two vertices")
        table = np.array(found, dtype=float)
        return cls(table[:, 0], table[:, 1:])

    @property
    def length(self) -> float:
        return float(self.s[-1] - self.s[0])

    def resample(self, step: float = 0.25) -> Axis:
        n = max(2, math.ceil(self.length / step) + 1)
        s = np.linspace(self.s[0], self.s[-1], n)
        return Axis(s, np.c_[tuple(np.interp(s, self.s, self.xyz[:, i]) for i in range(3))])

    def rows(self) -> list[tuple[float, ...]]:
        return [
            (float(a), float(b), *map(float, p), *map(float, q))
            for a, b, p, q in zip(self.s[:-1], self.s[1:], self.xyz[:-1], self.xyz[1:], strict=True)
        ]


def stations(start: float, end: float, step: float, axis: Axis | None = None) -> list[float]:
    """Places from start to end; counted, not added up, so no error builds up."""
    if axis is not None:
        start, end = max(start, float(axis.s[0])), min(end, float(axis.s[-1]))
    if end <= start:
        return []
    return [start + k * step for k in range(math.ceil((end + EPS - start) / step))]


def located(points: DataFrame, segs: DataFrame, s: str = "s") -> DataFrame:
    """Each row with the segment that its chainage, clipped to the ends, lies in.

    A segment owns its start; the last one also owns its end. Rows and segments meet by key, in pieces of
    equal length of the axis, as many as it has segments; segments are broadcast only if they are counted few.
    """
    ends = segs.agg(F.min("s0").alias("_first"), F.max("s1").alias("_last"), F.count("*").alias("_n"))
    first, last, n = ends.first()
    if not n:
        raise ContractError("an axis without segments")
    width = max((last - first) / n, 1e-9)
    piece = lambda c: F.floor((c - first) / width).cast("long")
    side = segs.withColumn("_piece", F.explode(F.sequence(piece(F.col("s0")), piece(F.col("s1")))))
    side = F.broadcast(side) if n <= 100_000 else side
    clipped = F.least(F.greatest(F.col(s), F.lit(first)), F.lit(last))
    rows = points.withColumn("_s", clipped).withColumn("_piece", piece(F.col("_s")))
    inside = (F.col("_s") >= F.col("s0")) & ((F.col("_s") < F.col("s1")) | (F.col("s1") == last) & (F.col("_s") == last))
    return rows.join(side, "_piece").filter(inside).drop("_piece")


def _between(prefix_a: str, prefix_b: str, share: Column) -> Vec:
    return tuple(F.col(f"{prefix_a}{c}") + (F.col(f"{prefix_b}{c}") - F.col(f"{prefix_a}{c}")) * share for c in "xyz")


def points_at(points: DataFrame, segs: DataFrame, s: str = "s") -> DataFrame:
    """Rows with ``px, py, pz`` on the axis and its tangent ``tx, ty, tz``."""
    share = (F.col("_s") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    place = _between("a", "b", share)
    along = minus(tuple(F.col(f"b{c}") for c in "xyz"), tuple(F.col(f"a{c}") for c in "xyz"))
    size = norm(along)
    return located(points, segs, s).select(
        *points.columns,
        *[p.alias(f"p{c}") for p, c in zip(place, "xyz", strict=True)],
        *[(t / size).alias(f"t{c}") for t, c in zip(along, "xyz", strict=True)],
    )


def section_frame(tangent: Vec) -> tuple[Vec, Vec, Vec]:
    """(x, y, z): x along, y = up x t, z = t x y; up is y where the axis is all but vertical."""
    steep = F.abs(tangent[2]) > 0.99
    up = (F.lit(0.0), F.when(steep, 1.0).otherwise(0.0), F.when(steep, 0.0).otherwise(1.0))
    side = cross(up, tangent)
    size = norm(side)
    y = tuple(c / size for c in side)
    return tangent, y, cross(tangent, y)


def _to_segment(p: Vec, row: tuple[float, ...]) -> tuple[Column, Column]:
    """(squared distance, chainage) of the nearest place of a segment (s0, s1, a, b)."""
    s0, s1, *rest = row
    a, b = rest[:3], rest[3:]
    d = [y - x for x, y in zip(a, b, strict=True)]
    along = sum((c - x) * y for c, x, y in zip(p, a, d, strict=True))
    share = F.least(F.greatest(along / sum(y * y for y in d), F.lit(0.0)), F.lit(1.0))
    off = tuple(c - (x + share * y) for c, x, y in zip(p, a, d, strict=True))
    return dot(off, off), F.lit(s0) + share * (s1 - s0)


def project(points: DataFrame, axis: Axis, step: float | None = None, rule: str = "segments") -> DataFrame:
    """Rows with chainage ``s`` and distance ``radial`` of the nearest place on the axis.

    No row is shuffled: the axis goes to the points. By the rule "segments" all segments are tried and
    the least (distance, s) wins; by the rule "vertex" only the segments on both sides of the nearest vertex
    (ties: the first) are, as on an axis resampled to ``step``.
    """
    if rule not in ("segments", "vertex"):
        raise ContractError(f"the rule is segments or vertex, not {rule}")
    axis = axis.resample(step) if step else axis
    rows = axis.rows()
    if rule == "segments" and len(rows) <= INLINE_SEGMENTS:
        p = tuple(F.col(c) for c in "xyz")
        near = [_to_segment(p, r) for r in rows]
        tried = [F.struct(d2.alias("d2"), s.alias("s")) for d2, s in near]
        best = F.least(*tried) if len(tried) > 1 else tried[0]
        return points.withColumn("_best", best).select(
            *points.columns, F.col("_best.s").alias("s"), F.sqrt("_best.d2").alias("radial")
        )
    s, xyz = axis.s, axis.xyz
    block = max(1, PAIRS // len(xyz))
    place = _nearest_of_all if rule == "segments" else _nearest_by_vertex

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            q = np.c_[tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in "xyz")].astype(float)
            found = [place(q[i : i + block], s, xyz) for i in range(0, len(q), block)]
            at, off = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at), pa.array(off)], names=[*batch.schema.names, "s", "radial"]
            )

    from pyspark.sql import types as T

    schema = T.StructType([*points.schema.fields, T.StructField("s", T.DoubleType()), T.StructField("radial", T.DoubleType())])
    return points.mapInArrow(run, schema)


def _on_segments(q: np.ndarray, k: np.ndarray, s: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, chainage) of the places of each point on its segment ``k``."""
    a, d = xyz[k], xyz[k + 1] - xyz[k]
    share = np.clip(((q - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
    off = q - a - d * share[:, None]
    return (off * off).sum(axis=1), s[k] + (s[k + 1] - s[k]) * share


def _nearest_of_all(q: np.ndarray, s: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, d = xyz[:-1], np.diff(xyz, axis=0)
    share = np.clip((q @ d.T - (a * d).sum(axis=1)) / (d * d).sum(axis=1), 0, 1)
    d2 = sum((q[:, c, None] - a[None, :, c] - d[None, :, c] * share) ** 2 for c in range(3))
    k = d2.argmin(axis=1)
    at = np.arange(len(q))
    return s[k] + (s[k + 1] - s[k]) * share[at, k], np.sqrt(d2[at, k])


def _nearest_by_vertex(q: np.ndarray, s: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = sum((q[:, c, None] - xyz[None, :, c]) ** 2 for c in range(3)).argmin(axis=1)
    last = len(xyz) - 2
    before, after = _on_segments(q, np.maximum(v - 1, 0), s, xyz), _on_segments(q, np.minimum(v, last), s, xyz)
    nearer = after[0] < before[0]
    return np.where(nearer, after[1], before[1]), np.sqrt(np.where(nearer, after[0], before[0]))


def located_ok(s: Column, radial: Column, first: float, last: float, most: float = 10.0) -> Column:
    """Finite, near the axis and not at or past its ends."""
    return F.coalesce(~F.isnan(s) & (radial <= most) & (s > first) & (s < last), F.lit(False))


def classify(ok: Column, s: Column, ray_lo: Column, ray_hi: Column, holdout: Sequence[tuple[float, float]], margin: float = 0.5) -> Column:
    """One reason for each row: unlocated, then in the holdout, then its ray touches it, else keep."""
    return (
        F.when(~ok, "unlocated")
        .when(in_ranges(s, holdout), "holdout_point")
        .when(touches(ray_lo - margin, ray_hi + margin, holdout), "holdout_ray")
        .otherwise("keep")
    )


def segment_touches(rows: DataFrame, id_col: str, axis: Axis, holdout: Sequence[tuple[float, float]], step: float = 0.1, margin: float = 0.5) -> DataFrame:
    """``id, touches`` of lines (ax..az)-(bx..bz): sampled every ``step`` with both ends; a sample
    that can't be located or is near the holdout counts as touching."""
    a, b = tuple(F.col(f"a{c}") for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz")
    n = F.greatest(F.ceil(norm(minus(b, a)) / step), F.lit(1)).cast("int")
    place = _between("a", "b", F.col("_k") / F.col("_n"))
    samples = (
        rows.withColumn("_n", n)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .select(id_col, *[p.alias(c) for p, c in zip(place, "xyz", strict=True)])
    )
    on_axis = project(samples, axis)
    wide = [(lo - margin, hi + margin) for lo, hi in holdout]
    ok = located_ok(F.col("s"), F.col("radial"), float(axis.s[0]), float(axis.s[-1]))
    return on_axis.groupBy(id_col).agg(F.bool_or(~ok | in_ranges(F.col("s"), wide)).alias("touches"))


def principal_axis(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, unit direction) of a cloud; the largest component of the direction is positive.

    One aggregation about a pivot, so that large offsets lose no digits; 3 x 3 eigenvectors on the driver.
    """
    first = points.select("x", "y", "z").first()
    if first is None:
        raise ContractError("no points")
    shifted = {c: F.col(c) - first[c] for c in "xyz"}
    moments = [F.sum(shifted[a] * shifted[b]).alias(f"{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]]
    row = points.agg(F.count("*").alias("n"), *[F.sum(shifted[c]).alias(c) for c in "xyz"], *moments).first()
    mean = np.array([row[c] for c in "xyz"]) / row.n
    cov = np.array([[row["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"]) / row.n - np.outer(mean, mean)
    direction = np.linalg.eigh(cov)[1][:, -1]
    if direction[np.abs(direction).argmax()] < 0:
        direction = -direction
    return mean + np.array([first[c] for c in "xyz"]), direction


def axis_bins(points: DataFrame, along: Column, width: float, least: int = 20) -> DataFrame:
    """``bin, n, x, y, z``: centroids of slices along a direction that hold enough points."""
    return (
        points.groupBy(F.floor(along / width).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"])
        .filter(F.col("n") >= least)
    )


def extract_axis(points: DataFrame, width: float, least: int = 20) -> DataFrame:
    """Axis vertices of a cloud: slice centroids along its principal axis, smoothed over three, ends raw."""
    from .runs import moving_average

    centre, direction = principal_axis(points)
    along = sum((F.col(c) - float(o)) * float(d) for c, o, d in zip("xyz", centre, direction, strict=True))
    return moving_average(axis_bins(points, along, width, least), [], "bin", ["x", "y", "z"])
