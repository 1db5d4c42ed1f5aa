"""Triangle meshes: volume and area-weighted sampling of the surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .transforms import cross, dot, minus, norm


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces (face, a, b, c) with the coordinates ax..cz of their corners."""
    out = faces
    for k in "abc":
        side = vertices.select(F.col("vertex").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"])
        out = out.join(side, k)
    return out


def volume(triangles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """|sum of a . (b x c)| / 6."""
    a, b, c = (tuple(F.col(f"{k}{x}") for x in "xyz") for k in "abc")
    return triangles.groupBy(*keys).agg((F.abs(F.sum(dot(a, cross(b, c)))) / 6).alias("volume"))


def sample_surface(triangles: DataFrame, count: int, seed: int = 0, id_col: str = "face") -> DataFrame:
    """``sample, x, y, z``: points spread by area.

    Each face gets the samples whose even places on the cumulative area it covers; where a sample lies in
    its face is a hash of its number.
    """
    a, b, c = (tuple(F.col(f"{k}{x}") for x in "xyz") for k in "abc")
    area = norm(cross(minus(b, a), minus(c, a))) / 2
    order = Window.orderBy(id_col)
    everything = Window.partitionBy()
    placed = triangles.withColumn("_area", area).withColumn("_to", F.sum("_area").over(order)).withColumn("_all", F.sum("_area").over(everything))
    first = F.ceil((F.col("_to") - F.col("_area")) / F.col("_all") * count - 0.5)
    last = F.ceil(F.col("_to") / F.col("_all") * count - 0.5) - 1
    rows = placed.withColumn("_f", first).withColumn("_l", last).filter("_l >= _f").withColumn("sample", F.explode(F.sequence(F.col("_f"), F.col("_l"))))
    u = F.sqrt(F.pmod(F.xxhash64(F.lit(seed), "sample"), F.lit(1 << 30)) / float(1 << 30))
    v = F.pmod(F.xxhash64(F.lit(seed + 1), "sample"), F.lit(1 << 30)) / float(1 << 30)
    place = [p * (1 - u) + q * (u * (1 - v)) + r * (u * v) for p, q, r in zip(a, b, c, strict=True)]
    return rows.select("sample", *[p.alias(x) for p, x in zip(place, "xyz", strict=True)])
