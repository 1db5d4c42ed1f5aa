"""Cross-sections: slabs, angular bins, median radii, circular fill, area."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import EPS
from .runs import circular_fill


def angle_bin(y: Column, z: Column, bins: int) -> Column:
    angle = F.pmod(F.atan2(z, y), F.lit(2 * math.pi))
    return F.least(F.floor(angle / (2 * math.pi) * bins).cast("int"), F.lit(bins - 1))


def station_of(s: Column, start: float, interval: float, thickness: float, count: int) -> Column:
    """The stations whose half-open slab holds s, as an array.

    With slabs no thicker than the interval there is one at most, so no range join is needed.
    """
    k_last = F.floor((s - start + thickness / 2) / interval).cast("int")
    reach = math.ceil(thickness / interval)
    some = F.array(*[k_last - i for i in range(reach + 1)])
    return F.filter(
        some,
        lambda k: (k >= 0)
        & (k < count)
        & (s >= start + k * interval - thickness / 2)
        & (s < start + k * interval + thickness / 2),
    )


def station_count(start: float, end: float, interval: float) -> int:
    return math.ceil((end + EPS - start) / interval) if end > start else 0


def wall(points: DataFrame, keys: Sequence[str], start: float, end: float, interval: float, thickness: float, bins: int) -> DataFrame:
    """``station_idx, bin, radius, n``: exact median radius of each occupied bin.

    ``points`` has chainage ``s`` and local ``y, z``.
    """
    count = station_count(start, end, interval)
    return (
        points.select(
            *keys,
            F.explode(station_of(F.col("s"), start, interval, thickness, count)).alias("station_idx"),
            angle_bin(F.col("y"), F.col("z"), bins).alias("bin"),
            F.sqrt(F.col("y") ** 2 + F.col("z") ** 2).alias("r"),
        )
        .groupBy(*keys, "station_idx", "bin")
        .agg(F.percentile("r", F.lit(0.5)).alias("radius"), F.count("*").alias("n"))
    )


def sections(
    points: DataFrame,
    keys: Sequence[str],
    start: float,
    end: float,
    interval: float,
    thickness: float,
    bins: int,
    min_points: int = 20,
    max_missing: int | None = None,
) -> DataFrame:
    """One row for each station: ``chainage, n_points, empty_bins, valid, area, radii``.

    Stations with too few points have no area and no radii; radii keep NULL for bins that only the area
    fills. Areas are polygons over bin centres: sin(2 pi / n) / 2 times the sum of r_i r_(i+1).
    """
    max_missing = bins // 10 if max_missing is None else max_missing
    count = station_count(start, end, interval)
    spark = points.sparkSession
    bins_found = wall(points, keys, start, end, interval, thickness, bins)
    totals = bins_found.groupBy(*keys, "station_idx").agg(
        F.sum("n").alias("n_points"),
        F.map_from_entries(F.collect_list(F.struct("bin", "radius"))).alias("_by_bin"),
    )
    series = (points.select(*keys).distinct() if keys else spark.range(1).drop("id"))
    grid = series.crossJoin(F.broadcast(spark.range(count).select(F.col("id").cast("int").alias("station_idx"))))
    rows = grid.join(totals, [*keys, "station_idx"], "left")
    enough = F.coalesce(F.col("n_points"), F.lit(0)) >= min_points
    radii = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.try_element_at("_by_bin", b))
    rows = rows.select(
        *keys,
        "station_idx",
        (start + F.col("station_idx") * interval).alias("chainage"),
        F.coalesce("n_points", F.lit(0)).cast("long").alias("n_points"),
        F.when(enough, radii).alias("radii"),
    )
    empty = F.coalesce(F.size(F.filter("radii", lambda r: r.isNull())), F.lit(bins))
    rows = rows.withColumn("empty_bins", F.when(F.col("radii").isNull(), F.lit(bins)).otherwise(empty))
    rows = rows.withColumn("valid", F.col("radii").isNotNull() & (F.col("empty_bins") <= max_missing))
    long = rows.filter("valid").select(*keys, "station_idx", F.posexplode("radii").alias("bin", "radius"))
    filled = circular_fill(long, [*keys, "station_idx"], "bin", "radius", bins)
    ring = filled.groupBy(*keys, "station_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "filled"))), lambda e: e.filled).alias("ring")
    )
    turned = F.concat(F.slice("ring", 2, bins - 1), F.slice("ring", 1, 1))
    product = F.aggregate(
        F.zip_with("ring", turned, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )
    areas = ring.select(*keys, "station_idx", (product * (0.5 * math.sin(2 * math.pi / bins))).alias("area"))
    return rows.join(areas, [*keys, "station_idx"], "left").select(
        *keys, "station_idx", "chainage", "n_points", "empty_bins", "valid", "area", "radii"
    )


def polygon_area(radii: Column, bins: int) -> Column:
    """Area of a ring without gaps, as one expression."""
    turned = F.concat(F.slice(radii, 2, bins - 1), F.slice(radii, 1, 1))
    total = F.aggregate(F.zip_with(radii, turned, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return total * (0.5 * math.sin(2 * math.pi / bins))
