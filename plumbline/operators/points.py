"""Point clouds as tables: masks, colour, voxels, budgets, union, bounds, tiles, init cloud."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import checked


def keep_valid(df: DataFrame, state: str) -> DataFrame:
    """Rows whose invalid state is 0, on all columns at once."""
    return df.filter(F.col(state) == 0)


def rescale_colour(value: Column, lo: float | None, hi: float | None) -> Column:
    """Linear lo..hi to 0..255, rounded half-even and clipped; raw values if the limits tell nothing."""
    if lo is None or hi is None or hi <= lo:
        scaled = value
    else:
        scaled = (value - lo) / (hi - lo) * 255
    return F.least(F.greatest(F.rint(scaled), F.lit(0.0)), F.lit(255.0)).cast("short")


def voxel_key(size: float, columns: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    """Cell of a point: floor, also below zero."""
    return [F.floor(F.col(c) / size).cast("long").alias(f"k{c}") for c in columns]


def voxel_first(df: DataFrame, size: float, order_by: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The first point of each voxel; a size of 0 or less keeps all. Map-side: the least row of each cell."""
    if size <= 0:
        return df
    rest = [c for c in df.columns if c not in order_by]
    row = F.struct(*[F.col(c) for c in [*order_by, *rest]])
    return (
        df.groupBy(*keys, *voxel_key(size))
        .agg(F.min_by(row, F.struct(*[F.col(c) for c in order_by])).alias("_first"))
        .select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])
    )


def budget(df: DataFrame, keys: Sequence[str], most: int, seed: str, identity: Sequence[str]) -> DataFrame:
    """At most ``most`` rows of each key, drawn by a seeded digest of the row's identity."""
    digest = F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in identity]), 256)
    order = Window.partitionBy(*keys).orderBy("_digest", *identity)
    return (
        df.withColumn("_digest", digest)
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= most)
        .drop("_digest", "_rank")
    )


def even_pick(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], count: int) -> DataFrame:
    """Rows at the rounded places of an even spread of ``count`` over each key's rows."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    n = F.count("*").over(Window.partitionBy(*keys))
    placed = df.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", n)
    if count < 2:
        return placed.filter("_i = 0").drop("_i", "_n")
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda k: F.rint(k * (F.col("_n") - 1) / F.lit(float(count - 1))).cast("int"),
    )
    return placed.filter(F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def concat(a: DataFrame, b: DataFrame, required: Sequence[str] = ("x", "y", "z"), frame: str = "frame") -> DataFrame:
    """Union of two clouds: optional columns survive if both have them; the frame is the first one's."""
    common = [c for c in a.columns if c in b.columns]
    missing = [c for c in required if c not in common]
    if missing:
        raise ValueError(f"columns not on both sides: {missing}")
    second = b.select(*common)
    if frame in common:
        named = a.select(frame).limit(1).collect()
        if named:
            second = second.withColumn(frame, F.lit(named[0][0]))
    return a.select(*common).unionByName(second)


def bounds(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``n``, least, greatest and mean coordinates, and the longest side."""
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.min(c).alias(f"min_{c}") for c in "xyz"],
        *[F.max(c).alias(f"max_{c}") for c in "xyz"],
        *[F.avg(c).alias(f"mean_{c}") for c in "xyz"],
        F.greatest(*spans).alias("span"),
    )


def valid_bounds(lo: Sequence[Column], hi: Sequence[Column]) -> Column:
    """Finite, and least <= greatest on every axis."""
    ok = F.lit(True)
    for a, b in zip(lo, hi, strict=True):
        ok = ok & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf")) & ~F.isnan(a) & ~F.isnan(b) & (a <= b)
    return F.coalesce(ok, F.lit(False))


def local_origin(df: DataFrame, step: float = 0.1) -> DataFrame:
    """Mean coordinates on a grid, half-even."""
    return df.agg(*[(F.rint(F.avg(c) / step) * step).alias(c) for c in "xyz"])


def tiles(df: DataFrame, length: float, buffer: float) -> DataFrame:
    """Square tiles in x and y: a point is in its own tile (``core``) and in tiles whose buffer holds it."""
    lo = [F.floor((F.col(c) - buffer) / length).cast("long") for c in "xy"]
    hi = [F.floor((F.col(c) + buffer) / length).cast("long") for c in "xy"]
    wide = df.withColumn("tile_x", F.explode(F.sequence(lo[0], hi[0]))).withColumn(
        "tile_y", F.explode(F.sequence(lo[1], hi[1]))
    )
    own = (F.col("tile_x") == F.floor(F.col("x") / length)) & (F.col("tile_y") == F.floor(F.col("y") / length))
    return wide.withColumn("core", own)


def init_cloud(scans: DataFrame, held_out: Column, scan_voxel: float, voxel: float, order_by: Sequence[str], scan: str = "scan") -> tuple[DataFrame, DataFrame]:
    """(points, counts by scan): holdout removed, thinned by scan, united and thinned again."""
    tagged = scans.withColumn("_out", held_out)
    kept = tagged.filter(~F.col("_out")).drop("_out")
    by_scan = voxel_first(kept, scan_voxel, order_by, [scan])
    out = voxel_first(by_scan, voxel, order_by)
    read = tagged.groupBy(scan).agg(F.count("*").alias("read"), F.count_if("_out").alias("removed"))
    thinned = by_scan.groupBy(scan).agg(F.count("*").alias("thinned"))
    final = out.groupBy(scan).agg(F.count("*").alias("kept"))
    counts = read.join(thinned, scan, "left").join(final, scan, "left").fillna(0, ["thinned", "kept"])
    return out, counts


def refuse_in_holdout(df: DataFrame, held_out: Column, message: str = "a point lies in the holdout") -> DataFrame:
    """Re-reads with an error at the first row in the holdout."""
    first = df.columns[0]
    return df.withColumn(first, checked(F.col(first), ~held_out, message))
