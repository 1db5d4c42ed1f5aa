"""Images as tables: projection, z-buffers, occlusion, visibility, grids, sampling, PSNR, SSIM."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import ContractError
from .transforms import equirect_uv, pinhole, visible

MOST_CAMERAS = 100_000
#: Cells with a least depth that are sent to the points; beyond, both sides meet by key.
MOST_CELLS = 200_000


def project_all(points: DataFrame, cameras: DataFrame, near: float = 0.05) -> DataFrame:
    """Points seen by each camera with ``u, v, depth``.

    Cameras (camera_id, r00..r22, tx, ty, tz, fx, fy, cx, cy, width, height; world to camera) are few, are
    counted, and go to the points.
    """
    if cameras.count() > MOST_CAMERAS:
        raise ContractError(f"over {MOST_CAMERAS} cameras")
    both = points.crossJoin(F.broadcast(cameras))
    p = [F.col(c) for c in "xyz"]
    local = tuple(sum(F.col(f"r{i}{j}") * p[j] for j in range(3)) + F.col(f"t{'xyz'[i]}") for i in range(3))
    u, v = pinhole(local, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    # generated, not projected: else every later use of u, v and depth repeats the whole expression, and the
    # generated code grows beyond what the JVM compiles
    image = F.explode(F.array(F.struct(u.alias("u"), v.alias("v"), local[2].alias("depth"))))
    seen = both.select(*points.columns, "camera_id", "width", "height", image.alias("_p"))
    seen = seen.select("*", "_p.u", "_p.v", "_p.depth")
    seen = seen.filter(visible(F.col("u"), F.col("v"), F.col("depth"), F.col("width"), F.col("height"), near))
    return seen.select(*points.columns, "camera_id", "u", "v", "depth")


def z_buffer(seen: DataFrame, keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """``row, col, depth``: least depth, as float, of each pixel that anything falls on."""
    return seen.groupBy(
        *keys, F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col")
    ).agg(F.min(F.col("depth").cast("float")).alias("depth"))


def nearest_visible(seen: DataFrame, keys: Sequence[str], cell: float, reach: int, tolerance: float, order_by: Sequence[str]) -> DataFrame:
    """The nearest point of each cell that no nearer surface around hides.

    A cell's point stays if its depth is at most (1 + tolerance) times the least depth in the
    ``reach`` x ``reach`` cells about it (odd). Cells send their depth to their neighbours by key.
    """
    placed = seen.withColumn("_r", F.floor(F.col("v") / cell).cast("int")).withColumn("_c", F.floor(F.col("u") / cell).cast("int"))
    # the least depth of a cell is a plain hash aggregate; only rows at it are compared as whole rows
    least = placed.groupBy(*keys, "_r", "_c").agg(F.min("depth").alias("_z"))
    side = F.broadcast(least) if least.count() <= MOST_CELLS else least
    place = F.row_number().over(Window.partitionBy(*keys, "_r", "_c").orderBy(*order_by))
    first = (
        placed.join(side, [*keys, "_r", "_c"])
        .filter(F.col("depth") == F.col("_z"))
        .withColumn("_n", place)
        .filter("_n = 1")
    )
    half = reach // 2
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)]
    around = (
        least.select(*keys, "_r", "_c", "_z", F.explode(F.array(*steps)).alias("_d"))
        .groupBy(*keys, (F.col("_r") + F.col("_d.i")).alias("_r"), (F.col("_c") + F.col("_d.j")).alias("_c"))
        .agg(F.min("_z").alias("_least"))
    )
    hidden = F.col("_z") > F.col("_least") * (1 + tolerance)
    own = [c for c in seen.columns if c not in keys]
    return first.join(around, [*keys, "_r", "_c"]).select(
        *keys, *own, hidden.alias("occluded")
    )


def visibility(seen: DataFrame, cameras: DataFrame, total: int) -> DataFrame:
    """``camera_id, visible, share, median_depth`` of every camera, blind ones too."""
    counted = seen.groupBy("camera_id").agg(
        F.count("*").alias("visible"), F.percentile("depth", F.lit(0.5)).alias("median_depth")
    )
    return cameras.select("camera_id").join(counted, "camera_id", "left").select(
        "camera_id",
        F.coalesce("visible", F.lit(0)).alias("visible"),
        (F.coalesce("visible", F.lit(0)) / float(max(total, 1))).alias("share"),
        "median_depth",
    )


def rgb_residual(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean absolute difference over three channels of pixel (pr, pg, pb) and point (r, g, b)."""
    gap = sum(F.abs(F.col(f"p{c}") - F.col(c)) for c in "rgb") / 3
    return pairs.groupBy(*keys).agg(F.avg(gap).alias("residual"), F.count("*").alias("n"))


def psnr(pairs: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """``mse, psnr`` in dB of values in [0, 1]; equal images have an infinite PSNR."""
    rows = pairs.groupBy(*keys).agg(F.avg((F.col(a) - F.col(b)) ** 2).alias("mse"))
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(-10 * F.log10("mse"))
    return rows.withColumn("psnr", value)


def ssim(images: DataFrame, width: int, sigma: float = 1.5, radius: int = 5) -> DataFrame:
    """``id, ssim`` of pairs of grey images ``a, b`` (row-major arrays in [0, 1]).

    A Gaussian window slides over both, which no aggregate expresses: Arrow batches.
    """
    weights = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma**2))
    weights /= weights.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            pad = [(radius, radius) if k == axis else (0, 0) for k in (0, 1)]
            wide = np.pad(x, pad, mode="symmetric")
            x = sum(w * np.take(wide, range(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(weights))
        return x

    def one(a: np.ndarray, b: np.ndarray) -> float:
        ma, mb = blur(a), blur(b)
        va, vb, cov = blur(a * a) - ma**2, blur(b * b) - mb**2, blur(a * b) - ma * mb
        c1, c2 = 0.01**2, 0.03**2
        return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            found = [one(*(np.array(v, dtype=float).reshape(-1, width) for v in p)) for p in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64())], names=["id", "ssim"])

    return images.select("id", "a", "b").mapInArrow(run, f"id {dict(images.dtypes)['id']}, ssim double")


def pixel_grid(images: DataFrame, width: str, height: str, stride: int = 1) -> DataFrame:
    """A row for each ``row, col`` of every image."""
    rows = F.explode(F.sequence(F.lit(0), F.col(height) - 1, F.lit(stride)))
    return images.withColumn("row", rows).withColumn("col", F.explode(F.sequence(F.lit(0), F.col(width) - 1, F.lit(stride))))


def crop_views(yaws: int, pitches: Sequence[float], fov: float, size: int) -> list[tuple[str, float, float, float]]:
    """(name, yaw, pitch, focal length) of a ring of perspective crops."""
    focal = size / 2 / math.tan(math.radians(fov) / 2)
    return [
        (f"p{k}_y{i:02d}", 360.0 * i / yaws, pitch, focal) for k, pitch in enumerate(pitches) for i in range(yaws)
    ]


def bilinear(grid: DataFrame, samples: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Samples ``u, v`` (pixel centres at whole numbers) with the interpolated grid value; outside: NULL."""
    u0, v0 = F.floor("u").cast("int"), F.floor("v").cast("int")
    corners = F.explode(
        F.array(
            *[
                F.struct(
                    (u0 + i).alias("col"),
                    (v0 + j).alias("row"),
                    (F.abs(1 - i - (F.col("u") - u0)) * F.abs(1 - j - (F.col("v") - v0))).alias("w"),
                )
                for i in (0, 1)
                for j in (0, 1)
            ]
        )
    )
    wide = samples.withColumn("_id", F.monotonically_increasing_id()).select("*", corners.alias("_k")).select("*", "_k.*")
    hit = wide.filter("w > 0").join(grid, [*keys, "row", "col"], "left")
    names = [c for c in samples.columns]
    return hit.groupBy("_id", *names).agg(
        F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(F.col("w") * F.col(value))).alias(value)
    ).drop("_id")


def turbo_like(t: Column) -> tuple[Column, Column, Column]:
    """Piecewise-linear colour ramp from blue over green and yellow to red, cut off to 0..255.

    Each channel is 1.5 less the distance of four times the value from its centre (red 3, green 2, blue 1).
    """
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    channel = lambda centre: F.least(F.greatest(1.5 - F.abs(4 * x - centre), F.lit(0.0)), F.lit(1.0))
    return tuple(F.floor(channel(centre) * 255).cast("int") for centre in (3.0, 2.0, 1.0))


def painted(seen: DataFrame, value: str, order_by: Sequence[str] = (), keys: Sequence[str] = ("camera_id",)) -> DataFrame:
    """``row, col`` and the value of the nearest row of each pixel, as if painted from far to near; ties by
    ``order_by``. The least depth of a pixel is a plain hash aggregate; only rows at it are compared as
    whole rows."""
    pixel = [*keys, "row", "col"]
    placed = seen.select(
        "*", F.floor("v").cast("int").alias("row"), F.floor("u").cast("int").alias("col")
    )
    least = placed.groupBy(*pixel).agg(F.min("depth").alias("_z"))
    side = F.broadcast(least) if least.count() <= MOST_CELLS else least
    front = placed.join(side, pixel).filter(F.col("depth") == F.col("_z"))
    return front.groupBy(*pixel).agg(F.min_by(value, F.struct(*order_by) if order_by else F.col(value)).alias(value))


def nadir_mask(direction: tuple[Column, Column, Column], least_elevation: float) -> Column:
    """Whether a viewing direction is not below the given elevation (degrees)."""
    _, down = equirect_uv(direction)
    return (0.5 - down) * 180 >= least_elevation


def box_mask(u: Column, v: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Whether a pixel is outside all boxes (u0, v0, u1, v1)."""
    inside = F.lit(False)
    for u0, v0, u1, v1 in boxes:
        inside = inside | ((u >= u0) & (u < u1) & (v >= v0) & (v < v1))
    return ~inside


def covariance(qw, qx, qy, qz, s0, s1, s2) -> list[Column]:
    """Upper triangle (xx, xy, xz, yy, yz, zz) of R S S R' of a Gaussian with log scales."""
    from .transforms import quaternion_matrix

    r = quaternion_matrix(qw, qx, qy, qz)
    var = [F.exp(2 * s) for s in (s0, s1, s2)]
    return [sum(r[i][k] * r[j][k] * var[k] for k in range(3)) for i in range(3) for j in range(i, 3)]


def splat_order(opacity: Column, s0: Column, s1: Column, s2: Column) -> Column:
    """Importance of a Gaussian: sigmoid of its opacity logit times the product of its scales."""
    return F.exp(s0 + s1 + s2) / (1 + F.exp(-opacity))


def disparity_term(samples: DataFrame, image: str = "image", weight: str = "w", depth: str = "depth", rendered: str = "z") -> DataFrame:
    """``images, term``: mean over images of the weighted disparity gap over positive weights."""
    gap = F.col(weight) * F.abs(F.try_divide(F.lit(1.0), F.col(rendered)) - F.try_divide(F.lit(1.0), F.col(depth)))
    by_image = samples.filter(F.col(weight) > 0).groupBy(image).agg((F.sum(gap) / F.count("*")).alias("t"))
    return by_image.agg(F.count("*").alias("images"), F.avg("t").alias("term"))


def tracks(points: DataFrame, images: DataFrame, cameras: DataFrame, most_error: float = 2.0, least_length: int = 3) -> DataFrame:
    """Observations of 3-D points that hold: projected again, near their pixel, on tracks long enough
    whose images are all ``train``.

    ``points``: point_id, x, y, z, track array<struct<image_id, u, v>>; ``images``: image_id, camera_id,
    role, qw..qz, tx..tz; ``cameras``: camera_id, fx, fy, cx, cy.
    """
    from .transforms import quaternion_matrix

    seen = points.select("point_id", "x", "y", "z", F.explode("track").alias("o")).select("*", "o.*").drop("o")
    both = seen.join(images, "image_id").join(cameras, "camera_id")
    r = quaternion_matrix(*[F.col(f"q{c}") for c in "wxyz"])
    p = [F.col(c) for c in "xyz"]
    local = tuple(sum(r[i][j] * p[j] for j in range(3)) + F.col(f"t{'xyz'[i]}") for i in range(3))
    u, v = pinhole(local, F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    error = F.sqrt((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2)
    whole = Window.partitionBy("point_id")
    checked = both.withColumns({"depth": local[2], "error": error}).withColumn(
        "clean", F.bool_and(F.col("role") == "train").over(whole)
    )
    good = checked.filter(F.col("clean") & (F.col("depth") > 0) & (F.col("error") <= most_error))
    long_enough = F.size(F.collect_set("image_id").over(whole)) >= least_length
    return good.withColumn("_long", long_enough).filter("_long").select("point_id", "image_id", "u", "v", "depth", "error")
