"""Evaluation flows over the operators: inventories, held-out geometry, comparisons of paths and runs,
re-derivation of section records, track membership and tolerance proofs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import ContractError
from . import axis, intervals, nn, runs, transforms
from .intervals import in_ranges


def inventory(scans: DataFrame) -> DataFrame:
    """``scan_id, pose_status, issues, notes`` of scan headers.

    Columns: point_count, has_xyz, has_spherical, has_rgb, pose_readable (NULL: no pose), quat_norm, rot_det,
    orth_err, is_identity.
    """
    invalid = (F.abs(F.col("quat_norm") - 1) > 1e-4) | (F.abs(F.col("rot_det") - 1) > 1e-4) | (F.col("orth_err") > 1e-4)
    slight = (F.abs(F.col("quat_norm") - 1) > 1e-9) | (F.abs(F.col("rot_det") - 1) > 1e-9) | (F.col("orth_err") > 1e-9)
    status = (
        F.when(F.col("pose_readable").isNull(), "absent")
        .when(~F.col("pose_readable"), "unreadable")
        .when(F.coalesce(invalid, F.lit(True)), "invalid")
        .when(F.col("is_identity"), "identity")
        .otherwise("valid")
    )
    issues = F.array(
        F.when(F.col("point_count") <= 0, "no points"),
        F.when(~F.col("has_xyz") & ~F.col("has_spherical"), "no coordinates"),
        F.when(status.isin("unreadable", "invalid"), F.concat(F.lit("pose "), status)),
    )
    notes = F.array(
        F.when(~F.col("has_rgb"), "no colour"),
        F.when(status == "identity", "pose is the identity"),
        F.when((status == "valid") & slight, "pose is orthonormal to 1e-4 only"),
    )
    return scans.select("scan_id", status.alias("pose_status"), F.array_compact(issues).alias("issues"), F.array_compact(notes).alias("notes"))


def inventory_report(found: DataFrame) -> DataFrame:
    """One row: scans by pose status and scans with issues."""
    by = lambda s: F.count_if(F.col("pose_status") == s).alias(s)
    return found.agg(
        F.count("*").alias("scans"), by("absent"), by("unreadable"), by("invalid"), by("identity"), by("valid"), F.count_if(F.size("issues") > 0).alias("with_issues")
    )


def held_out_geometry(prediction: DataFrame, reference: DataFrame, holdout: Sequence[tuple[float, float]], bound: float, tau: float) -> DataFrame:
    """Cloud comparison on the closed holdout ranges of chainage ``s``; an empty side is refused."""
    a, b = (df.filter(in_ranges(F.col("s"), holdout)) for df in (prediction, reference))
    for name, side in (("prediction", a), ("reference", b)):
        if side.isEmpty():
            raise ContractError(f"no {name} in the holdout")
    return nn.compare_clouds(a, b, bound, tau)


def compare_paths(first: DataFrame, second: DataFrame, keys: Sequence[str], s: str, y: str, max_step: float) -> DataFrame:
    """Both series measured again on the intersection of what each of them can be integrated over."""
    spans = [runs.segments(df, keys, s, y, max_step).select(*keys, "lo", "hi") for df in (first, second)]
    common = intervals.intersect(*spans, keys)

    def measured(df: DataFrame, name: str) -> DataFrame:
        inside = df.join(common, list(keys)).filter(F.col(s).between(F.col("lo"), F.col("hi")))
        inside = inside.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
        parts = runs.segments(inside, [*keys, "_lo", "_hi"], s, y, max_step)
        return parts.groupBy(*keys).agg(F.sum("integral").alias(name), F.sum(F.col("hi") - F.col("lo")).alias(f"{name}_length"))

    both = measured(first, "first").join(measured(second, "second"), list(keys), "full_outer")
    return both.withColumn("difference", F.col("second") - F.col("first"))


def compare_runs(metrics: DataFrame, baseline: str, advanced: str, keys: Sequence[str] = ("metric",)) -> DataFrame:
    """Long metrics ``run, metric, value`` of two runs side by side; NULL if either is missing."""
    one = lambda r: F.max(F.when(F.col("run") == r, F.col("value")))
    return (
        metrics.filter(F.col("run").isin(baseline, advanced))
        .groupBy(*keys)
        .agg(one(baseline).alias("baseline"), one(advanced).alias("advanced"))
        .withColumn("difference", F.col("advanced") - F.col("baseline"))
    )


def record_differences(recorded: DataFrame, derived: DataFrame, keys: Sequence[str], exact: Sequence[str], close: Sequence[str], rtol: float = 1e-9) -> DataFrame:
    """``keys, problems`` where a record isn't what its data give: exact fields, and close ones by relative error."""
    a = recorded.select(*keys, F.lit(1).alias("_in_a"), *[F.col(c).alias(f"_a_{c}") for c in (*exact, *close)])
    b = derived.select(*keys, F.lit(1).alias("_in_b"), *[F.col(c).alias(f"_b_{c}") for c in (*exact, *close)])
    off = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in exact]
    for c in close:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= rtol * F.abs(y))
        off.append(F.when(~same, F.lit(c)))
    problems = (
        F.when(F.col("_in_a").isNull(), "not recorded")
        .when(F.col("_in_b").isNull(), "not derived")
        .otherwise(F.array_join(F.array_compact(F.array(*off)), ","))
    )
    return a.join(b, list(keys), "full_outer").select(*keys, problems.alias("problems")).filter(F.col("problems") != "")


def volume_gate(reports: DataFrame, complete: Column, registered: Column, slab: Column, interval: Column) -> DataFrame:
    """``claim``: metric only with whole coverage, a registration and slabs no thicker than the interval."""
    from .rules import decide

    return decide(
        reports,
        [(~complete, "coverage is not complete"), (~registered, "not registered"), (slab > interval, "slabs overlap")],
    ).withColumn("claim", F.when(F.col("allowed"), "metric").otherwise("diagnostic"))


def allowed_samples(samples: DataFrame, points: DataFrame, allowed: DataFrame, tolerance: float) -> DataFrame:
    """Samples (id, image, x, y, z) with a track point within the tolerance that the image observes."""
    pairs = nn.near_pairs(samples, points, tolerance)
    known = pairs.join(samples.select("id", "image"), "id").join(
        allowed.select(F.col("point_id").alias("ref_id"), "image"), ["ref_id", "image"], "left_semi"
    )
    return samples.join(known.select("id").distinct(), "id", "left_semi")


def within_of(subset: DataFrame, whole: DataFrame, tolerance: float) -> DataFrame:
    """One row: ``n, unmatched, farthest``; every point of the subset must lie near a point of the whole."""
    near = nn.nearest(subset, whole, tolerance * (1 + 1e-12))
    return near.agg(
        F.count("*").alias("n"), F.count_if(F.col("distance").isNull()).alias("unmatched"), F.max("distance").alias("farthest")
    )


def moved_cameras(images: DataFrame, similarity: transforms.Similarity) -> DataFrame:
    """Images (qw..qz, tx..tz: world to camera) with centres moved by a similarity: centres scale, rotations only turn."""
    r = transforms.quaternion_matrix(*[F.col(f"q{c}") for c in "wxyz"])
    t = [F.col(f"t{c}") for c in "xyz"]
    centre = tuple(-sum(r[j][i] * t[j] for j in range(3)) for i in range(3))
    moved = similarity.apply(centre)
    back = similarity.r.T
    turned = [[sum(r[i][k] * float(back[k, j]) for k in range(3)) for j in range(3)] for i in range(3)]
    shift = [-sum(turned[i][j] * moved[j] for j in range(3)) for i in range(3)]
    q = transforms.matrix_quaternion(turned)
    new = {f"q{c}": v for c, v in zip("wxyz", q, strict=True)} | {f"t{c}": v for c, v in zip("xyz", shift, strict=True)}
    centre_columns = {f"c{c}": v for c, v in zip("xyz", moved, strict=True)}
    return images.select(*[new[c].alias(c) if c in new else F.col(c) for c in images.columns], *[v.alias(n) for n, v in centre_columns.items()])


def intrinsics(images: DataFrame) -> DataFrame:
    """Images with ``fx, fy, cx, cy, camera_id``: focal length over pixel size; equal intrinsics share the
    id of their first image. Missing or non-positive values, and principal points outside, are refused."""
    fx, fy = F.col("focal_length") / F.col("pixel_width"), F.col("focal_length") / F.col("pixel_height")
    inside = (F.col("cx") >= 0) & (F.col("cx") <= F.col("width")) & (F.col("cy") >= 0) & (F.col("cy") <= F.col("height"))
    good = F.coalesce((F.col("focal_length") > 0) & (F.col("pixel_width") > 0) & (F.col("pixel_height") > 0) & inside, F.lit(False))
    bad = images.filter(~good).count()
    if bad:
        raise ContractError(f"{bad} image(s) without usable intrinsics")
    rows = images.withColumns({"fx": fx, "fy": fy})
    same = ["width", "height", "fx", "fy", "cx", "cy"]
    first = rows.groupBy(*same).agg(F.min("image_id").alias("_first"))
    numbered = first.withColumn("camera_id", F.row_number().over(Window.orderBy("_first")))
    return rows.join(numbered.drop("_first"), same)


def segments_in_holdout(lines: DataFrame, vertices: DataFrame, order_by: str, holdout: Sequence[tuple[float, float]]) -> DataFrame:
    return axis.segment_touches(lines, "id", axis.Axis.collect(vertices, order_by), holdout)
