"""Claims and protocols as ordered rules over rows; every refusal is kept, not only the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def refusals(checks: Sequence[tuple[Column, str]]) -> Column:
    """The messages of all conditions that hold; NULL counts as holding, so unknown is refused."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in checks]))


def decide(df: DataFrame, checks: Sequence[tuple[Column, str]]) -> DataFrame:
    """Rows with ``refusals`` and ``allowed``."""
    return df.withColumn("refusals", refusals(checks)).withColumn("allowed", F.size("refusals") == 0)


def judge(manifests: DataFrame) -> DataFrame:
    """``protocols, claims, refused`` (lists as text) of dataset manifests.

    Columns: scale_basis, source, registration struct<id, inlier_ratio, rmse, claim_allowed, support>,
    test_groups, init_groups (arrays of names), holdout, excluded and support (arrays of struct<lo, hi>),
    points_excluded.

    Metric claims need a scale and, of video, a registration with a record, usable figures and its own
    permission. Novel views are judged if test groups are named and none of them is in the initial cloud.
    Geometry and volume are claims on held-out ranges whose points are excluded, each inside one range
    declared as excluded, and which the registration doesn't rest on; support that was never recorded
    counts as everywhere. What is neither is a reconstruction; diagnostics are always allowed.
    """
    have = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    reg = F.col("registration")
    video = F.col("source").isin("video", "video360")
    poor = (reg["inlier_ratio"] <= 0) | (reg["rmse"] <= 0)
    usable = video & reg.isNotNull() & ~F.coalesce(poor, F.lit(True))
    metric = [
        (F.col("scale_basis").isNull(), "no scale"),
        (video & reg.isNull(), "video without registration"),
        (video & reg.isNotNull() & ~usable, "registration without usable figures"),
        (usable & reg["id"].isNull(), "registration without a record"),
        (usable & ~F.coalesce(reg["claim_allowed"], F.lit(False)), "registration permits no claim"),
    ]
    leaks = F.coalesce(F.arrays_overlap("test_groups", "init_groups"), F.lit(False))
    views = [(have("test_groups") & leaks, "test groups in the initial cloud")]
    held = have("holdout")
    inside = lambda r: F.exists("excluded", lambda e: (e.lo <= r.lo) & (e.hi >= r.hi))
    declared = F.coalesce(F.forall("holdout", inside), F.lit(False))
    shared = lambda r: F.exists(reg["support"], lambda s: F.least(s.hi, r.hi) > F.greatest(s.lo, r.lo))
    rests = F.when(reg["support"].isNull(), reg["id"].isNotNull()).otherwise(F.exists("holdout", shared))
    ranges = [
        (held & ~F.coalesce("points_excluded", F.lit(False)), "points of the holdout not excluded"),
        (held & ~declared, "holdout not declared as excluded"),
        (held & reg.isNotNull() & F.coalesce(rests, F.lit(False)), "registered on the holdout"),
    ]
    found = {name: refusals(checks) for name, checks in (("metric", metric), ("views", views), ("ranges", ranges))}
    novel = have("test_groups") & (F.size(found["views"]) == 0)
    geometry = held & (F.size(found["metric"]) == 0) & (F.size(found["ranges"]) == 0)
    listed = lambda *items: F.concat_ws(",", *[F.when(c, F.lit(t)) for c, t in items])
    return manifests.select(
        "*",
        listed(
            (novel, "novel_view"), (geometry, "geometry_holdout"), (~novel & ~geometry, "reconstruction")
        ).alias("protocols"),
        listed(
            (F.lit(True), "geometry_diagnostic"),
            (novel, "render_quality"),
            (geometry, "geometry_accuracy"),
            (geometry, "volume_accuracy"),
        ).alias("claims"),
        F.array_join(F.concat(*found.values()), "; ").alias("refused"),
    )


def gate(df: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows with ``refusals, allowed`` for limits {column: ("max" or "min", value)}; a missing value is refused."""
    checks = []
    for column, (kind, limit) in limits.items():
        bad = F.col(column) > limit if kind == "max" else F.col(column) < limit
        checks.append((bad, f"{column} {'over' if kind == 'max' else 'under'} {limit:g}"))
    return decide(df, checks)


def best_with_margin(df: DataFrame, keys: Sequence[str], score: str, label: str, descending: bool = False) -> DataFrame:
    """``best, runner_up, margin`` by score and label; a NULL score comes last, as infinity."""
    by = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    order = Window.partitionBy(*keys).orderBy(by, label)
    ranked = df.select(
        *keys,
        F.row_number().over(order).alias("_r"),
        F.col(label).alias("best"),
        F.lead(label).over(order).alias("runner_up"),
        F.abs(F.col(score) - F.lead(score).over(order)).alias("margin"),
        F.col(score).alias("score"),
    )
    return ranked.filter("_r = 1").drop("_r")


def calibration_status(ranked: DataFrame, images: str, least_images: int, spread: str, most_spread: float, least_margin: float) -> DataFrame:
    """``status`` of a ranked choice: insufficient, inconsistent, ambiguous or selected, in that order."""
    status = (
        F.when(F.coalesce(F.col(images), F.lit(0)) < least_images, "insufficient")
        .when(F.coalesce(F.col(spread) > most_spread, F.lit(True)), "inconsistent")
        .when(F.coalesce(F.col("margin") < least_margin, F.lit(False)), "ambiguous")
        .otherwise("selected")
    )
    return ranked.withColumn("status", status)


def score_candidates(points: DataFrame, candidates: DataFrame, predicted: dict[str, Column], keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """Mean residual of every candidate (few, counted) over all points: residual of named predictions
    against columns ``obs_<name>``."""
    if candidates.count() > 10_000:
        raise ValueError("over 10,000 candidates")
    gap = F.sqrt(sum((p - F.col(f"obs_{n}")) ** 2 for n, p in predicted.items()))
    w = F.col(weight) if weight else F.lit(1.0)
    return (
        points.crossJoin(F.broadcast(candidates))
        .groupBy(*keys)
        .agg((F.sum(gap * w) / F.sum(w)).alias("residual"), F.count("*").alias("n"))
    )
