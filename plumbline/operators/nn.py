"""Nearest-neighbour geometry: bounded joins on a grid, distance statistics, cloud comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import ContractError, stored


def _cell(size: float, shift: int = 0) -> list[Column]:
    return [(F.floor(F.col(c) / size).cast("long") + shift).alias(f"_c{c}") for c in "xyz"]


def _neighbour_cells(size: float) -> Column:
    """The 27 cells around a point."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    base = [F.floor(F.col(c) / size).cast("long") for c in "xyz"]
    return F.explode(
        F.array(*[F.struct(*[(b + d).alias(f"_c{c}") for b, d, c in zip(base, step, "xyz", strict=True)]) for step in steps])
    )


def near_pairs(queries: DataFrame, reference: DataFrame, bound: float, strict: bool = True) -> DataFrame:
    """Pairs ``id, ref_id, d2`` within the bound, by an equi-join on grid cells as wide as the bound.

    The query side is spread over its 27 cells; the reference keeps one row for each point, so the
    larger side should be the reference.
    """
    q = queries.select("id", "x", "y", "z", _neighbour_cells(bound).alias("_cell")).select("id", "x", "y", "z", "_cell.*")
    r = reference.select(F.col("id").alias("ref_id"), *[F.col(c).alias(f"r{c}") for c in "xyz"], *_cell(bound))
    d2 = sum((F.col(c) - F.col(f"r{c}")) ** 2 for c in "xyz")
    within = F.col("d2") < bound * bound if strict else F.col("d2") <= bound * bound
    return q.join(r, ["_cx", "_cy", "_cz"]).withColumn("d2", d2).filter(within).select("id", "ref_id", "d2")


def nearest(queries: DataFrame, reference: DataFrame, bound: float) -> DataFrame:
    """Every query with ``ref_id, distance`` of its nearest reference point; NULL if none is within the bound."""
    best = (
        near_pairs(queries, reference, bound)
        .groupBy("id")
        .agg(F.min(F.struct("d2", "ref_id")).alias("b"))
        .select("id", F.col("b.ref_id").alias("ref_id"), F.sqrt("b.d2").alias("distance"))
    )
    return queries.select("id").join(best, "id", "left")


def nearest_unbounded(queries: DataFrame, reference: DataFrame, first: float, rounds: int = 40) -> DataFrame:
    """Like :func:`nearest` without a bound: what finds nothing is tried again with twice the bound.

    What a round finds and what it leaves is stored, so no round is computed again by a later one.
    """
    if reference.isEmpty():
        raise ContractError("no reference points")
    left, out, bound = queries, None, first
    for _ in range(rounds):
        found = stored(nearest(left, reference, bound).filter(F.col("ref_id").isNotNull()))
        out = found if out is None else out.unionByName(found)
        left = stored(left.join(found.select("id"), "id", "left_anti"))
        if left.isEmpty():
            return out
        bound *= 2
    raise ContractError("points too far from any reference point")


def within_tolerance(queries: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """Queries with a reference point at the tolerance or nearer (a semi join)."""
    pairs = near_pairs(queries, reference, tolerance * (1 + 1e-12), strict=False)
    return queries.join(pairs.select("id").distinct(), "id", "left_semi")


def distance_stats(distances: DataFrame, keys: Sequence[str], bound: float, tau: float, d: str = "distance") -> DataFrame:
    """``n, mean, rmse, median, p90, p95, max, within, clipped``; misses count with the bound."""
    value = F.coalesce(F.col(d), F.lit(float(bound)))
    rows = distances.withColumn("_d", value)
    q = F.percentile("_d", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("_d").alias("mean"),
        F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"),
        q[0].alias("median"),
        q[1].alias("p90"),
        q[2].alias("p95"),
        F.max("_d").alias("max"),
        F.avg((F.col("_d") <= tau).cast("double")).alias("within"),
        F.avg(F.col(d).isNull().cast("double")).alias("clipped"),
    )


def compare_clouds(prediction: DataFrame, reference: DataFrame, bound: float, tau: float) -> DataFrame:
    """One row: accuracy and completeness means, chamfer distance, precision, recall, F-score."""
    accuracy = distance_stats(nearest(prediction, reference, bound), [], bound, tau)
    completeness = distance_stats(nearest(reference, prediction, bound), [], bound, tau)
    both = accuracy.select(F.col("mean").alias("accuracy"), F.col("within").alias("precision")).crossJoin(
        completeness.select(F.col("mean").alias("completeness"), F.col("within").alias("recall"))
    )
    total = F.col("precision") + F.col("recall")
    return both.select(
        "accuracy",
        "completeness",
        ((F.col("accuracy") + F.col("completeness")) / 2).alias("chamfer"),
        "precision",
        "recall",
        F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f_score"),
    )


def diagnose(distances: DataFrame, keys: Sequence[str], threshold: float, d: str = "distance") -> DataFrame:
    """Registration residuals: rmse over inliers (d < threshold), median and p90 over all, inlier ratio."""
    inlier = F.col(d) < threshold
    return distances.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sqrt(F.avg(F.when(inlier, F.col(d) ** 2))).alias("rmse"),
        F.percentile(d, F.lit(0.5)).alias("median"),
        F.percentile(d, F.lit(0.9)).alias("p90"),
        F.avg(inlier.cast("double")).alias("inlier_ratio"),
    )
