"""Volumes from section series: coverage, design comparison, change between epochs, paired series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals, runs


def clipped_to(series: DataFrame, ranges: DataFrame, keys: Sequence[str], s: str) -> DataFrame:
    """Stations inside each merged range of their key, with ``lo, hi`` of the range."""
    merged = intervals.union(ranges, keys)
    return series.join(merged, list(keys)).filter(F.col(s).between(F.col("lo"), F.col("hi")))


def coverage(series: DataFrame, ranges: DataFrame, keys: Sequence[str], s: str, y: str, max_step: float) -> DataFrame:
    """``requested, covered, missing, fraction`` of each key; covered and missing make up the requested."""
    merged = intervals.union(ranges, keys)
    inside = clipped_to(series, ranges, keys, s).withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    runs_in = runs.segments(inside, [*keys, "_lo", "_hi"], s, y, max_step).select(*keys, "lo", "hi")
    total = lambda df, name: intervals.total_length(df, keys).select(*keys, F.col("length").alias(name))
    out = total(merged, "requested").join(total(runs_in, "covered"), list(keys), "left")
    gaps = intervals.subtract(merged, runs_in, keys)
    out = out.join(total(gaps, "missing"), list(keys), "left")
    covered = F.coalesce("covered", F.lit(0.0))
    return out.select(
        *keys,
        "requested",
        covered.alias("covered"),
        F.coalesce("missing", F.lit(0.0)).alias("missing"),
        F.coalesce(F.try_divide(covered, F.col("requested")), F.lit(0.0)).alias("fraction"),
    )


def coverage_detail(
    series: DataFrame, covered: DataFrame, keys: Sequence[str], s: str, empty: str, thickness: float, bins: int
) -> DataFrame:
    """``stations, sampled, sampled_fraction, interpolated`` of each key's covered intervals: stations in them, the
    length that their slabs cover (united, cut to the covered), its share, and the share of angle bins that are empty.

    Keys that cover nothing have 0 in all.
    """
    merged = intervals.union(covered, keys)
    inside = clipped_to(series, covered, keys, s)
    half = thickness / 2
    slabs = inside.select(*keys, (F.col(s) - half).alias("lo"), (F.col(s) + half).alias("hi"))
    length = lambda df, name: intervals.total_length(df, keys).select(*keys, F.col("length").alias(name))
    counted = inside.groupBy(*keys).agg(F.count("*").alias("stations"), F.sum(empty).alias("empty"))
    out = series.select(*keys).distinct().join(counted, list(keys), "left").join(length(merged, "whole"), list(keys), "left")
    out = out.join(length(intervals.intersect(slabs, merged, keys), "sampled"), list(keys), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        *keys,
        F.coalesce("stations", F.lit(0)).alias("stations"),
        zero(F.col("sampled")).alias("sampled"),
        zero(F.try_divide("sampled", "whole")).alias("sampled_fraction"),
        zero(F.try_divide("empty", F.col("stations") * bins)).alias("interpolated"),
    )


def against_design(series: DataFrame, keys: Sequence[str], design: Column, bins: int) -> DataFrame:
    """``chainage, area, over, under`` of every station of :func:`.sections.sections`: areas of the sectors
    over and under the design radius, with gaps in the wall filled around the circle; NULL where the section is
    not valid. ``design`` may use the column ``bin``."""
    part = 0.5 * (F.col("filled") ** 2 - design**2) * (2 * math.pi / bins)
    station = [*keys, "station_idx"]
    long = series.filter(F.col("valid") & F.col("area").isNotNull()).select(*station, F.posexplode("radii").alias("bin", "radius"))
    by_station = (
        runs.circular_fill(long, station, "bin", "radius", bins)
        .groupBy(*station)
        .agg(F.sum(F.greatest(part, F.lit(0.0))).alias("over"), F.sum(F.greatest(-part, F.lit(0.0))).alias("under"))
    )
    grid = series.select(*station, "chainage", F.when(F.col("valid"), F.col("area")).alias("area"))
    return grid.join(by_station, station, "left")


def design_volumes(compared: DataFrame, keys: Sequence[str], interval: float) -> DataFrame:
    """``over_m3, under_m3, covered, segments`` of each key: both integrated on the runs of the area, never
    over a station without one."""
    over = runs.integrate(compared, keys, "chainage", "over", interval)
    under = runs.integrate(compared, keys, "chainage", "under", interval)
    return over.select(*keys, F.col("volume").alias("over_m3"), "covered", "segments").join(
        under.select(*keys, F.col("volume").alias("under_m3")), list(keys)
    )


def change(before: DataFrame, after: DataFrame, keys: Sequence[str], s: str, y: str, interval: float) -> tuple[DataFrame, DataFrame]:
    """(differences at common stations, volume of the difference by key).

    Stations meet by chainage rounded half-even to micrometres.
    """
    key = F.bround(F.col(s).cast("double"), 6)
    a = before.select(*keys, key.alias("_at"), F.col(s).alias("s"), F.col(y).alias("before"))
    b = after.select(*keys, key.alias("_at"), F.col(y).alias("after"))
    both = a.join(b, [*keys, "_at"]).withColumn("delta", F.col("after") - F.col("before")).drop("_at")
    return both, runs.integrate(both, keys, "s", "delta", interval)


def paired(prediction: DataFrame, reference: DataFrame, keys: Sequence[str], s: str, y: str) -> DataFrame:
    """Full pairing ``s, predicted, referenced, error, abs_error, rel_error, side``; unobserved is NULL."""
    p = prediction.select(*keys, F.col(s).alias("s"), F.col(y).alias("predicted"))
    r = reference.select(*keys, F.col(s).alias("s"), F.col(y).alias("referenced"))
    error = F.col("predicted") - F.col("referenced")
    side = (
        F.when(F.col("predicted").isNotNull() & F.col("referenced").isNotNull(), "both")
        .when(F.col("predicted").isNotNull(), "prediction_only")
        .when(F.col("referenced").isNotNull(), "reference_only")
        .otherwise("neither")
    )
    near_zero = F.abs("referenced") < 1e-9
    return p.join(r, [*keys, "s"], "full_outer").select(
        *keys,
        "s",
        "predicted",
        "referenced",
        error.alias("error"),
        F.abs(error).alias("abs_error"),
        F.when(~near_zero, F.abs(error) / F.abs("referenced")).alias("rel_error"),
        side.alias("side"),
    )


def paired_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    q = lambda p: F.percentile("abs_error", F.lit(p))
    return pairs.groupBy(*keys).agg(
        F.count("error").alias("stations"),
        F.avg("abs_error").alias("mean_abs"),
        q(0.5).alias("median_abs"),
        q(0.95).alias("p95_abs"),
        F.avg("error").alias("mean_signed"),
        F.avg("rel_error").alias("mean_rel"),
        F.count_if(F.col("side") == "prediction_only").alias("prediction_only"),
        F.count_if(F.col("side") == "reference_only").alias("reference_only"),
    )


def paired_volumes(pairs: DataFrame, keys: Sequence[str], max_step: float) -> DataFrame:
    """Volumes of both series over the runs on which both are observed, and only there."""
    both = F.col("side") == "both"
    common = pairs.select(
        *keys,
        "s",
        F.when(both, F.col("predicted")).alias("p"),
        F.when(both, F.col("referenced")).alias("r"),
    )
    p = runs.integrate(common, keys, "s", "p", max_step)
    r = runs.integrate(common, keys, "s", "r", max_step)
    return p.select(*keys, F.col("volume").alias("predicted_volume"), "covered", "segments").join(
        r.select(*keys, F.col("volume").alias("referenced_volume")), list(keys)
    ).withColumn("relative", F.try_divide(F.col("predicted_volume") - F.col("referenced_volume"), "referenced_volume"))


def same_grid(a: DataFrame, b: DataFrame, s: str, tolerance: float = 1e-9) -> DataFrame:
    """Stations, by order, that one grid lacks or places elsewhere; empty if the grids are the same."""
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.orderBy(s))
    left = a.select(place.alias("i"), F.col(s).alias("a"))
    right = b.select(place.alias("i"), F.col(s).alias("b"))
    both = left.join(right, "i", "full_outer")
    return both.filter(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))
