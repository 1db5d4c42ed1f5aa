"""Runs of observations without a gap, and integrals that never cross one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import EPS, observed, require


def finite_runs(df: DataFrame, keys: Sequence[str], s: str, y: str, max_step: float) -> DataFrame:
    """Observed rows with ``run``: a run ends at an unobserved value or a step over ``max_step``."""
    order = Window.partitionBy(*keys).orderBy(s)
    value = observed(F.col(y).cast("double"))
    last_s, last_y = F.lag(s).over(order), F.lag("_y").over(order)
    breaks = F.col("_y").isNull() | last_y.isNull() | (F.col(s) - last_s > max_step + EPS)
    return (
        df.withColumn("_y", value)
        .withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("_break").over(order))
        .filter(F.col("_y").isNotNull())
        .drop("_break", "_y")
    )


def segments(df: DataFrame, keys: Sequence[str], s: str, y: str, max_step: float) -> DataFrame:
    """``lo, hi, stations, mean, integral`` of every run of two or more (trapezoids)."""
    runs = finite_runs(df, keys, s, y, max_step)
    order = Window.partitionBy(*keys, "run").orderBy(s)
    width = F.col(s) - F.lag(s).over(order)
    return (
        runs.withColumn("_area", (F.col(y) + F.lag(y).over(order)) / 2 * width)
        .groupBy(*keys, "run")
        .agg(
            F.min(s).cast("double").alias("lo"),
            F.max(s).cast("double").alias("hi"),
            F.count("*").alias("stations"),
            F.avg(y).alias("mean"),
            F.sum("_area").alias("integral"),
        )
        .filter("stations >= 2")
        .drop("run")
    )


def integrate(df: DataFrame, keys: Sequence[str], s: str, y: str, max_step: float) -> DataFrame:
    """``volume, covered, segments, mean_area`` of each key; keys without a run have NULL volume."""
    parts = segments(df, keys, s, y, max_step)
    totals = parts.groupBy(*keys).agg(
        F.sum("integral").alias("volume"),
        F.sum(F.col("hi") - F.col("lo")).alias("covered"),
        F.count("*").alias("segments"),
    )
    known = df.select(*keys).distinct()
    return known.join(totals, list(keys), "left").select(
        *keys,
        "volume",
        F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.coalesce("segments", F.lit(0)).alias("segments"),
        F.try_divide("volume", "covered").alias("mean_area"),
    )


def refuse_duplicates(df: DataFrame, keys: Sequence[str], s: str) -> DataFrame:
    """Stations must grow strictly."""
    order = Window.partitionBy(*keys).orderBy(s)
    step = df.withColumn("_step", F.col(s) - F.lag(s).over(order))
    require(step, F.col("_step") <= EPS, "two stations at one place")
    return df


def largest_gap(df: DataFrame, keys: Sequence[str], at: str, lo: Column, hi: Column) -> DataFrame:
    """Largest step between neighbours and to both ends of [lo, hi]; the whole span if nothing is in it."""
    ends = df.select(*keys, lo.alias("_lo"), hi.alias("_hi")).distinct()
    inside = df.filter(F.col(at).between(lo, hi)).select(*keys, F.col(at).alias("_at"))
    marks = (
        inside.unionByName(ends.select(*keys, F.col("_lo").alias("_at")))
        .unionByName(ends.select(*keys, F.col("_hi").alias("_at")))
    )
    order = Window.partitionBy(*keys).orderBy("_at")
    return (
        marks.withColumn("_gap", F.col("_at") - F.lag("_at").over(order))
        .groupBy(*keys)
        .agg(F.max("_gap").alias("gap"))
    )


def circular_fill(df: DataFrame, keys: Sequence[str], bin_col: str, value: str, bins: int, out: str = "filled") -> DataFrame:
    """Linear fill of NULL bins between the nearest observed ones, around the circle.

    Rows are the complete grid of bins; a key without any value stays NULL.
    """
    shifts = F.explode(F.array(*[F.lit(k * bins) for k in (-1, 0, 1)]))
    tripled = df.select("*", shifts.alias("_shift")).withColumn("_p", F.col(bin_col) + F.col("_shift"))
    order = Window.partitionBy(*keys).orderBy("_p")
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))
    before = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    a, b = F.col("_a"), F.col("_b")
    between = a.v + (b.v - a.v) * F.try_divide(F.col("_p") - a.p, b.p - a.p)
    return (
        tripled.withColumn("_a", before)
        .withColumn("_b", after)
        .filter("_shift = 0")
        .withColumn(out, F.coalesce(F.col(value), between))
        .drop("_shift", "_p", "_a", "_b")
    )


def moving_average(df: DataFrame, keys: Sequence[str], order_by: str, columns: Sequence[str], width: int = 3) -> DataFrame:
    """Centred mean of ``width`` rows; rows at the ends that have no full window keep their values."""
    half = width // 2
    order = Window.partitionBy(*keys).orderBy(order_by)
    frame = order.rowsBetween(-half, half)
    full = F.count("*").over(frame) == width
    return df.select(
        *[c for c in df.columns if c not in columns],
        *[F.when(full, F.avg(c).over(frame)).otherwise(F.col(c)).alias(c) for c in columns],
    )
