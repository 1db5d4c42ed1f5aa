"""Interval algebra on tables of closed intervals ``lo, hi`` for each key; touching within EPS is one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import EPS


def union(df: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi", slack: float = EPS) -> DataFrame:
    """Merged intervals of each key; those no longer than the slack are dropped."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col(lo) > F.max(hi).over(before) + slack, F.lit(True))
    return (
        df.filter(F.col(hi) - F.col(lo) > slack)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(order))
        .groupBy(*keys, "_island")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
        .drop("_island")
    )


def union_known(df: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """``known, lo, hi``: merged intervals of each key, those of no length kept; intervals that touch are one.

    A row without ends is an unknown extent, which makes the whole key unknown: one row without ends.
    """
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.col(lo).isNull() | F.col(hi).isNull()
    unknown = df.groupBy(*keys).agg(F.bool_or(none).alias("_unknown"))
    opens = F.coalesce(F.col(lo) > F.max(hi).over(before), F.lit(True))
    merged = (
        df.filter(~none)
        .withColumn("_opens", opens.cast("int"))
        .withColumn("_island", F.sum("_opens").over(order))
        .groupBy(*keys, "_island")
        .agg(F.min(lo).alias(lo), F.max(hi).alias(hi))
        .drop("_island")
    )
    whole = merged.join(unknown.filter("NOT _unknown"), list(keys)).select(*keys, F.lit(True).alias("known"), lo, hi)
    nothing = F.lit(None).cast("double")
    poisoned = unknown.filter("_unknown").select(*keys, F.lit(False).alias("known"), nothing.alias(lo), nothing.alias(hi))
    return _union(whole, poisoned, keys)


def _union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union whose keys pass through it as one struct.

    A union of sides that are both partitioned by key claims that partitioning for itself, and a join above
    it fails when the engine changes one side's partitions at run time; so the claim is not made.
    """
    if not keys:
        return a.unionByName(b)
    rest = [c for c in a.columns if c not in keys]
    packed = [df.select(F.struct(*[F.col(k) for k in keys]).alias("_k"), *rest) for df in (a, b)]
    return packed[0].unionByName(packed[1]).select("_k.*", *rest)


def subtract(base: DataFrame, cut: DataFrame, keys: Sequence[str], slack: float = EPS) -> DataFrame:
    """What of the merged base lies in no cut.

    Base and cuts become +1 / -1 events on one line, so no base meets cut by cut: one sort for each
    key instead of a range join.
    """
    base, cut = union(base, keys, slack=slack), union(cut, keys, slack=slack)

    def events(df: DataFrame, kind: str) -> DataFrame:
        at = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d"))))
        return df.select(*keys, at.alias("e")).select(
            *keys,
            "e.at",
            (F.col("e.d") if kind == "base" else F.lit(0)).alias("base"),
            (F.col("e.d") if kind == "cut" else F.lit(0)).alias("cut"),
        )

    order = Window.partitionBy(*keys).orderBy("at")
    steps = (
        _union(events(base, "base"), events(cut, "cut"), keys)
        .groupBy(*keys, "at")
        .agg(F.sum("base").alias("base"), F.sum("cut").alias("cut"))
        .select(
            *keys,
            F.col("at").alias("lo"),
            F.lead("at").over(order).alias("hi"),
            F.sum("base").over(order).alias("in_base"),
            F.sum("cut").over(order).alias("in_cut"),
        )
    )
    pieces = steps.filter((F.col("in_base") > 0) & (F.col("in_cut") == 0)).select(*keys, "lo", "hi")
    return union(pieces, keys, slack=slack)


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], slack: float = EPS) -> DataFrame:
    """Where both lie, of positive length; by events like :func:`subtract`."""
    a, b = union(a, keys, slack=slack), union(b, keys, slack=slack)
    both = _union(a.select(*keys, "lo", "hi"), b.select(*keys, "lo", "hi"), keys)
    at = F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(1).alias("d")), F.struct(F.col("hi").alias("at"), F.lit(-1).alias("d"))))
    order = Window.partitionBy(*keys).orderBy("at")
    steps = (
        both.select(*keys, at.alias("e"))
        .groupBy(*keys, F.col("e.at").alias("at"))
        .agg(F.sum("e.d").alias("d"))
        .select(*keys, F.col("at").alias("lo"), F.lead("at").over(order).alias("hi"), F.sum("d").over(order).alias("n"))
    )
    return steps.filter((F.col("n") > 1) & (F.col("hi") > F.col("lo"))).select(*keys, "lo", "hi")


def total_length(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("length"), F.count("*").alias("pieces"))


def in_ranges(s: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Closed: lo <= s <= hi of some range."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | s.between(lo, hi)
    return out


def touches(lo: Column, hi: Column, ranges: Sequence[tuple[float, float]]) -> Column:
    """Whether a closed span meets a range; touching counts, an unknown end is everything."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | (F.coalesce(hi >= a, F.lit(True)) & F.coalesce(lo <= b, F.lit(True)))
    return out


def covered_by(df: DataFrame, ranges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spans that no single range contains whole (an anti join)."""
    r = ranges.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    on = (F.col("_lo") <= F.col("lo")) & (F.col("_hi") >= F.col("hi"))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(r, on, "left_anti")


def ray_crosses(s_from: Column, s_to: Column, ranges: Sequence[tuple[float, float]], margin: float = 0.5) -> Column:
    """Whether the span between two chainages, widened by the margin, meets a range."""
    return touches(F.least(s_from, s_to) - margin, F.greatest(s_from, s_to) + margin, ranges)


def integer_islands(df: DataFrame, keys: Sequence[str], value: str, width: float = 1.0) -> DataFrame:
    """Intervals of consecutive occupied bins floor(value / width)."""
    order = Window.partitionBy(*keys).orderBy("_bin")
    bins = df.select(*keys, F.floor(F.col(value) / width).alias("_bin")).distinct()
    island = F.col("_bin") - F.row_number().over(order)
    return (
        bins.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg((F.min("_bin") * width).alias("lo"), ((F.max("_bin") + 1) * width).alias("hi"), F.count("*").alias("bins"))
        .drop("_island")
    )
