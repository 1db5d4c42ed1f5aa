"""Chunks along an axis: plans, membership, ownership, stitching and seams."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import EPS, ContractError
from .intervals import touches
from .volume import paired, paired_summary


def window_plan(start: float, end: float, length: float, overlap: float) -> list[tuple[int, float, float]]:
    """(ordinal, lo, hi) of overlapping windows; the last ends where the axis does."""
    if not 0 <= overlap < length:
        raise ContractError("the overlap must be less than the length")
    out, lo = [], start
    while True:
        hi = min(lo + length, end)
        out.append((len(out), round(lo, 3), round(hi, 3)))
        if hi >= end - EPS:
            return out
        lo += length - overlap


def core_plan(start: float, end: float, core: float, overlap: float) -> list[tuple[int, float, float, float, float]]:
    """(ordinal, core_lo, core_hi, support_lo, support_hi); a short rest joins the last core."""
    start, end = float(start), float(end)
    n = max(1, math.ceil(round((end - start) / core, 9)))
    if n > 1 and end - (start + (n - 1) * core) <= overlap + EPS:
        n -= 1
    edges = [start + i * core for i in range(n)] + [end]
    return [
        (i, edges[i], edges[i + 1], max(edges[i] - overlap, start), min(edges[i + 1] + overlap, end))
        for i in range(n)
    ]


def plan_table(spark: SparkSession, plan: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(
        plan, "ordinal int, core_lo double, core_hi double, support_lo double, support_hi double"
    )


def plan_issues(plan: DataFrame) -> DataFrame:
    """``ordinal, issue``: cores that leave a hole or overlap, ordinals with a gap, cores outside their support."""
    order = Window.orderBy("ordinal")
    hole = F.abs(F.col("core_lo") - F.lag("core_hi").over(order)) > EPS
    skip = F.col("ordinal") != F.row_number().over(order) - 1
    inside = (F.col("support_lo") <= F.col("core_lo") + EPS) & (F.col("support_hi") >= F.col("core_hi") - EPS)
    checks = F.array(
        F.when(hole, "cores do not tile"), F.when(skip, "ordinals skip"), F.when(~inside, "core outside support")
    )
    found = plan.select("ordinal", F.array_compact(checks).alias("_issues"))
    return found.select("ordinal", F.explode("_issues").alias("issue"))


def membership(points: DataFrame, plan: Sequence[tuple[int, float, float]], s: str = "s") -> DataFrame:
    """A row for each window (closed at both ends) that a point is in."""
    hits = F.array_compact(F.array(*[F.when(F.col(s).between(lo, hi), F.lit(i)) for i, lo, hi in plan]))
    return points.withColumn("ordinal", F.explode(hits))


def owner(s: Column, inner_edges: Sequence[float]) -> Column:
    """Half-open cores: an edge belongs to the chunk after it."""
    out = F.lit(0)
    for edge in inner_edges:
        out = out + (s + EPS >= edge).cast("int")
    return out


def group_chunks(groups: DataFrame, plan: DataFrame, lo: str = "span_lo", hi: str = "span_hi") -> DataFrame:
    """Groups with every chunk whose support their closed span meets; groups are never split."""
    small = plan.select("ordinal", "support_lo", "support_hi")
    if small.count() > 100_000:
        raise ContractError("a plan of over 100,000 chunks")
    on = (F.col(hi) >= F.col("support_lo")) & (F.col(lo) <= F.col("support_hi"))
    return groups.join(F.broadcast(small), on).drop("support_lo", "support_hi")


def stitch(stations: DataFrame, chunk_sections: DataFrame, inner_edges: Sequence[float], value: str = "area") -> DataFrame:
    """Each station read from its owner only; an owner without it leaves an invalid, empty section."""
    own = stations.withColumn("owner", owner(F.col("s"), inner_edges))
    rows = chunk_sections.select(F.col("ordinal").alias("owner"), "s", F.col(value).alias("_v"))
    return own.join(rows, ["owner", "s"], "left").select(
        *stations.columns, "owner", F.col("_v").alias(value), F.col("_v").isNotNull().alias("valid")
    )


def seams(chunk_sections: DataFrame, plan: DataFrame, value: str = "area") -> DataFrame:
    """Right minus left over the overlap of neighbouring supports, by the left chunk."""
    order = Window.orderBy("ordinal")
    pairs = plan.select(
        F.col("ordinal").alias("left_chunk"),
        F.lead("ordinal").over(order).alias("right_chunk"),
        F.lead("support_lo").over(order).alias("lo"),
        F.col("support_hi").alias("hi"),
    ).filter(F.col("hi") - F.col("lo") > EPS)
    cut = chunk_sections.select("ordinal", "s", F.col(value).alias("v"))

    def side(of: str) -> DataFrame:
        return F.broadcast(pairs).join(cut, F.col(of) == F.col("ordinal")).filter(
            F.col("s").between(F.col("lo"), F.col("hi"))
        ).select("left_chunk", "s", "v")

    both = paired(side("right_chunk"), side("left_chunk"), ["left_chunk"], "s", "v")
    return paired_summary(both, ["left_chunk"]).select(
        "left_chunk", "stations", "median_abs", "p95_abs", "mean_signed"
    )


def split_roles(groups: DataFrame, holdout: Sequence[tuple[float, float]], every: int, order_by: Sequence[str], lo: str = "span_lo", hi: str = "span_hi") -> DataFrame:
    """Roles of groups: ``holdout`` if the span touches it, every n-th of the others ``test``, else ``train``."""
    held = touches(F.col(lo), F.col(hi), holdout)
    place = F.row_number().over(Window.partitionBy(held).orderBy(*order_by))
    return groups.withColumn(
        "role", F.when(held, "holdout").when(place % every == 0, "test").otherwise("train")
    )
