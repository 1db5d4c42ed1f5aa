"""Synthetic tunnels: every row follows from its number, so any partitioning gives the same cloud."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_uniform(seed: int, *columns: Column) -> Column:
    """In [0, 1), from the row's own values."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 40)) / float(1 << 40)


def tunnel_points(
    spark: SparkSession,
    length: float = 90.0,
    per_metre: int = 1500,
    radius: float = 2.5,
    noise: float = 0.005,
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0),
    seed: int = 0,
) -> DataFrame:
    """``pid, s, x, y, z, frame`` of a straight tunnel along x with Gaussian noise on its radius."""
    n = int(length * per_metre)
    pid = F.col("id")
    s = hash_uniform(seed, pid) * length
    theta = hash_uniform(seed + 1, pid) * 2 * math.pi
    gauss = F.sqrt(-2 * F.log(1 - hash_uniform(seed + 2, pid))) * F.cos(2 * math.pi * hash_uniform(seed + 3, pid))
    r = radius + noise * gauss
    return spark.range(n).select(
        pid.alias("pid"),
        s.alias("s"),
        (s + origin[0]).alias("x"),
        (r * F.cos(theta) + origin[1]).alias("y"),
        (r * F.sin(theta) + origin[2]).alias("z"),
        F.lit("TLS_GLOBAL").alias("frame"),
    )
