"""The operators by name in SQL: functions, a table function and views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, volume


class Stations:
    """SQL table function ``stations(start, end, step)``: places counted from the start."""

    def eval(self, start: float, end: float, step: float) -> Iterator[tuple]:
        from ..operators.axis import stations

        for k, s in enumerate(stations(float(start), float(end), float(step))):
            yield k, s


#: SQL functions: name, parameters and body; they are expanded into the plan, not called.
FUNCTIONS = {
    "hamming": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "touches_range": ("lo DOUBLE, hi DOUBLE, a DOUBLE, b DOUBLE", "BOOLEAN", "coalesce(hi >= a, true) AND coalesce(lo <= b, true)"),
    "owner_index": ("s DOUBLE, edges ARRAY<DOUBLE>", "INT", "size(filter(edges, e -> s + 1e-9 >= e))"),
    "polar_angle": ("y DOUBLE, z DOUBLE", "DOUBLE", "pmod(atan2(z, y), 2 * pi())"),
    "over_design": ("r DOUBLE, d DOUBLE, bins INT", "DOUBLE", "greatest(0.5D * (r * r - d * d) * 2 * pi() / bins, 0D)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions and the table function known to a session."""
    from pyspark.sql.functions import udtf

    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("stations", udtf(Stations, returnType="k: int, s: double"))


def interval_union_view(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    out = intervals.union(df, keys)
    out.createOrReplaceTempView(name)
    return out


def coverage_view(series: DataFrame, ranges: DataFrame, keys: list[str], s: str, y: str, step: float, name: str) -> DataFrame:
    out = volume.coverage(series, ranges, keys, s, y, step)
    out.createOrReplaceTempView(name)
    return out


def parse_ranges(text: str) -> list[tuple[float, float]]:
    """Ranges written as ``0:20,60:80``."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        lo, _, hi = part.partition(":")
        a, b = float(lo), float(hi)
        if b < a:
            raise ValueError(f"a range that ends before it begins: {part}")
        out.append((a, b))
    return out


def normal_guid(column: str):
    """GUID without braces, in lower case."""
    return F.lower(F.translate(F.trim(F.col(column)), "{}", ""))
