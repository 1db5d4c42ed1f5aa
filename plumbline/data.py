"""Survey-shaped inputs derived from the driver's tables, and the same derivations as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns that order the tunnel cloud's points (the first two alone are not unique).
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def tunnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a straight tunnel of 120 m with radius about 2.5 m: ORDER, scan, s, x, y, z, r."""
    li = table(spark, sf_dir, "lineitem").select(*ORDER, "l_discount", "l_tax")
    s = (F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13, F.lit(6000)) + 0.5) / 50.0
    theta = F.lit(2.0) * F.pi() * (F.pmod(F.col("l_partkey") * 37 + F.col("l_linenumber") * 11, F.lit(360)) + 0.5) / 360.0
    r = F.lit(2.5) + F.col("l_discount") - F.col("l_tax")
    return li.select(
        *ORDER,
        (F.col("l_suppkey") % 8).alias("scan"),
        s.alias("s"),
        s.alias("x"),
        (r * F.cos(theta)).alias("y"),
        (r * F.sin(theta)).alias("z"),
        r.alias("r"),
    )


TUNNEL = """
tunnel AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_suppkey % 8 AS scan,
         s, s AS x, r * cos(theta) AS y, r * sin(theta) AS z, r
  FROM (SELECT *, ((l_orderkey * 7 + l_linenumber * 13) % 6000 + 0.5::DOUBLE) / 50::DOUBLE AS s,
               2::DOUBLE * pi() * ((l_partkey * 37 + l_linenumber * 11) % 360 + 0.5::DOUBLE) / 360::DOUBLE AS theta,
               2.5::DOUBLE + l_discount - l_tax AS r FROM lineitem)
)"""


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cloud of embeddings: id, scan, x, y, z."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("scan"),
        *[(F.get("embedding", F.lit(i)).cast("double") * 10).alias(c) for i, c in enumerate("xyz")],
    )


CLOUD = """
cloud AS (
  SELECT vec_id AS id, label AS scan, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y,
         embedding[3]::DOUBLE * 10 AS z FROM embeddings
)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curved axis: 25 vertices."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("k"), (k * 5.0).alias("x"), F.sin(k.cast("double")).alias("y"), F.lit(0.0).alias("z")
    )


VERTICES = """
vertices AS (SELECT n_nationkey AS k, n_nationkey * 5::DOUBLE AS x, sin(n_nationkey::DOUBLE) AS y, 0::DOUBLE AS z FROM nation)"""

SEGMENTS = VERTICES + """,
steps AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step
          FROM vertices WINDOW w AS (ORDER BY k)),
chained AS (SELECT *, sum(coalesce(step, 0)) OVER (ORDER BY k) AS s FROM steps WHERE step IS NULL OR step >= 1e-9),
segs AS (SELECT row_number() OVER w - 1 AS seg_idx, s AS s0, lead(s) OVER w AS s1, x AS ax, y AS ay, z AS az,
                lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz
         FROM chained WINDOW w AS (ORDER BY s) QUALIFY lead(s) OVER w IS NOT NULL)"""


def series(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Station series by an orders column: key, s (day), n, area (NULL on every 17th day)."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col(by).alias("key"), day.alias("s"))
        .agg(F.count("*").alias("n"), (F.percentile("o_totalprice", F.lit(0.5)) / 1000).alias("area"))
        .withColumn("area", F.when(F.col("s") % 17 != 0, F.col("area")))
    )


def series_sql(by: str, name: str = "series") -> str:
    return f"""
{name} AS (
  SELECT {by} AS key, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INTEGER AS s, count(*) AS n,
         CASE WHEN any_value(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)) % 17 <> 0
              THEN quantile_cont(o_totalprice, 0.5) / 1000 END AS area
  FROM orders GROUP BY 1, 2
)"""


def runs_sql(source: str, y: str, keys: str = "key", step: float = 1) -> str:
    """CTEs ``flagged``, ``runs`` and ``segments`` of a series."""
    return f"""
flagged AS (
  SELECT *, CASE WHEN {y} IS NULL OR lag({y}) OVER w IS NULL OR s - lag(s) OVER w > {step} + 1e-9 THEN 1 ELSE 0 END AS brk
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY s)
),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY {keys} ORDER BY s) AS run FROM flagged),
traps AS (SELECT *, ({y} + lag({y}) OVER w) / 2 * (s - lag(s) OVER w) AS trap FROM runs WHERE {y} IS NOT NULL
          WINDOW w AS (PARTITION BY {keys}, run ORDER BY s)),
segments AS (
  SELECT {keys}, min(s)::DOUBLE AS lo, max(s)::DOUBLE AS hi, count(*) AS stations, avg({y}) AS mean, sum(trap) AS integral
  FROM traps GROUP BY {keys}, run HAVING count(*) >= 2
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals by supplier: key, lo, hi; one in seven is empty."""
    day = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return (
        table(spark, sf_dir, "lineitem")
        .filter("l_linenumber = 1")
        .select(F.col("l_suppkey").alias("key"), day.alias("lo"), (day + F.col("l_quantity") % 7).alias("hi"), "l_orderkey")
    )


SPANS = """
spans AS (
  SELECT l_suppkey AS key, date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE AS lo,
         date_diff('day', DATE '1992-01-01', l_shipdate::DATE)::DOUBLE + l_quantity % 7 AS hi, l_orderkey
  FROM lineitem WHERE l_linenumber = 1
)"""


def union_sql(source: str, out: str) -> str:
    """CTE with the merged intervals of each key of ``source``."""
    return f"""
{out}_m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9
                  THEN 0 ELSE 1 END AS opens FROM {source} WHERE hi - lo > 1e-9),
{out}_i AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY lo, hi) AS island FROM {out}_m),
{out} AS (SELECT key, min(lo) AS lo, max(hi) AS hi FROM {out}_i GROUP BY key, island)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Video frames of events: source, ts, event_id, blur, hash."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"),
        "ts",
        "event_id",
        F.col("value").alias("blur"),
        F.pmod(F.col("event_id") * F.lit(2654435761), F.lit(2147483648)).alias("hash"),
    )


FRAMES = """
frames AS (SELECT user_id AS source, ts, event_id, value AS blur, (event_id * 2654435761) % 2147483648 AS hash FROM events)"""
