"""Queries on evaluation flows, cameras and images."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..operators import evaluate, intervals, lineage, raster, rules, transforms, volume
from ..streaming import coverage as stream
from .registry import query, r6

_HEADERS = """WITH h AS (SELECT s_suppkey AS scan_id, CASE WHEN s_suppkey % 17 = 0 THEN 0 ELSE s_suppkey * 100 END AS n, s_suppkey % 5 <> 0 AS xyz, s_suppkey % 10 <> 0 AS sph, s_suppkey % 4 <> 0 AS rgb,
 CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_suppkey % 9 <> 0 END AS pose, CASE WHEN s_suppkey % 13 = 0 THEN 1.01 WHEN s_suppkey % 3 = 0 THEN 1.000001 ELSE 1.0 END AS qn, s_suppkey % 7 = 0 AS ident FROM supplier),
s AS (SELECT *, CASE WHEN pose IS NULL THEN 'absent' WHEN NOT pose THEN 'unreadable' WHEN abs(qn - 1) > 1e-4 THEN 'invalid' WHEN ident THEN 'identity' ELSE 'valid' END AS st FROM h),
i AS (SELECT scan_id, st, concat_ws(';', CASE WHEN n <= 0 THEN 'no points' END, CASE WHEN NOT xyz AND NOT sph THEN 'no coordinates' END, CASE WHEN st IN ('unreadable', 'invalid') THEN 'pose ' || st END) AS issues,
 concat_ws(';', CASE WHEN NOT rgb THEN 'no colour' END, CASE WHEN st = 'identity' THEN 'pose is the identity' END, CASE WHEN st = 'valid' AND abs(qn - 1) > 1e-9 THEN 'pose is orthonormal to 1e-4 only' END) AS notes FROM s)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return evaluate.inventory(
        data.table(spark, sf_dir, "supplier").select(
            k.alias("scan_id"),
            F.when(k % 17 == 0, 0).otherwise(k * 100).alias("point_count"),
            (k % 5 != 0).alias("has_xyz"),
            (k % 10 != 0).alias("has_spherical"),
            (k % 4 != 0).alias("has_rgb"),
            F.when(k % 6 != 0, k % 9 != 0).alias("pose_readable"),
            F.when(k % 13 == 0, 1.01).when(k % 3 == 0, 1.000001).otherwise(1.0).alias("quat_norm"),
            F.lit(1.0).alias("rot_det"),
            F.lit(0.0).alias("orth_err"),
            (k % 7 == 0).alias("is_identity"),
        )
    )


@query(_HEADERS + " SELECT scan_id, st AS pose_status, issues, notes FROM i")
def scan_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _inventory(spark, sf_dir)
    return found.select("scan_id", "pose_status", F.array_join("issues", ";").alias("issues"), F.array_join("notes", ";").alias("notes"))


@query(
    _HEADERS
    + """ SELECT count(*) AS scans, count(*) FILTER (st = 'absent') AS absent, count(*) FILTER (st = 'unreadable') AS unreadable, count(*) FILTER (st = 'invalid') AS invalid,
 count(*) FILTER (st = 'identity') AS identity, count(*) FILTER (st = 'valid') AS valid, count(*) FILTER (issues <> '') AS with_issues FROM i"""
)
def scan_inventory_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.inventory_report(_inventory(spark, sf_dir))


@query(
    f"""WITH {data.CLOUD}, q AS (SELECT * FROM cloud WHERE scan % 2 = 0 AND x + 5 BETWEEN 4 AND 6), f AS (SELECT * FROM cloud WHERE scan % 2 = 1 AND x + 5 BETWEEN 4 AND 6),
d AS (SELECT q.id AS a, f.id AS b, (q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2 AS d2 FROM q, f),
p AS (SELECT a, CASE WHEN min(d2) < 0.25 THEN sqrt(min(d2)) ELSE 0.5 END AS d FROM d GROUP BY 1), r AS (SELECT b, CASE WHEN min(d2) < 0.25 THEN sqrt(min(d2)) ELSE 0.5 END AS d FROM d GROUP BY 1),
x AS (SELECT avg(d) AS m, avg((d <= 0.3)::INT) AS w FROM p), y AS (SELECT avg(d) AS m, avg((d <= 0.3)::INT) AS w FROM r)
SELECT round(x.m, 6) AS accuracy, round(y.m, 6) AS completeness, round((x.m + y.m) / 2, 6) AS chamfer, round(x.w, 6) AS precision, round(y.w, 6) AS recall, round(2 * x.w * y.w / (x.w + y.w), 6) AS f_score FROM x, y"""
)
def held_out_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cloud(spark, sf_dir).withColumn("s", F.col("x") + 5)
    out = evaluate.held_out_geometry(rows.filter("scan % 2 = 0"), rows.filter("scan % 2 = 1"), [(4.0, 6.0)], 0.5, 0.3)
    return out.select(*[r6(c) for c in out.columns])


@query(
    f"""WITH {data.series_sql('o_orderpriority', 'every')}, p AS (SELECT 1 AS key, s, area FROM every WHERE key = '1-URGENT'), q AS (SELECT 1 AS key, s, area FROM every WHERE key = '3-MEDIUM'),
pa AS (SELECT s, area, lag(s) OVER w AS ls, lag(area) OVER w AS la FROM p WINDOW w AS (ORDER BY s)), qa AS (SELECT s, area, lag(s) OVER w AS ls, lag(area) OVER w AS la FROM q WINDOW w AS (ORDER BY s)),
b AS (SELECT pa.s, (pa.area + pa.la) / 2 AS x, (qa.area + qa.la) / 2 AS y FROM pa JOIN qa USING (s) WHERE pa.s - pa.ls = 1 AND qa.s - qa.ls = 1 AND pa.area IS NOT NULL AND pa.la IS NOT NULL AND qa.area IS NOT NULL AND qa.la IS NOT NULL)
SELECT round(sum(x), 7) AS first, round(sum(y), 7) AS second, count(*)::DOUBLE AS first_length, count(*)::DOUBLE AS second_length, round(sum(y) - sum(x), 7) AS difference FROM b"""
)
def compare_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.series(spark, sf_dir, "o_orderpriority")
    side = lambda k: rows.filter(F.col("key") == k).select(F.lit(1).alias("key"), "s", "area")
    out = evaluate.compare_paths(side("1-URGENT"), side("3-MEDIUM"), ["key"], "s", "area", 1.0)
    return out.select(F.round("first", 7).alias("first"), F.round("second", 7).alias("second"), "first_length", "second_length", F.round("difference", 7).alias("difference"))


@query(
    """WITH m AS (SELECT p_brand AS run, p_type AS metric, round(avg(p_retailprice), 6) AS value FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY ALL)
SELECT metric, max(CASE WHEN run = 'Brand#11' THEN value END) AS baseline, max(CASE WHEN run = 'Brand#12' THEN value END) AS advanced,
 round(max(CASE WHEN run = 'Brand#12' THEN value END) - max(CASE WHEN run = 'Brand#11' THEN value END), 6) AS difference FROM m GROUP BY 1"""
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("run"), F.col("p_type").alias("metric")).agg(F.round(F.avg("p_retailprice"), 6).alias("value"))
    return evaluate.compare_runs(rows, "Brand#11", "Brand#12").select("metric", "baseline", "advanced", r6("difference"))


@query(
    f"""WITH {data.TUNNEL}, d AS (SELECT scan, count(*) AS n FROM tunnel GROUP BY 1)
SELECT scan, CASE scan WHEN 2 THEN 'n' WHEN 3 THEN 'mean_r' WHEN 4 THEN 'not recorded' END AS problems FROM d WHERE scan IN (2, 3, 4)"""
)
def record_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of counts and mean radii that was tampered with."""
    derived = data.tunnel(spark, sf_dir).groupBy("scan").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"))
    k = F.col("scan")
    recorded = derived.filter(k != 4).select("scan", (F.col("n") + (k == 2).cast("int")).alias("n"), (F.col("mean_r") * F.when(k == 3, 1.001).otherwise(1.0)).alias("mean_r"))
    return evaluate.record_differences(recorded, derived, ["scan"], ["n"], ["mean_r"])


@query(
    """WITH r AS (SELECT s_suppkey AS id, s_suppkey % 2 = 0 AS complete, s_suppkey % 3 <> 0 AS reg, (s_suppkey % 4)::DOUBLE AS slab FROM supplier)
SELECT id, CASE WHEN complete AND reg AND slab <= 2 THEN 'metric' ELSE 'diagnostic' END AS claim, concat_ws('; ', CASE WHEN NOT complete THEN 'coverage is not complete' END,
 CASE WHEN NOT reg THEN 'not registered' END, CASE WHEN slab > 2 THEN 'slabs overlap' END) AS refused FROM r"""
)
def volume_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    rows = data.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    out = evaluate.volume_gate(rows, k % 2 == 0, k % 3 != 0, (k % 4).cast("double"), F.lit(2.0))
    return out.select("id", "claim", F.array_join("refusals", "; ").alias("refused"))


_EVEN_ODD = f"WITH {data.CLOUD}, q AS (SELECT * FROM cloud WHERE scan % 2 = 0), f AS (SELECT * FROM cloud WHERE scan % 2 = 1)"


@query(_EVEN_ODD + " SELECT DISTINCT q.id FROM q JOIN f ON (q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2 < 0.25 AND (f.id + q.scan) % 3 <> 0")
def allowed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cloud(spark, sf_dir)
    samples = rows.filter("scan % 2 = 0").withColumn("image", F.col("scan"))
    points = rows.filter("scan % 2 = 1")
    images = samples.select("image").distinct()
    allowed = points.select(F.col("id").alias("point_id")).crossJoin(F.broadcast(images)).filter((F.col("point_id") + F.col("image")) % 3 != 0)
    return evaluate.allowed_samples(samples, points, allowed, 0.5).select("id")


@query(
    _EVEN_ODD
    + """, d AS (SELECT q.id, min((q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2) AS d2 FROM q, f GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (d2 >= 0.16) AS unmatched, round(sqrt(max(CASE WHEN d2 < 0.16 THEN d2 END)), 6) AS farthest FROM d"""
)
def subset_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cloud(spark, sf_dir)
    out = evaluate.within_of(rows.filter("scan % 2 = 0"), rows.filter("scan % 2 = 1"), 0.4)
    return out.select("n", "unmatched", r6("farthest"))


@query(
    """WITH e AS (SELECT vec_id AS image_id, embedding[5]::DOUBLE AS a, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS c FROM embeddings)
SELECT image_id, round(2 * (-a) + 1, 6) + 0.0 AS cx, round(2 * (-b) - 3, 6) + 0.0 AS cy, round(2 * (-c) + 0.5, 6) + 0.0 AS cz, round(-(2 * (-a) + 1), 6) + 0.0 AS tx FROM e"""
)
def moved_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unrotated cameras moved by scale 2 and a shift."""
    get = lambda i: F.get("embedding", F.lit(i)).cast("double")
    images = data.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(1.0).alias("qw"), *[F.lit(0.0).alias(f"q{c}") for c in "xyz"], *[get(4 + i).alias(f"t{c}") for i, c in enumerate("xyz")]
    )
    out = evaluate.moved_cameras(images, transforms.Similarity(None, (1.0, -3.0, 0.5), 2.0))
    return out.select("image_id", r6("cx"), r6("cy"), r6("cz"), r6("tx"))


@query(
    """WITH i AS (SELECT p_partkey AS image_id, 640 + p_size % 3 * 10 AS width, 480 AS height, 0.02::DOUBLE AS f, 0.00001 * (1 + p_size % 2)::DOUBLE AS pw FROM part),
g AS (SELECT width, pw, min(image_id) AS m FROM i GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY m)::INTEGER AS camera_id FROM g)
SELECT image_id, camera_id, round(f / i.pw, 6) AS fx FROM i JOIN n ON i.width = n.width AND i.pw = n.pw"""
)
def intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    rows = data.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"),
        (640 + k % 3 * 10).alias("width"),
        F.lit(480).alias("height"),
        F.lit(0.02).alias("focal_length"),
        (0.00001 * (1 + k % 2)).alias("pixel_width"),
        (0.00001 * (1 + k % 2)).alias("pixel_height"),
        F.lit(320.0).alias("cx"),
        F.lit(240.0).alias("cy"),
    )
    return evaluate.intrinsics(rows).select("image_id", "camera_id", r6("fx"))


@query(
    f"""WITH {data.SPANS} SELECT l_orderkey, key, lo, hi, (lo - 0.5 <= 1300 AND hi + 0.5 >= 1200) OR (lo - 0.5 <= 2050 AND hi + 0.5 >= 2000) AS crosses FROM spans"""
)
def ray_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.spans(spark, sf_dir)
    crosses = intervals.ray_crosses(F.col("hi"), F.col("lo"), [(1200.0, 1300.0), (2000.0, 2050.0)])
    return rows.select("l_orderkey", "key", "lo", "hi", crosses.alias("crosses"))


@query("SELECT i::BIGINT AS i, a, b FROM (VALUES (3, 2.0::DOUBLE, 2.5::DOUBLE), (5, 4.0, NULL)) t(i, a, b)")
def same_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of five stations against one of four, the third of which is moved."""
    a = spark.range(5).select(F.col("id").cast("double").alias("s"))
    b = spark.range(4).select((F.col("id") + F.when(F.col("id") == 2, 0.5).otherwise(0.0)).alias("s"))
    return volume.same_grid(a, b, "s").select(F.col("i").cast("long").alias("i"), "a", "b")


@query(
    """WITH p AS (SELECT p_brand, p_type, avg(p_retailprice) AS a, count(*) AS n FROM part GROUP BY ALL),
r AS (SELECT p_brand, sum(n) OVER (PARTITION BY p_brand) AS images, abs(a - lead(a) OVER w) AS margin, row_number() OVER w AS i, max(a) OVER (PARTITION BY p_brand) - min(a) OVER (PARTITION BY p_brand) AS spread
  FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY a, p_type))
SELECT p_brand, CASE WHEN images < 60 THEN 'insufficient' WHEN spread > 250 THEN 'inconsistent' WHEN margin < 20 THEN 'ambiguous' ELSE 'selected' END AS status FROM r WHERE i = 1"""
)
def calibration_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("a"), F.count("*").alias("n"))
    extent = rows.groupBy("p_brand").agg(F.sum("n").alias("images"), (F.max("a") - F.min("a")).alias("spread"))
    ranked = rules.best_with_margin(rows, ["p_brand"], "a", "p_type").join(extent, "p_brand")
    return rules.calibration_status(ranked, "images", 60, "spread", 250.0, 20.0).select("p_brand", "status")


@query(
    """WITH g AS (SELECT vec_id, embedding[1]::DOUBLE AS o, embedding[2]::DOUBLE AS a, embedding[3]::DOUBLE AS b, embedding[4]::DOUBLE AS c FROM embeddings),
w AS (SELECT vec_id, exp(a + b + c) / (1 + exp(-o)) AS weight FROM g) SELECT vec_id, row_number() OVER (ORDER BY weight DESC, vec_id)::INTEGER AS place, round(weight, 6) AS weight FROM w"""
)
def splat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussians by importance."""
    from pyspark.sql.window import Window

    get = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = data.table(spark, sf_dir, "embeddings").select("vec_id", raster.splat_order(get(0), get(1), get(2), get(3)).alias("weight"))
    place = F.row_number().over(Window.orderBy(F.desc("weight"), "vec_id"))
    return rows.select("vec_id", place.alias("place"), r6("weight"))


@query(
    """WITH e AS (SELECT label AS image, embedding[1]::DOUBLE AS w, abs(embedding[2]::DOUBLE) + 0.5 AS d, abs(embedding[3]::DOUBLE) + 0.5 AS z FROM embeddings),
i AS (SELECT image, sum(w * abs(1 / z - 1 / d)) / count(*) AS t FROM e WHERE w > 0 GROUP BY 1) SELECT count(*) AS images, round(avg(t), 6) AS term FROM i"""
)
def disparity_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = data.table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("image"), get(0).alias("w"), (F.abs(get(1)) + 0.5).alias("depth"), (F.abs(get(2)) + 0.5).alias("z")
    )
    return raster.disparity_term(rows).select("images", r6("term"))


@query(
    """WITH g AS (SELECT vec_id, embedding[1 + r * 8 + c]::DOUBLE AS value, r, c FROM embeddings, range(8) a(r), range(8) b(c)),
s AS (SELECT vec_id, (vec_id % 6) + 0.25 AS u, (vec_id % 5) + 0.5 AS v FROM embeddings),
k AS (SELECT s.vec_id, u, v, sum(value * (1 - abs(c - u)) * (1 - abs(r - v))) AS value FROM s JOIN g ON s.vec_id = g.vec_id AND abs(c - u) < 1 AND abs(r - v) < 1 GROUP BY ALL)
SELECT vec_id, u::DOUBLE AS u, v::DOUBLE AS v, round(value, 6) + 0.0 AS value FROM k"""
)
def bilinear_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "embeddings")
    grid = rows.select("vec_id", F.posexplode("embedding").alias("p", "value")).select(
        "vec_id", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).alias("col"), F.col("value").cast("double").alias("value")
    )
    at = rows.select("vec_id", (F.col("vec_id") % 6 + 0.25).cast("double").alias("u"), (F.col("vec_id") % 5 + 0.5).cast("double").alias("v"))
    return raster.bilinear(grid, at, ["vec_id"]).select("vec_id", "u", "v", r6("value"))


@query(
    """WITH g AS (SELECT label AS image, a.r, b.c, avg(embedding[1]::DOUBLE) + 3 AS d FROM embeddings, range(0, 12, 4) a(r), range(0, 16, 4) b(c) GROUP BY ALL)
SELECT image, r::INTEGER AS "row", c::INTEGER AS col, round((c + 0.5 - 8) / 20 * d, 6) + 0.0 AS x, round((r + 0.5 - 6) / 20 * d, 6) + 0.0 AS y, round(d, 6) AS z FROM g"""
)
def back_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth maps of constant depth, every fourth pixel, to camera coordinates."""
    images = data.table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("image")).agg((F.avg(F.get("embedding", F.lit(0)).cast("double")) + 3).alias("d"))
    grid = raster.pixel_grid(images.withColumns({"w": F.lit(16), "h": F.lit(12)}), "w", "h", 4)
    p = transforms.back_project(F.col("col"), F.col("row"), F.col("d"), 20.0, 20.0, 8.0, 6.0, pixel_centre=True)
    out = grid.withColumns(dict(zip("xyz", p, strict=True)))
    return out.select("image", "row", "col", r6("x"), r6("y"), r6("z"))


@query(
    f"""SELECT 'p' || k || '_y' || lpad(i::VARCHAR, 2, '0') AS name, 360.0::DOUBLE * i / 8 AS yaw, CASE k WHEN 0 THEN -20::DOUBLE ELSE 15::DOUBLE END AS pitch, round({256 / math.tan(math.radians(45))!r}::DOUBLE, 6) AS focal FROM range(2) a(k), range(8) b(i)"""
)
def ring_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(raster.crop_views(8, [-20.0, 15.0], 90.0, 512), "name string, yaw double, pitch double, focal double")
    return rows.select("name", "yaw", "pitch", r6("focal"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s)
SELECT user_id, epoch_us(min(ts)) AS lo_us, epoch_us(max(ts) + INTERVAL 6 HOUR) AS hi_us, count(*) AS n FROM r GROUP BY user_id, run"""
)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of observations without a step of six hours (the streaming operator on a table)."""
    out = stream.sessions(data.table(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.unix_micros("lo").alias("lo_us"), F.unix_micros("hi").alias("hi_us"), "n")


@query("SELECT s_suppkey % 7 AS key, count(*) FILTER (d <= 0) AS issues FROM (SELECT s_suppkey, s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) - 1e-9 AS d FROM supplier) GROUP BY 1")
def monotonic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 7).alias("key"), F.col("s_suppkey").alias("_place"), F.col("s_acctbal").alias("s"))
    return lineage.monotonic_issues(rows, ["key"], "s")
