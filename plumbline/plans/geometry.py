"""Queries on chunks, point clouds, nearest neighbours, registration, images and meshes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import data
from ..operators import chunks, frames_select, lineage, mesh, nn, points, raster, register, rules, transforms
from .registry import query, r6

_INNER = (30.0, 60.0, 90.0)


def _plan_values() -> list[tuple]:
    return chunks.core_plan(0.0, 120.0, 30.0, 8.0)


@query(
    """SELECT i::INTEGER AS ordinal, i * 30::DOUBLE AS core_lo, (i + 1) * 30::DOUBLE AS core_hi,
 greatest(i * 30 - 8, 0)::DOUBLE AS support_lo, least((i + 1) * 30 + 8, 120)::DOUBLE AS support_hi FROM range(4) t(i)"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan_table(spark, _plan_values())


@query("SELECT 'cores do not tile' AS issue, 2::INTEGER AS ordinal UNION ALL SELECT 'core outside support', 3::INTEGER")
def chunk_plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [(i, lo + 1.0 * (i == 2), hi, a, b - 9.0 * (i == 3)) for i, lo, hi, a, b in _plan_values()]
    return chunks.plan_issues(chunks.plan_table(spark, plan)).select("issue", "ordinal")


@query(
    f"""WITH {data.TUNNEL}, w AS (SELECT i::INTEGER AS ordinal, i * 30::DOUBLE AS lo, least(i * 30 + 40, 120)::DOUBLE AS hi FROM range(4) t(i))
SELECT scan, ordinal, count(*) AS n FROM tunnel JOIN w ON s BETWEEN lo AND hi GROUP BY ALL"""
)
def chunk_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = chunks.window_plan(0.0, 120.0, 40.0, 10.0)
    return chunks.membership(data.tunnel(spark, sf_dir), plan).groupBy("scan", "ordinal").agg(F.count("*").alias("n"))


@query(f"WITH {data.TUNNEL} SELECT scan, least(floor(s / 30), 3)::INTEGER AS owner, count(*) AS n FROM tunnel GROUP BY ALL")
def owner_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chunks.owner(F.col("s"), _INNER).alias("owner")
    return data.tunnel(spark, sf_dir).groupBy("scan", own).agg(F.count("*").alias("n"))


_CHUNKED = f"""WITH {data.TUNNEL}, plan AS (SELECT i::INTEGER AS ordinal, i * 30 AS clo, (i + 1) * 30 AS chi,
 greatest(i * 30 - 8, 0)::DOUBLE AS lo, least((i + 1) * 30 + 8, 120)::DOUBLE AS hi FROM range(4) t(i)),
sec AS (SELECT ordinal, floor(s)::DOUBLE AS s, avg(r) + any_value(ordinal) * 0.01::DOUBLE AS area FROM tunnel JOIN plan ON s BETWEEN lo AND hi
        WHERE floor(s)::INTEGER % 13 <> 0 GROUP BY ordinal, floor(s))"""


def _chunk_sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    plan = chunks.plan_table(spark, _plan_values())
    windows = [(i, a, b) for i, _, _, a, b in _plan_values()]
    rows = chunks.membership(data.tunnel(spark, sf_dir).filter(F.floor("s") % 13 != 0), windows)
    cut = rows.groupBy("ordinal", F.floor("s").cast("double").alias("s")).agg(F.avg("r").alias("m"))
    return plan, cut.select("ordinal", "s", (F.col("m") + F.col("ordinal") * 0.01).alias("area"))


@query(
    _CHUNKED
    + """, st AS (SELECT i::DOUBLE AS s, least(floor(i / 30), 3)::INTEGER AS owner FROM range(120) t(i))
SELECT st.s, st.owner, round(sec.area, 6) AS area, sec.area IS NOT NULL AS valid FROM st LEFT JOIN sec ON sec.s = st.s AND sec.ordinal = st.owner"""
)
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cut = _chunk_sections(spark, sf_dir)
    grid = spark.range(120).select(F.col("id").cast("double").alias("s"))
    return chunks.stitch(grid, cut, _INNER).select("s", "owner", r6("area"), "valid")


@query(
    _CHUNKED
    + """, p AS (SELECT a.ordinal AS left_chunk, b.ordinal AS right_chunk, b.lo AS lo, a.hi AS hi FROM plan a JOIN plan b ON b.ordinal = a.ordinal + 1),
e AS (SELECT left_chunk, r.area - l.area AS d FROM p JOIN sec l ON l.ordinal = left_chunk JOIN sec r ON r.ordinal = right_chunk AND r.s = l.s
      WHERE l.s BETWEEN p.lo AND p.hi)
SELECT left_chunk, count(*) AS stations, round(quantile_cont(abs(d), 0.5), 6) AS median_abs, round(quantile_cont(abs(d), 0.95), 6) AS p95_abs,
 round(avg(d), 6) + 0.0 AS mean_signed FROM e GROUP BY 1"""
)
def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, cut = _chunk_sections(spark, sf_dir)
    return chunks.seams(cut, plan).select("left_chunk", "stations", r6("median_abs"), r6("p95_abs"), r6("mean_signed"))


@query(
    f"""WITH {data.SPANS} SELECT ordinal::INTEGER AS ordinal, count(*) AS n FROM spans JOIN (SELECT i AS ordinal, 1000 + i * 500 AS lo_, 1600 + i * 500 AS hi_ FROM range(4) t(i)) p
ON hi >= lo_ AND lo <= hi_ GROUP BY 1"""
)
def group_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = [(i, 0.0, 0.0, 1000.0 + i * 500, 1600.0 + i * 500) for i in range(4)]
    rows = chunks.group_chunks(data.spans(spark, sf_dir), chunks.plan_table(spark, plan), "lo", "hi")
    return rows.groupBy("ordinal").agg(F.count("*").alias("n"))


_KEYS = ", ".join(data.ORDER)


@query(
    f"""WITH {data.TUNNEL}, f AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) ORDER BY {_KEYS}) AS i FROM tunnel)
SELECT l_orderkey, l_linenumber, l_partkey, scan, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM f WHERE i = 1"""
)
def voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.voxel_first(data.tunnel(spark, sf_dir), 0.5, data.ORDER)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "scan", r6("x"), r6("y"), r6("z"))


@query(
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', 'b7', doc_id::VARCHAR)), doc_id) AS i FROM documents)
SELECT source, doc_id FROM d WHERE i <= 5"""
)
def budget_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "documents").select("source", "doc_id")
    return points.budget(rows, ["source"], 5, "b7", ["doc_id"])


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT DISTINCT o_custkey, o_orderkey FROM o JOIN range(4) t(k) ON i = round_even(k * (n - 1) / 3::DOUBLE, 0)"""
)
def even_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return points.even_pick(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 4).select("o_custkey", "o_orderkey")


@query(
    f"""WITH {data.TUNNEL} SELECT scan, count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y,
 round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(avg(x), 6) AS mean_x, round(avg(y), 6) + 0.0 AS mean_y, round(avg(z), 6) + 0.0 AS mean_z,
 round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS span FROM tunnel GROUP BY 1"""
)
def bounds_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.bounds(data.tunnel(spark, sf_dir), ["scan"])
    return out.select("scan", "n", *[r6(c) for c in out.columns if c not in ("scan", "n")])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 least(greatest(round_even((l_quantity - 1) / 49 * 255, 0), 0), 255)::SMALLINT AS grey FROM lineitem WHERE l_returnflag <> 'R'"""
)
def mask_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = data.table(spark, sf_dir, "lineitem").withColumn("state", (F.col("l_returnflag") == "R").cast("int"))
    return points.keep_valid(li, "state").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", points.rescale_colour(F.col("l_quantity"), 1.0, 50.0).alias("grey")
    )


@query(
    f"""WITH {data.TUNNEL}, t AS (SELECT floor(x / 20)::BIGINT AS own, unnest(range(floor((x - 2) / 20)::BIGINT, floor((x + 2) / 20)::BIGINT + 1)) AS tile_x,
  y, floor(y / 20)::BIGINT AS own_y FROM tunnel),
u AS (SELECT own, tile_x, own_y, unnest(range(floor((y - 2) / 20)::BIGINT, floor((y + 2) / 20)::BIGINT + 1)) AS tile_y FROM t)
SELECT tile_x, tile_y, count(*) AS n, count(*) FILTER (own = tile_x AND own_y = tile_y) AS core FROM u GROUP BY ALL"""
)
def tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points.tiles(data.tunnel(spark, sf_dir), 20.0, 2.0)
    return rows.groupBy("tile_x", "tile_y").agg(F.count("*").alias("n"), F.count_if("core").alias("core"))


@query(
    f"""WITH {data.TUNNEL}, k AS (SELECT * FROM tunnel WHERE NOT (s BETWEEN 40 AND 46)),
a AS (SELECT *, row_number() OVER (PARTITION BY scan, floor(x / 0.3), floor(y / 0.3), floor(z / 0.3) ORDER BY {_KEYS}) AS i FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) ORDER BY {_KEYS}) AS j FROM a WHERE i = 1),
r AS (SELECT scan, count(*) AS read, count(*) FILTER (s BETWEEN 40 AND 46) AS removed FROM tunnel GROUP BY 1),
t AS (SELECT scan, count(*) AS thinned, count(*) FILTER (j = 1) AS kept FROM b GROUP BY 1)
SELECT scan, read, removed, coalesce(thinned, 0) AS thinned, coalesce(kept, 0) AS kept FROM r LEFT JOIN t USING (scan)"""
)
def init_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = points.init_cloud(data.tunnel(spark, sf_dir), F.col("s").between(40, 46), 0.3, 0.5, data.ORDER)
    return counts


@query(f"WITH {data.CLOUD} SELECT round(round_even(avg(x) / 0.1, 0) * 0.1, 6) + 0.0 AS x, round(round_even(avg(y) / 0.1, 0) * 0.1, 6) + 0.0 AS y, round(round_even(avg(z) / 0.1, 0) * 0.1, 6) + 0.0 AS z FROM cloud")
def local_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.local_origin(data.cloud(spark, sf_dir)).select(r6("x"), r6("y"), r6("z"))


_EVEN_ODD = f"WITH {data.CLOUD}, q AS (SELECT * FROM cloud WHERE scan % 2 = 0), f AS (SELECT * FROM cloud WHERE scan % 2 = 1)"
_NN = _EVEN_ODD + """, d AS (SELECT q.id, f.id AS ref_id, (q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2 AS d2 FROM q, f),
n AS (SELECT id, min(struct_pack(d2 := d2, ref_id := ref_id)) AS b FROM d WHERE d2 < 0.25 GROUP BY 1),
dist AS (SELECT q.id, b.ref_id AS ref_id, sqrt(b.d2) AS distance FROM q LEFT JOIN n USING (id)),
e AS (SELECT f.id AS id, min(CASE WHEN d2 < 0.25 THEN d2 END) AS d2 FROM f JOIN d ON d.ref_id = f.id GROUP BY 1),
back AS (SELECT id, sqrt(d2) AS distance FROM e)"""


def _even_odd(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = data.cloud(spark, sf_dir)
    return rows.filter("scan % 2 = 0"), rows.filter("scan % 2 = 1")


@query(_NN + " SELECT id, ref_id, round(distance, 6) AS distance FROM dist")
def nn_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.nearest(*_even_odd(spark, sf_dir), 0.5).select("id", "ref_id", r6("distance"))


@query(_EVEN_ODD + ", d AS (SELECT q.id, min((q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2) AS d2 FROM q, f GROUP BY 1) SELECT id, round(sqrt(d2), 6) AS distance FROM d")
def nn_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.nearest_unbounded(*_even_odd(spark, sf_dir), 0.25).select("id", r6("distance"))


@query(
    _NN
    + """, c AS (SELECT coalesce(distance, 0.5) AS d, distance IS NULL AS miss FROM dist)
SELECT count(*) AS n, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rmse, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90,
 round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max, round(avg((d <= 0.3)::INT), 6) AS within, round(avg(miss::INT), 6) AS clipped FROM c"""
)
def geometry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nn.distance_stats(nn.nearest(*_even_odd(spark, sf_dir), 0.5), [], 0.5, 0.3)
    return out.select("n", *[r6(c) for c in out.columns if c != "n"])


@query(
    _NN
    + """, a AS (SELECT avg(coalesce(distance, 0.5)) AS m, avg((coalesce(distance, 0.5) <= 0.3)::INT) AS w FROM dist),
b AS (SELECT avg(coalesce(distance, 0.5)) AS m, avg((coalesce(distance, 0.5) <= 0.3)::INT) AS w FROM back)
SELECT round(a.m, 6) AS accuracy, round(b.m, 6) AS completeness, round((a.m + b.m) / 2, 6) AS chamfer, round(a.w, 6) AS precision, round(b.w, 6) AS recall,
 round(CASE WHEN a.w + b.w > 0 THEN 2 * a.w * b.w / (a.w + b.w) ELSE 0 END, 6) AS f_score FROM a, b"""
)
def fscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nn.compare_clouds(*_even_odd(spark, sf_dir), 0.5, 0.3)
    return out.select(*[r6(c) for c in out.columns])


@query(_EVEN_ODD + " SELECT q.id FROM q WHERE EXISTS (SELECT 1 FROM f WHERE (q.x - f.x) ** 2 + (q.y - f.y) ** 2 + (q.z - f.z) ** 2 <= 0.09)")
def match_within_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn.within_tolerance(*_even_odd(spark, sf_dir), 0.3).select("id")


@query(
    _NN
    + """ SELECT count(*) AS n, round(sqrt(avg(CASE WHEN distance < 0.3 THEN distance ** 2 END)), 6) AS rmse, round(quantile_cont(distance, 0.5), 6) AS median,
 round(quantile_cont(distance, 0.9), 6) AS p90, round(avg((distance < 0.3)::INT), 6) AS inlier_ratio FROM dist WHERE distance IS NOT NULL"""
)
def registration_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nn.nearest(*_even_odd(spark, sf_dir), 0.5).filter("distance IS NOT NULL")
    out = nn.diagnose(rows, [], 0.3)
    return out.select("n", *[r6(c) for c in out.columns if c != "n"])


def _known() -> transforms.Similarity:
    return transforms.Similarity(transforms.axis_rotation("z", 30.0), (5.0, -2.0, 1.0), 1.5)


_C, _S = math.cos(math.radians(30.0)), math.sin(math.radians(30.0))
_MOVED = f"""WITH {data.CLOUD}, m AS (SELECT id, x AS sx, y AS sy, z AS sz, 1.5 * ({_C!r} * x - {_S!r} * y) + 5 AS tx, 1.5 * ({_S!r} * x + {_C!r} * y) - 2 AS ty, 1.5 * z + 1 AS tz FROM cloud)"""


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cloud(spark, sf_dir)
    target = rows.select("id", *[c.alias(n) for c, n in zip(_known().apply(transforms.vec()), "xyz", strict=True)])
    return register.match_by_id(rows, target)


@query(_MOVED + " SELECT id, round(tx, 6) + 0.0 AS tx, round(ty, 6) + 0.0 AS ty, round(tz, 6) + 0.0 AS tz FROM m")
def rigid_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).select("id", r6("tx"), r6("ty"), r6("tz"))


_MOMENTS = ", ".join(f"round(sum(t{a} * s{b}), 5) AS t{a}s{b}" for a in "xyz" for b in "xyz")


@query(
    _MOVED
    + f""" SELECT count(*)::DOUBLE AS w, round(sum(sx), 5) AS sx, round(sum(sy), 5) AS sy, round(sum(sz), 5) AS sz, round(sum(tx), 5) AS tx, round(sum(ty), 5) AS ty,
 round(sum(tz), 5) AS tz, {_MOMENTS}, round(sum(sx * sx + sy * sy + sz * sz), 5) AS ss FROM m"""
)
def umeyama_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = register.moments(_moved(spark, sf_dir))
    return out.select("w", *[F.round(c, 5).alias(c) for c in out.columns if c != "w"])


@query("SELECT 1.5::DOUBLE AS scale, 5::DOUBLE AS tx, -2::DOUBLE AS ty, 1::DOUBLE AS tz, 30::DOUBLE AS degrees")
def umeyama_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = register.fit_similarity(_moved(spark, sf_dir))
    row = (m.scale, *m.t.tolist(), math.degrees(math.atan2(m.r[1, 0], m.r[0, 0])))
    return spark.createDataFrame([tuple(round(float(v), 6) for v in row)], "scale double, tx double, ty double, tz double, degrees double")


@query("SELECT 0.04::DOUBLE AS tx, -0.03::DOUBLE AS ty, 0.02::DOUBLE AS tz")
def icp_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-to-point registration of a cloud to its own shifted copy."""
    rows = data.cloud(spark, sf_dir)
    shift = transforms.Similarity(None, (0.04, -0.03, 0.02))
    target = rows.select("id", *[c.alias(n) for c, n in zip(shift.apply(transforms.vec()), "xyz", strict=True)])
    m, _ = register.icp(rows, target, 0.4, rounds=12)
    return spark.createDataFrame([tuple(round(float(v), 4) for v in m.t)], "tx double, ty double, tz double")


@query(
    f"""WITH {data.CLOUD}, p AS (SELECT id, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS azimuth,
 asin(z / sqrt(x * x + y * y + z * z)) AS elevation, sqrt(x * x + y * y + z * z) AS r, x, y, z FROM cloud)
SELECT id, round(azimuth, 6) AS azimuth, round(elevation, 6) + 0.0 AS elevation, round(r, 6) AS r, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
 round(azimuth / (2 * pi()), 6) AS u, round(0.5 - elevation / pi(), 6) AS v FROM p"""
)
def spherical_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.cloud(spark, sf_dir)
    azimuth, elevation, r = transforms.spherical(transforms.vec())
    u, v = transforms.equirect_uv(transforms.vec())
    out = rows.select("id", azimuth.alias("azimuth"), elevation.alias("elevation"), r.alias("r"), u.alias("u"), v.alias("v"))
    back = transforms.cartesian(F.col("azimuth"), F.col("elevation"), F.col("r"))
    out = out.withColumns(dict(zip("xyz", back, strict=True)))
    return out.select("id", *[r6(c) for c in ("azimuth", "elevation", "r", "x", "y", "z", "u", "v")])


def _quaternions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "embeddings")
    q = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    size = F.sqrt(sum(c * c for c in q))
    sign = F.when(q[0] < 0, -1.0).otherwise(1.0)
    return rows.select("vec_id", *[(sign * c / size).alias(n) for c, n in zip(q, "wxyz", strict=True)])


@query(
    """WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings),
n AS (SELECT *, CASE WHEN w < 0 THEN -1 ELSE 1 END / sqrt(w * w + x * x + y * y + z * z) AS k FROM q)
SELECT vec_id, round(w * k, 6) + 0.0 AS w, round(x * k, 6) + 0.0 AS x, round(y * k, 6) + 0.0 AS y, round(z * k, 6) + 0.0 AS z, 'ok' AS verdict FROM n"""
)
def quaternion_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quaternion to matrix and back; the matrix is checked to be a rotation."""
    rows = _quaternions(spark, sf_dir)
    m = transforms.quaternion_matrix(*[F.col(c) for c in "wxyz"])
    flat = rows.select("vec_id", *[m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)])
    again = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    _, _, verdict = transforms.rotation_errors(again)
    out = flat.select("vec_id", verdict.alias("verdict"), *[c.alias(n) for c, n in zip(transforms.matrix_quaternion(again), "wxyz", strict=True)])
    return out.select("vec_id", r6("w"), r6("x"), r6("y"), r6("z"), "verdict")


_CAMERA = f"""WITH {data.TUNNEL}, cam AS (SELECT n_nationkey AS camera_id, n_nationkey * 5::DOUBLE AS cx_ FROM nation),
seen AS (SELECT t.*, camera_id, 400 * (-y) / (x - cx_) + 320 AS u, 400 * (-z) / (x - cx_) + 240 AS v, x - cx_ AS depth FROM tunnel t, cam
  WHERE x - cx_ > 0.05 AND x - cx_ < 200 AND abs(x - cx_) >= 1e-12),
vis AS (SELECT * FROM seen WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480)"""


def _cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras that look along the tunnel: image x is -y, image y is -z, depth is x."""
    r = [[0.0, -1.0, 0.0], [0.0, 0.0, -1.0], [1.0, 0.0, 0.0]]
    return data.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("camera_id"),
        *[F.lit(r[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)],
        F.lit(0.0).alias("tx"),
        F.lit(0.0).alias("ty"),
        (F.col("n_nationkey") * -5.0).alias("tz"),
        *[F.lit(v).alias(n) for n, v in {"fx": 400.0, "fy": 400.0, "cx": 320.0, "cy": 240.0, "width": 640, "height": 480}.items()],
    )


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.project_all(data.tunnel(spark, sf_dir), _cameras(spark, sf_dir))


@query(
    _CAMERA
    + """, c AS (SELECT camera_id, count(*) AS visible, quantile_cont(depth, 0.5) AS m FROM vis GROUP BY 1), n AS (SELECT count(*) AS total FROM tunnel)
SELECT cam.camera_id, coalesce(visible, 0) AS visible, round(coalesce(visible, 0) / total::DOUBLE, 6) AS share, round(m, 6) AS median_depth FROM cam LEFT JOIN c USING (camera_id), n"""
)
def project_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = data.table(spark, sf_dir, "lineitem").count()
    out = raster.visibility(_seen(spark, sf_dir), _cameras(spark, sf_dir), total)
    return out.select("camera_id", "visible", r6("share"), r6("median_depth"))


@query(_CAMERA + ' SELECT camera_id, floor(v)::INTEGER AS "row", floor(u)::INTEGER AS col, min(depth::FLOAT) AS depth FROM vis GROUP BY ALL')
def zbuffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.z_buffer(_seen(spark, sf_dir))


@query(
    _CAMERA
    + f""", placed AS (SELECT *, floor(v / 16)::INTEGER AS r_, floor(u / 16)::INTEGER AS c_ FROM vis),
first_ AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY camera_id, r_, c_ ORDER BY depth, {_KEYS}) = 1),
nb AS (SELECT a.camera_id, a.r_, a.c_, min(b.depth) AS least_ FROM first_ a JOIN first_ b ON a.camera_id = b.camera_id AND abs(a.r_ - b.r_) <= 1 AND abs(a.c_ - b.c_) <= 1 GROUP BY ALL)
SELECT camera_id, depth > least_ * 1.05 AS occluded, count(*) AS n, round(sum(depth), 4) AS depth FROM first_ JOIN nb USING (camera_id, r_, c_) GROUP BY ALL"""
)
def nearest_cell_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raster.nearest_visible(_seen(spark, sf_dir), ["camera_id"], 16.0, 3, 0.05, data.ORDER)
    return rows.groupBy("camera_id", "occluded").agg(F.count("*").alias("n"), F.round(F.sum("depth"), 4).alias("depth"))


_EMB = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


@query(
    _EMB
    + """, m AS (SELECT a.vec_id, avg((a.v - b.v) ** 2) AS mse FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY 1)
SELECT vec_id, round(mse, 9) AS mse, round(-10 * log10(mse), 6) AS psnr FROM m"""
)
def psnr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    rows = rows.withColumn("v", F.col("v").cast("double"))
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("v").alias("w"))
    out = raster.psnr(rows.join(other, ["vec_id", "i"]), ["vec_id"], "v", "w")
    return out.select("vec_id", F.round("mse", 9).alias("mse"), r6("psnr"))


@query()
def ssim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images of neighbouring embeddings (no SQL: a sliding Gaussian window)."""
    scaled = F.transform("embedding", lambda x: (x.cast("double") + 1) / 2)
    rows = data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), scaled.alias("a"))
    other = rows.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return raster.ssim(rows.join(other, "id"), 8).select("id", r6("ssim"))


@query(
    """SELECT vec_id, sum(CASE WHEN embedding[i + 2] > embedding[i + 1] THEN (1::BIGINT << i) ELSE 0 END)::BIGINT AS hash
 FROM embeddings, range(0, 63) t(i) GROUP BY 1"""
)
def dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", frames_select.dhash(F.col("embedding"), 63).alias("hash"))


@query(
    """WITH h AS (SELECT vec_id, label, sum(CASE WHEN embedding[i + 2] > embedding[i + 1] THEN (1::BIGINT << i) ELSE 0 END)::BIGINT AS hash
 FROM embeddings, range(0, 63) t(i) GROUP BY ALL)
SELECT vec_id, bit_count(xor(hash, lag(hash) OVER (PARTITION BY label ORDER BY vec_id)))::INTEGER AS distance FROM h"""
)
def dhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "embeddings").select("vec_id", "label", frames_select.dhash(F.col("embedding"), 63).alias("h"))
    before = F.lag("h").over(Window.partitionBy("label").orderBy("vec_id"))
    return rows.select("vec_id", frames_select.hamming(F.col("h"), before).cast("int").alias("distance"))


_MESH = """WITH v AS (SELECT vec_id AS vertex, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
t AS (SELECT a.vertex AS face, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
  FROM v a JOIN v b ON b.vertex = a.vertex + 1 JOIN v c ON c.vertex = a.vertex + 2)"""


@query(_MESH + " SELECT face % 7 AS part, round(abs(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx))) / 6, 8) AS volume FROM t GROUP BY 1")
def mesh_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = data.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("vertex"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")]
    )
    faces = v.select(F.col("vertex").alias("face"), F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"), (F.col("vertex") + 2).alias("c"))
    rows = mesh.corners(faces, v).withColumn("part", F.col("face") % 7)
    return mesh.volume(rows, ["part"]).select("part", F.round("volume", 8).alias("volume"))


@query(
    """WITH p AS (SELECT p_brand, p_type, avg(p_retailprice) AS a FROM part GROUP BY ALL),
r AS (SELECT p_brand, p_type AS best, lead(p_type) OVER w AS runner_up, abs(a - lead(a) OVER w) AS margin, a, row_number() OVER w AS i FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY a, p_type))
SELECT p_brand, best, runner_up, round(margin, 6) AS margin, round(a, 6) AS score FROM r WHERE i = 1"""
)
def rank_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("a"))
    return rules.best_with_margin(rows, ["p_brand"], "a", "p_type").select("p_brand", "best", "runner_up", r6("margin"), r6("score"))


@query(
    f"""WITH {data.CLOUD}, c AS (SELECT * FROM (VALUES ('+x+y+z', 1, 0, 0, 1), ('-x-y+z', -1, 0, 0, -1), ('+y-x+z', 0, 1, -1, 0), ('-y+x+z', 0, -1, 1, 0)) t(label, a, b, c, d)),
r AS (SELECT label, avg(sqrt((a * x + b * y - y) ** 2 + (c * x + d * y + x) ** 2)) AS residual, count(*) AS n FROM cloud, c GROUP BY 1),
k AS (SELECT *, row_number() OVER w AS i, lead(label) OVER w AS runner_up, abs(residual - lead(residual) OVER w) AS margin FROM r WINDOW w AS (ORDER BY residual, label))
SELECT label AS best, runner_up, round(residual, 6) + 0.0 AS residual, round(margin, 6) AS margin FROM k WHERE i = 1"""
)
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rotation about z explains observations that are turned by a quarter."""
    kinds = [(label, *m[:2, :2].ravel().tolist()) for label, m in transforms.signed_permutations() if m[2, 2] == 1]
    candidates = spark.createDataFrame(kinds, "label string, a double, b double, c double, d double")
    rows = data.cloud(spark, sf_dir).withColumns({"obs_u": F.col("y"), "obs_v": -F.col("x")})
    predicted = {"u": F.col("a") * F.col("x") + F.col("b") * F.col("y"), "v": F.col("c") * F.col("x") + F.col("d") * F.col("y")}
    scored = rules.score_candidates(rows, candidates, predicted, ["label"])
    out = rules.best_with_margin(scored, [], "residual", "label")
    return out.select("best", "runner_up", r6("score", "residual"), r6("margin"))


@query(
    """WITH d AS (SELECT o_custkey AS key, count(*) + CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS declared, count(*) AS n FROM orders GROUP BY 1)
SELECT key, declared, n AS found FROM d WHERE declared <> n"""
)
def record_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = data.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    declared = orders.groupBy("key").agg(F.count("*").alias("n")).select("key", (F.col("n") + (F.col("key") % 10 == 0).cast("int")).alias("n"))
    return lineage.recount(declared, orders, "key", "n")
