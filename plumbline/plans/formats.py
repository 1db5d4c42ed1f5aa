"""Queries over sources and sinks (written to the shared folder and read back), images, masks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import data
from ..contracts import shared_folder
from ..operators import axis, intervals, points, raster, runs, staging, volume
from ..sources import text_formats
from ..streaming import coverage as stream
from .geometry import _CAMERA, _KEYS, _seen
from .registry import query, r6


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""WITH {data.SEGMENTS} SELECT (row_number() OVER (ORDER BY s) - 1)::INTEGER AS vertex, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(s, 6) AS s FROM chained"""
)
def axis_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An axis written as CSV and read back, chainage and order included."""
    path = _fresh(spark, "axis")
    text_formats.write_axis_csv(axis.chainage(data.vertices(spark, sf_dir), "k"), path)
    return text_formats.read_axis_csv(spark, path).select(F.col("vertex").cast("int").alias("vertex"), *[r6(c) for c in "xyzs"])


@query("SELECT 'T' || s_suppkey AS id, s_suppkey / 4::DOUBLE AS x, s_acctbal AS y, s_suppkey / 8::DOUBLE AS z FROM supplier")
def targets_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _fresh(spark, "targets")
    k = F.col("s_suppkey")
    rows = data.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), k).alias("id"), (k / 4).alias("x"), F.col("s_acctbal").alias("y"), (k / 8).alias("z")
    )
    rows.write.csv(path, header=True)
    return text_formats.read_targets_csv(spark, path)


@query(
    """SELECT ':line ' || (row_number() OVER (ORDER BY n_nationkey) + 1) AS line,
  CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '.jpg' ELSE n_nationkey::VARCHAR END AS image_ref,
  CASE WHEN n_nationkey % 2 = 0 THEN 'image_name' ELSE 'image_id' END AS image_ref_kind,
  CASE n_nationkey % 3 WHEN 0 THEN 'scan_id' WHEN 1 THEN 'scan_guid' ELSE 'station_id' END AS target_kind,
  'S' || n_regionkey AS target_value, 'vendor_manifest' AS evidence_type FROM nation"""
)
def mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping file whose rows name images and targets in different columns."""
    path = _fresh(spark, "mapping")
    k, target = F.col("n_nationkey"), F.concat(F.lit("S"), "n_regionkey")
    rows = data.table(spark, sf_dir, "nation").select(
        k.alias("k"),
        F.when(k % 2 == 0, F.concat(F.lower("n_name"), F.lit(".jpg"))).alias("image_name"),
        F.when(k % 2 == 1, k).alias("image_id"),
        F.when(k % 3 == 0, target).alias("scan_id"),
        F.when(k % 3 == 1, target).alias("scan_guid"),
        F.when(k % 3 == 2, target).alias("station_id"),
    )
    rows.coalesce(1).sortWithinPartitions("k").drop("k").write.csv(path, header=True)
    found = text_formats.read_mapping(spark, path, "vendor_manifest")
    return found.select(F.regexp_extract("origin", ":line [0-9]+$", 0).alias("line"), *found.columns[1:])


@query(
    f"""WITH {data.CLOUD}, v AS (SELECT row_number() OVER (ORDER BY id) AS i, x, y, z FROM cloud), n AS (SELECT count(*) // 3 AS faces FROM cloud)
SELECT 'v' AS kind, i, round(x, 6) AS a, round(y, 6) AS b, round(z, 6) AS c FROM v
UNION ALL SELECT 'f', k, 3 * k + 1, 3 * k + 2, 3 * k + 3 FROM n, range((SELECT faces FROM n)) t(k)"""
)
def obj_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh of the cloud's points, three to a face, written as OBJ and read back."""
    path = _fresh(spark, "mesh")
    cloud = data.cloud(spark, sf_dir)
    vertices = cloud.select(F.row_number().over(Window.orderBy("id")).cast("long").alias("vertex"), "x", "y", "z")
    k = F.col("id")
    faces = spark.range(cloud.count() // 3).select(k.alias("face"), (3 * k + 1).alias("a"), (3 * k + 2).alias("b"), (3 * k + 3).alias("c"))
    text_formats.write_obj(vertices, faces, path)
    v, f = text_formats.read_obj(spark, path)
    v = v.select(F.lit("v").alias("kind"), F.col("vertex").alias("i"), r6("x", "a"), r6("y", "b"), r6("z", "c"))
    return v.unionByName(f.select(F.lit("f").alias("kind"), F.col("face").alias("i"), *[F.col(c).cast("double").alias(c) for c in "abc"]))


@query(
    """WITH t AS (SELECT p_partkey AS id, least(greatest((p_size - 3) / 45::DOUBLE, 0), 1) AS x FROM part)
SELECT id, floor(least(greatest(1.5 - abs(4 * x - 3), 0), 1) * 255)::INTEGER AS r, floor(least(greatest(1.5 - abs(4 * x - 2), 0), 1) * 255)::INTEGER AS g,
  floor(least(greatest(1.5 - abs(4 * x - 1), 0), 1) * 255)::INTEGER AS b FROM t"""
)
def turbo_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = data.table(spark, sf_dir, "part")
    r, g, b = raster.turbo_like((F.col("p_size") - 3) / F.lit(45.0))
    return part.select(F.col("p_partkey").alias("id"), r.alias("r"), g.alias("g"), b.alias("b"))


@query(
    f"""WITH {data.CLOUD} SELECT id, degrees(atan2(z, sqrt(x ** 2 + y ** 2))) >= -30 AS above,
  NOT (x >= -1 AND x < 1 AND y >= -1 AND y < 2 OR x >= 1 AND x < 3 AND y >= -3 AND y < 0) AS outside FROM cloud"""
)
def pixel_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions above the nadir cone, and places outside two boxes."""
    cloud = data.cloud(spark, sf_dir)
    above = raster.nadir_mask((F.col("x"), F.col("y"), F.col("z")), -30.0)
    return cloud.select("id", above.alias("above"), raster.box_mask(F.col("x"), F.col("y"), [(-1, -1, 1, 2), (1, -3, 3, 0)]).alias("outside"))


@query(
    """WITH g AS (SELECT vec_id AS id, embedding[1]::DOUBLE + 2 AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z,
  exp(2 * embedding[5]::DOUBLE) AS a, exp(2 * embedding[6]::DOUBLE) AS b, exp(2 * embedding[7]::DOUBLE) AS c FROM embeddings),
n AS (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS l FROM g), q AS (SELECT id, a, b, c, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM n),
r AS (SELECT id, a, b, c, 1 - 2 * (y * y + z * z) AS r00, 2 * (x * y - w * z) AS r01, 2 * (x * z + w * y) AS r02, 2 * (x * y + w * z) AS r10, 1 - 2 * (x * x + z * z) AS r11,
  2 * (y * z - w * x) AS r12, 2 * (x * z - w * y) AS r20, 2 * (y * z + w * x) AS r21, 1 - 2 * (x * x + y * y) AS r22 FROM q)
SELECT id, round(r00 * r00 * a + r01 * r01 * b + r02 * r02 * c, 6) AS xx, round(r00 * r10 * a + r01 * r11 * b + r02 * r12 * c, 6) AS xy,
  round(r00 * r20 * a + r01 * r21 * b + r02 * r22 * c, 6) AS xz, round(r10 * r10 * a + r11 * r11 * b + r12 * r12 * c, 6) AS yy,
  round(r10 * r20 * a + r11 * r21 * b + r12 * r22 * c, 6) AS yz, round(r20 * r20 * a + r21 * r21 * b + r22 * r22 * c, 6) AS zz FROM r"""
)
def splat_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.get("embedding", F.lit(i)).cast("double") for i in range(7)]
    q = [e[0] + 2, *e[1:4]]
    length = F.sqrt(sum(x * x for x in q))
    found = raster.covariance(*[x / length for x in q], *e[4:7])
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]
    rows = data.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[c.alias(n) for c, n in zip(found, names, strict=True)])
    return rows.select("id", *[r6(n) for n in names])


@query(
    _CAMERA
    + f""", one AS (SELECT camera_id, floor(v)::INTEGER AS r_, floor(u)::INTEGER AS c_, arg_min(scan, struct_pack(depth := depth, {', '.join(f'{k} := {k}' for k in _KEYS.split(', '))})) AS scan FROM vis GROUP BY ALL)
SELECT camera_id, scan, count(*) AS pixels, sum(r_)::BIGINT AS rows_, sum(c_)::BIGINT AS cols_ FROM one GROUP BY ALL"""
)
def painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scan's colour each pixel gets when points are painted from far to near."""
    rows = raster.painted(_seen(spark, sf_dir), "scan", data.ORDER)
    return rows.groupBy("camera_id", "scan").agg(
        F.count("*").alias("pixels"), F.sum("row").cast("long").alias("rows_"), F.sum("col").cast("long").alias("cols_")
    )


@query(
    f"""WITH {data.CLOUD} SELECT scan, count(*) AS n, round(sum(x), 6) AS x, round(sum(y), 6) AS y, 'A' AS frame
FROM (SELECT scan, x, y FROM cloud UNION ALL SELECT scan, x + 1, y FROM cloud WHERE id % 3 = 0) GROUP BY 1"""
)
def concat_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clouds with different columns: what both have is kept, in the frame of the first."""
    cloud = data.cloud(spark, sf_dir)
    first = cloud.withColumns({"frame": F.lit("A"), "only_here": F.lit(1)})
    second = cloud.filter("id % 3 = 0").withColumns({"x": F.col("x") + 1, "frame": F.lit("B")})
    both = points.concat(first, second)
    return both.groupBy("scan").agg(F.count("*").alias("n"), r6_sum("x"), r6_sum("y"), F.max("frame").alias("frame"))


def r6_sum(name: str):
    return F.round(F.sum(name), 6).alias(name)


@query(
    """SELECT p_brand AS brand, round(avg((abs(p_size * 2 - 60) + abs(p_partkey % 200 - 90) + abs(p_size - 17)) / 3), 6) AS residual, count(*) AS n FROM part GROUP BY 1"""
)
def rgb_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    pairs = data.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), (size * 2).alias("pr"), (key % 200).alias("pg"), size.alias("pb"), F.lit(60).alias("r"), F.lit(90).alias("g"), F.lit(17).alias("b")
    )
    return raster.rgb_residual(pairs, ["brand"]).select("brand", r6("residual"), "n")


@query("SELECT DISTINCT floor(value / 25)::BIGINT AS kx, floor(user_id / 25)::BIGINT AS ky FROM events")
def stream_voxel_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point of each voxel of a stream of points."""
    events = stream.event_stream(spark, sf_dir).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.lit(0.0).alias("z")
    )
    done = stream.run_to_end(stream.first_of_voxel(events, 25.0, late="1000 days"), "append")
    return done.select("kx", "ky")


@query(
    "SELECT event_type, epoch_us(w) AS start_us, count(*) AS n, round(sum(value), 6) AS value "
    "FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL"
)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of an hour that slide by half an hour."""
    out = stream.windowed_counts(stream.event_stream(spark, sf_dir), "1 hour", "30 minutes")
    done = stream.run_to_end(out, "complete")
    return done.select("event_type", F.unix_micros("start").alias("start_us"), "n", r6("value"))


@query(
    "SELECT l_suppkey % 8 AS scan, count(*) AS n, count(*) FILTER (l_quantity >= 10 AND l_extendedprice >= 19999.99 AND l_tax >= l_discount) AS ok FROM lineitem GROUP BY 1"
)
def bounds_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose upper corner is not under the lower one in any direction."""
    li = data.table(spark, sf_dir, "lineitem")
    lo = [F.lit(10.0), F.lit(19999.99), F.col("l_discount")]
    hi = [F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax")]
    return li.groupBy((F.col("l_suppkey") % 8).alias("scan")).agg(
        F.count("*").alias("n"), F.count_if(points.valid_bounds(lo, hi)).alias("ok")
    )


@query(
    f"""WITH {data.series_sql('o_orderpriority')}, {data.runs_sql('series', 'area')},
ins AS (SELECT r.key, r.s, r.n, g.lo AS glo, g.hi AS ghi FROM series r JOIN segments g ON r.key = g.key AND r.s BETWEEN g.lo AND g.hi),
slabs AS (SELECT key, s - 0.75 AS lo, s + 0.75 AS hi FROM ins), {data.union_sql('slabs', 'slab_u')},
cut AS (SELECT u.key, sum(least(u.hi, g.hi) - greatest(u.lo, g.lo)) AS sampled FROM slab_u u JOIN segments g ON u.key = g.key AND u.lo < g.hi AND u.hi > g.lo GROUP BY 1),
c AS (SELECT key, count(*) AS stations, sum(n % 5) AS empty_ FROM ins GROUP BY 1), w AS (SELECT key, sum(hi - lo) AS whole FROM segments GROUP BY 1)
SELECT k.key, coalesce(stations, 0) AS stations, coalesce(round(sampled, 6), 0) AS sampled, coalesce(round(sampled / whole, 6), 0) AS sampled_fraction,
  coalesce(round(empty_ / (stations * 12), 6), 0) AS interpolated FROM (SELECT DISTINCT key FROM series) k LEFT JOIN c USING (key) LEFT JOIN w USING (key) LEFT JOIN cut USING (key)"""
)
def coverage_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of what is integrated the slabs saw, and how much of the walls is filled in."""
    rows = data.series(spark, sf_dir, "o_orderpriority").withColumn("empty", F.col("n") % 5)
    covered = runs.segments(rows, ["key"], "s", "area", 1.0).select("key", "lo", "hi")
    out = volume.coverage_detail(rows, covered, ["key"], "s", "empty", 1.5, 12)
    return out.select("key", "stations", r6("sampled"), r6("sampled_fraction"), r6("interpolated"))


@query(
    """WITH i AS (SELECT l_suppkey AS key, CASE WHEN l_orderkey % 997 <> 0 THEN l_partkey::DOUBLE END AS lo, l_partkey + (l_quantity % 3) AS hi FROM lineitem),
p AS (SELECT key, bool_or(lo IS NULL) AS unknown_ FROM i GROUP BY 1),
m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM i WHERE lo IS NOT NULL),
g AS (SELECT *, sum(opens) OVER (PARTITION BY key ORDER BY lo, hi) AS island FROM m)
SELECT key, true AS known, min(lo) AS lo, max(hi) AS hi FROM g JOIN p USING (key) WHERE NOT unknown_ GROUP BY key, island
UNION ALL SELECT key, false, NULL, NULL FROM p WHERE unknown_"""
)
def interval_union_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports of lines; a supplier with a line of unknown extent is unknown."""
    li = data.table(spark, sf_dir, "lineitem")
    lo = F.col("l_partkey").cast("double")
    rows = li.select(
        F.col("l_suppkey").alias("key"), F.when(F.col("l_orderkey") % 997 != 0, lo).alias("lo"), (lo + F.col("l_quantity") % 3).alias("hi")
    )
    return intervals.union_known(rows, ["key"])


@query(
    """WITH t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) - 1 AS i, count(*) OVER () AS n FROM supplier WHERE s_suppkey % 5 <> 0),
k AS (SELECT DISTINCT round_even(j * (n - 1) / 19::DOUBLE, 0)::INTEGER AS i FROM (SELECT any_value(n) AS n FROM t), range(20) r(j)),
chosen AS (SELECT s_suppkey FROM t JOIN k USING (i)),
o AS (SELECT l_orderkey, count(*) FILTER (l_suppkey IN (SELECT s_suppkey FROM chosen)) AS kept, count(*) AS seen FROM lineitem GROUP BY 1)
SELECT o_orderkey AS point_id, coalesce(kept, 0) AS kept, least(greatest(o_orderkey % 256, 1), 254) AS r, least(greatest(o_custkey % 256, 1), 254) AS g
FROM orders JOIN o ON o_orderkey = l_orderkey"""
)
def staging_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose tracks are cut to twenty evenly picked train images."""
    k = F.col("s_suppkey")
    role = F.when(k % 5 != 0, "train").otherwise("test")
    images = data.table(spark, sf_dir, "supplier").select(k.alias("image_id"), F.col("s_name").alias("name"), (k % 3).alias("camera_id"), role.alias("role"))
    seen = data.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("point_id")).agg(
        F.collect_list(F.struct(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("at"))).alias("track")
    )
    colours = data.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("point_id"), (F.col("o_orderkey") % 256).alias("r"), (F.col("o_custkey") % 256).alias("g"), F.lit(300).alias("b")
    )
    chosen, _ = staging.staged_images(images, images.select("camera_id").distinct(), 20)
    out = staging.staged_points(colours.join(seen, "point_id"), chosen)
    return out.select("point_id", F.size("track").cast("long").alias("kept"), "r", "g")


@query(
    """SELECT s_suppkey AS run, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 11 <> 5 THEN s_acctbal END AS rmse, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey::DOUBLE END AS inliers,
  concat_ws('; ', CASE WHEN s_suppkey % 4 = 0 THEN 'rmse: not recorded' WHEN s_suppkey % 11 = 5 THEN 'rmse: contradictory' END, CASE WHEN s_suppkey % 3 = 0 THEN 'inliers: no targets' END) AS absent FROM supplier"""
)
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of runs side by side, with the reason where there is none."""
    k = F.col("s_suppkey")
    rows = data.table(spark, sf_dir, "supplier")
    line = lambda name, value, reason: (k.alias("run"), F.lit(name).alias("metric"), value.cast("double").alias("value"), reason.cast("string").alias("reason"))
    none = F.lit(None)
    rmse = rows.filter(k % 4 != 0).select(*line("rmse", F.col("s_acctbal"), none))
    other = rows.filter((k % 11 == 5) & (k % 4 != 0)).select(*line("rmse", F.col("s_acctbal") + 1, none))
    inliers = rows.select(*line("inliers", F.when(k % 3 != 0, k), F.when(k % 3 == 0, "no targets")))
    return staging.report(rmse.unionByName(other).unionByName(inliers), ["run"], ["rmse", "inliers"])
