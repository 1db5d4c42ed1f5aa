"""Queries on axes, intervals, runs and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import data
from ..operators import axis, chunks, intervals, runs, sections, transforms, volume
from .registry import query, r6

HOLDOUT = [(40.0, 46.0), (90.0, 95.0)]


@query(f"WITH {data.SEGMENTS} SELECT k, round(s, 6) AS s FROM chained")
def axis_chainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return axis.chainage(data.vertices(spark, sf_dir), "k").select("k", r6("s"))


@query(
    f"""WITH {data.SEGMENTS}, places AS (SELECT i * 2.5::DOUBLE - 5 AS place FROM range(60) t(i)),
ends AS (SELECT min(s0) AS lo, max(s1) AS hi FROM segs),
clipped AS (SELECT place, least(greatest(place, lo), hi) AS c, hi FROM places, ends),
hit AS (SELECT *, (c - s0) / (s1 - s0) AS f, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS d
        FROM clipped JOIN segs ON c >= s0 AND (c < s1 OR (s1 = hi AND c = hi)))
SELECT round(place, 6) AS s, round(ax + (bx - ax) * f, 6) AS px, round(ay + (by_ - ay) * f, 6) AS py,
       round((bx - ax) / d, 6) AS tx, round((by_ - ay) / d, 6) AS ty,
       round(-(by_ - ay) / d, 6) + 0.0 AS side_x, round((bx - ax) / d, 6) + 0.0 AS side_y FROM hit"""
)
def axis_point_tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = axis.segments(data.vertices(spark, sf_dir), "k")
    at = spark.range(60).select((F.col("id") * 2.5 - 5.0).alias("s"))
    rows = axis.points_at(at, segs)
    _, side, _ = axis.section_frame(transforms.vec("t"))
    rows = rows.withColumns({"side_x": side[0], "side_y": side[1]})
    return rows.select(*[r6(c) for c in ("s", "px", "py", "tx", "ty", "side_x", "side_y")])


@query(
    f"""WITH {data.SEGMENTS}, {data.TUNNEL},
numbered AS (SELECT *, row_number() OVER () AS rid FROM tunnel),
f AS (SELECT rid, l_orderkey, l_linenumber, s0, s1, x, y, z, ax, ay, az, bx, by_, bz,
      least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay) + (z - az) * (bz - az)) /
        ((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2), 0), 1) AS t FROM numbered, segs),
d AS (SELECT *, (x - ax - (bx - ax) * t) ** 2 + (y - ay - (by_ - ay) * t) ** 2 + (z - az - (bz - az) * t) ** 2 AS d2,
      s0 + (s1 - s0) * t AS sp FROM f),
best AS (SELECT rid, min(l_orderkey) AS o, min(struct_pack(d2 := d2, sp := sp)) AS b FROM d GROUP BY rid)
SELECT o % 100 AS bucket, count(*) AS n, round(sum(b.sp), 4) AS s, round(sum(sqrt(b.d2)), 4) AS radial FROM best GROUP BY 1"""
)
def axis_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = axis.Axis.collect(data.vertices(spark, sf_dir), "k")
    points = data.tunnel(spark, sf_dir).drop("s")
    rows = axis.project(points, line)
    return rows.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("s"), F.round(F.sum("radial"), 4).alias("radial")
    )


@query(
    f"""WITH {data.SEGMENTS}, {data.TUNNEL},
ends AS (SELECT min(s0) AS first_, max(s1) AS last_, greatest(2, ceil((max(s1) - min(s0)) / 0.25)::BIGINT + 1) AS n FROM segs),
places AS (SELECT i, CASE WHEN i = n - 1 THEN last_ ELSE first_ + i * ((last_ - first_) / (n - 1)) END AS s, last_ FROM ends, range((SELECT n FROM ends)) t(i)),
verts AS (SELECT p.i, p.s, ax + (bx - ax) * (p.s - s0) / (s1 - s0) AS x, ay + (by_ - ay) * (p.s - s0) / (s1 - s0) AS y, az + (bz - az) * (p.s - s0) / (s1 - s0) AS z
  FROM places p JOIN segs ON p.s >= s0 AND (p.s < s1 OR s1 = last_ AND p.s >= last_)),
fine AS (SELECT i, s AS s0, lead(s) OVER w AS s1, x AS ax, y AS ay, z AS az, lead(x) OVER w AS bx, lead(y) OVER w AS by_, lead(z) OVER w AS bz FROM verts WINDOW w AS (ORDER BY i)),
pts AS (SELECT row_number() OVER () AS rid, l_orderkey, x, y, z FROM tunnel),
near AS (SELECT rid, arg_min(v.i, struct_pack(d := (p.x - v.x) ** 2 + (p.y - v.y) ** 2 + (p.z - v.z) ** 2, i := v.i)) AS v FROM pts p, verts v GROUP BY rid),
f AS (SELECT p.*, s0, s1, ax, ay, az, bx, by_, bz, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (by_ - ay) + (z - az) * (bz - az)) /
  ((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2), 0), 1) AS t FROM pts p JOIN near USING (rid) JOIN fine ON fine.i IN (near.v - 1, near.v) AND s1 IS NOT NULL),
d AS (SELECT rid, l_orderkey, (x - ax - (bx - ax) * t) ** 2 + (y - ay - (by_ - ay) * t) ** 2 + (z - az - (bz - az) * t) ** 2 AS d2, s0 + (s1 - s0) * t AS sp FROM f),
best AS (SELECT rid, min(l_orderkey) AS o, min(struct_pack(d2 := d2, sp := sp)) AS b FROM d GROUP BY rid)
SELECT o % 100 AS bucket, count(*) AS n, round(sum(b.sp), 4) AS s, round(sum(sqrt(b.d2)), 4) AS radial FROM best GROUP BY 1"""
)
def axis_project_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection by the nearest vertex of the axis resampled to a quarter of a metre."""
    line = axis.Axis.collect(data.vertices(spark, sf_dir), "k")
    points = data.tunnel(spark, sf_dir).drop("s")
    rows = axis.project(points, line, step=0.25, rule="vertex")
    return rows.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("s"), F.round(F.sum("radial"), 4).alias("radial")
    )


@query(
    f"""WITH {data.CLOUD}, bins AS (SELECT floor(x / 0.5)::BIGINT AS bin, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z
FROM cloud GROUP BY 1 HAVING count(*) >= 20),
w AS (SELECT bin, n, CASE WHEN count(*) OVER f = 3 THEN avg(x) OVER f ELSE x END AS x,
      CASE WHEN count(*) OVER f = 3 THEN avg(y) OVER f ELSE y END AS y, CASE WHEN count(*) OVER f = 3 THEN avg(z) OVER f ELSE z END AS z
      FROM bins WINDOW f AS (ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
SELECT bin, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM w"""
)
def axis_extract_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = axis.axis_bins(data.cloud(spark, sf_dir), F.col("x"), 0.5)
    smooth = runs.moving_average(slices, [], "bin", ["x", "y", "z"])
    return smooth.select("bin", "n", r6("x"), r6("y"), r6("z"))


@query(
    f"""WITH {data.TUNNEL}, c AS (SELECT CASE WHEN NOT (r <= 2.58 AND s > 0.1 AND s < 119.9) THEN 'unlocated'
  WHEN s BETWEEN 40 AND 46 OR s BETWEEN 90 AND 95 THEN 'holdout_point'
  WHEN (s + 1.5 >= 40 AND s - 1.5 <= 46) OR (s + 1.5 >= 90 AND s - 1.5 <= 95) THEN 'holdout_ray' ELSE 'keep' END AS reason FROM tunnel)
SELECT reason, count(*) AS n FROM c GROUP BY 1"""
)
def locate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = data.tunnel(spark, sf_dir)
    ok = axis.located_ok(F.col("s"), F.col("r"), 0.1, 119.9, most=2.58)
    reason = axis.classify(ok, F.col("s"), F.col("s") - 1, F.col("s") + 1, HOLDOUT)
    return points.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {data.TUNNEL}, bins AS (SELECT DISTINCT scan, floor(s) AS b FROM tunnel WHERE (floor(s)::BIGINT * 7 + scan) % 5 <> 0),
i AS (SELECT *, b - row_number() OVER (PARTITION BY scan ORDER BY b) AS g FROM bins)
SELECT scan, min(b)::DOUBLE AS lo, (max(b) + 1)::DOUBLE AS hi, count(*) AS bins FROM i GROUP BY scan, g"""
)
def support_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = data.tunnel(spark, sf_dir).filter((F.floor("s").cast("long") * 7 + F.col("scan")) % 5 != 0)
    return intervals.integer_islands(points, ["scan"], "s").select(
        "scan", F.col("lo").cast("double"), F.col("hi").cast("double"), "bins"
    )


_WALL = f"""WITH {data.TUNNEL},
placed AS (SELECT floor((s + 0.5) / 2)::INTEGER AS station_idx, s, y, z FROM tunnel),
slab AS (SELECT * FROM placed WHERE station_idx < 61 AND s >= station_idx * 2 - 0.5 AND s < station_idx * 2 + 0.5),
binned AS (SELECT station_idx, least(floor((CASE WHEN atan2(z, y) < 0 THEN atan2(z, y) + 2 * pi() ELSE atan2(z, y) END) / (2 * pi()) * 72)::INTEGER, 71) AS bin,
           sqrt(y ** 2 + z ** 2) AS r FROM slab),
wall AS (SELECT station_idx, bin, quantile_cont(r, 0.5) AS radius, count(*) AS n FROM binned GROUP BY ALL)"""
_GRID = """,
grid AS (SELECT a.i::INTEGER AS station_idx, b.i::INTEGER AS bin FROM range(61) a(i), range(72) b(i)),
pts AS (SELECT station_idx, sum(n)::BIGINT AS n_points FROM wall GROUP BY 1),
full_ AS (SELECT g.station_idx, g.bin, CASE WHEN coalesce(p.n_points, 0) >= 20 THEN w.radius END AS radius, coalesce(p.n_points, 0) AS n_points
  FROM grid g LEFT JOIN wall w USING (station_idx, bin) LEFT JOIN pts p USING (station_idx)),
tri AS (SELECT station_idx, bin, n_points, radius, bin + k * 72 AS p, k FROM full_, (VALUES (-1), (0), (1)) t(k)),
nb AS (SELECT *, last_value(CASE WHEN radius IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pa, last_value(radius IGNORE NULLS) OVER b AS va,
   first_value(CASE WHEN radius IS NOT NULL THEN p END IGNORE NULLS) OVER f AS pb, first_value(radius IGNORE NULLS) OVER f AS vb
   FROM tri WINDOW b AS (PARTITION BY station_idx ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   f AS (PARTITION BY station_idx ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT station_idx, bin, n_points, radius, coalesce(radius, va + (vb - va) * (p - pa) / (pb - pa)) AS r FROM nb WHERE k = 0)"""


@query(_WALL + " SELECT station_idx, bin, round(radius, 6) AS radius, n FROM wall")
def sections_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.wall(data.tunnel(spark, sf_dir), [], 0.0, 120.0, 2.0, 1.0, 72)
    return rows.select("station_idx", "bin", r6("radius"), "n")


@query(
    _WALL
    + _GRID
    + """, area AS (SELECT a.station_idx, 0.5 * sin(2 * pi() / 72) * sum(a.r * b.r) AS area FROM filled a JOIN filled b
   ON a.station_idx = b.station_idx AND b.bin = (a.bin + 1) % 72 GROUP BY 1),
s AS (SELECT station_idx, max(n_points) AS n_points, count(*) FILTER (radius IS NULL)::INTEGER AS empty_bins FROM full_ GROUP BY 1)
SELECT station_idx, station_idx * 2::DOUBLE AS chainage, n_points, empty_bins, n_points >= 20 AND empty_bins <= 7 AS valid,
       CASE WHEN n_points >= 20 AND empty_bins <= 7 THEN round(area, 6) END AS area FROM s LEFT JOIN area USING (station_idx)"""
)
def sections_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.sections(data.tunnel(spark, sf_dir), [], 0.0, 120.0, 2.0, 1.0, 72)
    return rows.select("station_idx", "chainage", "n_points", "empty_bins", "valid", r6("area"))


@query(_WALL + _GRID + " SELECT station_idx, bin, round(r, 6) AS filled FROM filled")
def wall_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections.wall(data.tunnel(spark, sf_dir), [], 0.0, 120.0, 2.0, 1.0, 72)
    enough = rows.groupBy("station_idx").agg(F.sum("n").alias("n_points")).filter("n_points >= 20")
    rows = rows.join(enough, "station_idx", "left_semi")
    grid = spark.range(61 * 72).select(
        F.floor(F.col("id") / 72).cast("int").alias("station_idx"), (F.col("id") % 72).cast("int").alias("bin")
    )
    whole = grid.join(rows, ["station_idx", "bin"], "left")
    return runs.circular_fill(whole, ["station_idx"], "bin", "radius", 72).select("station_idx", "bin", r6("filled"))


_DESIGN = (
    _WALL
    + _GRID
    + """,
st AS (SELECT station_idx, max(n_points) >= 20 AND count(*) FILTER (radius IS NULL) <= 7 AS valid FROM full_ GROUP BY 1),
ring AS (SELECT a.station_idx, 0.5 * sin(2 * pi() / 72) * sum(a.r * b.r) AS area FROM filled a JOIN filled b
   ON a.station_idx = b.station_idx AND b.bin = (a.bin + 1) % 72 GROUP BY 1),
sector AS (SELECT station_idx, 0.5 * (r ** 2 - (2.45 + 0.002 * (bin % 36)) ** 2) * 2 * pi() / 72 AS d FROM filled),
cmp AS (SELECT st.station_idx, 'tunnel' AS key, st.station_idx * 2::DOUBLE AS s, CASE WHEN valid THEN any_value(area) END AS area,
   CASE WHEN valid THEN sum(greatest(d, 0)) END AS over_, CASE WHEN valid THEN sum(greatest(-d, 0)) END AS under_
   FROM st LEFT JOIN ring USING (station_idx) LEFT JOIN sector USING (station_idx) GROUP BY st.station_idx, valid)"""
)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tunnel against a design whose radius differs from bin to bin."""
    cut = sections.sections(data.tunnel(spark, sf_dir), [], 0.0, 120.0, 2.0, 1.0, 72)
    design = 2.45 + 0.002 * (F.col("bin") % 36)
    return volume.against_design(cut, [], design, 72).withColumn("key", F.lit("tunnel"))


@query(_DESIGN + " SELECT station_idx, s AS chainage, round(area, 6) AS area, round(over_, 6) AS over, round(under_, 6) AS under FROM cmp")
def design_overbreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over- and underbreak of filled sections; invalid stations are NULL."""
    return _compared(spark, sf_dir).select("station_idx", "chainage", r6("area"), r6("over"), r6("under"))


@query(
    _DESIGN
    + """, brk AS (SELECT *, CASE WHEN over_ IS NULL OR lag(over_) OVER w IS NULL OR s - lag(s) OVER w > 2 + 1e-9 THEN 1 ELSE 0 END AS b FROM cmp WINDOW w AS (ORDER BY s)),
run AS (SELECT *, sum(b) OVER (ORDER BY s) AS run FROM brk),
trap AS (SELECT *, (over_ + lag(over_) OVER w) / 2 * (s - lag(s) OVER w) AS o, (under_ + lag(under_) OVER w) / 2 * (s - lag(s) OVER w) AS u
  FROM run WHERE over_ IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY s)),
seg AS (SELECT run, sum(o) AS o, sum(u) AS u, max(s) - min(s) AS len FROM trap GROUP BY 1 HAVING count(*) >= 2)
SELECT 'tunnel' AS key, round(sum(o), 6) AS over_m3, round(sum(u), 6) AS under_m3, coalesce(sum(len), 0) AS covered, count(*) AS segments FROM seg"""
)
def design_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volume.design_volumes(_compared(spark, sf_dir), ["key"], 2.0)
    return out.select("key", r6("over_m3"), r6("under_m3"), "covered", "segments")


@query(f"WITH {data.series_sql('o_orderpriority')}, {data.runs_sql('series', 'area')} SELECT key, lo, hi, stations, round(mean, 10) AS mean, round(integral, 7) AS integral FROM segments")
def volume_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.segments(data.series(spark, sf_dir, "o_orderpriority"), ["key"], "s", "area", 1.0)
    return rows.select("key", "lo", "hi", "stations", F.round("mean", 10).alias("mean"), F.round("integral", 7).alias("integral"))


@query(
    f"""WITH {data.series_sql('o_orderpriority')}, {data.runs_sql('series', 'area')},
t AS (SELECT key, sum(integral) AS v, sum(hi - lo) AS c, count(*) AS n FROM segments GROUP BY 1)
SELECT k.key, round(v, 7) AS volume, coalesce(c, 0) AS covered, coalesce(n, 0) AS segments, round(v / c, 6) AS mean_area
FROM (SELECT DISTINCT key FROM series) k LEFT JOIN t USING (key)"""
)
def volume_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.integrate(data.series(spark, sf_dir, "o_orderpriority"), ["key"], "s", "area", 1.0)
    return rows.select("key", F.round("volume", 7).alias("volume"), "covered", "segments", r6("mean_area"))


_RANGES = [(1100.0, 1600.0), (1500.0, 2200.0), (2600.0, 2600.5), (3000.0, 3490.0)]


@query(
    f"""WITH {data.series_sql('o_orderpriority', 'all_series')},
merged AS (SELECT * FROM (VALUES (1100::DOUBLE, 2200::DOUBLE), (2600, 2600.5), (3000, 3490)) t(mlo, mhi)),
inside AS (SELECT key, s, area, mlo, mhi FROM all_series, merged WHERE s BETWEEN mlo AND mhi),
{data.runs_sql('inside', 'area', 'key, mlo, mhi')},
c AS (SELECT key, sum(hi - lo) AS covered FROM segments GROUP BY 1),
r AS (SELECT sum(mhi - mlo) AS requested FROM merged)
SELECT k.key, requested, coalesce(covered, 0) AS covered, requested - coalesce(covered, 0) AS missing,
       round(coalesce(covered, 0) / requested, 6) AS fraction FROM (SELECT DISTINCT key FROM all_series) k LEFT JOIN c USING (key), r"""
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.series(spark, sf_dir, "o_orderpriority")
    wanted = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in _RANGES]))
    ranges = rows.select("key").distinct().select("key", wanted.alias("r")).select("key", "r.lo", "r.hi")
    out = volume.coverage(rows, ranges, ["key"], "s", "area", 1.0)
    return out.select("key", "requested", "covered", "missing", r6("fraction"))


_TWO = f"{data.series_sql('o_orderstatus', 'every')}, a AS (SELECT s, area FROM every WHERE key = 'F'), b AS (SELECT s, area FROM every WHERE key = 'O')"


@query(
    f"""WITH {_TWO}, both_ AS (SELECT 1 AS key, a.s, b.area - a.area AS delta FROM a JOIN b USING (s)),
{data.runs_sql('both_', 'delta')}
SELECT (SELECT count(*) FROM both_) AS stations, round(sum(integral), 7) AS volume, coalesce(sum(hi - lo), 0) AS covered, count(*) AS segments FROM segments"""
)
def epoch_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.series(spark, sf_dir, "o_orderstatus")
    epoch = lambda k: rows.filter(F.col("key") == k).select(F.lit(1).alias("key"), "s", "area")
    both, total = volume.change(epoch("F"), epoch("O"), ["key"], "s", "area", 1.0)
    stations = both.groupBy("key").agg(F.count("*").alias("stations"))
    return total.join(stations, "key").select("stations", F.round("volume", 7).alias("volume"), "covered", "segments")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.series(spark, sf_dir, "o_orderpriority")
    side = lambda k: rows.filter(F.col("key") == k).select(F.lit(1).alias("key"), "s", "area")
    return volume.paired(side("1-URGENT"), side("2-HIGH"), ["key"], "s", "area")


_PAIRS = f"""WITH {data.series_sql('o_orderpriority', 'every')},
p AS (SELECT s, area AS predicted FROM every WHERE key = '1-URGENT'), r AS (SELECT s, area AS referenced FROM every WHERE key = '2-HIGH'),
pairs AS (SELECT 1 AS key, coalesce(p.s, r.s) AS s, predicted, referenced, predicted - referenced AS error,
  abs(predicted - referenced) AS abs_error, CASE WHEN abs(referenced) >= 1e-9 THEN abs(predicted - referenced) / abs(referenced) END AS rel_error,
  CASE WHEN predicted IS NOT NULL AND referenced IS NOT NULL THEN 'both' WHEN predicted IS NOT NULL THEN 'prediction_only'
       WHEN referenced IS NOT NULL THEN 'reference_only' ELSE 'neither' END AS side FROM p FULL JOIN r ON p.s = r.s)"""


@query(_PAIRS + " SELECT s, round(predicted, 6) AS predicted, round(referenced, 6) AS referenced, round(error, 6) + 0.0 AS error, round(rel_error, 6) AS rel_error, side FROM pairs")
def paired_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("s", r6("predicted"), r6("referenced"), r6("error"), r6("rel_error"), "side")


@query(
    _PAIRS
    + """ SELECT count(error) AS stations, round(avg(abs_error), 6) AS mean_abs, round(quantile_cont(abs_error, 0.5), 6) AS median_abs,
 round(quantile_cont(abs_error, 0.95), 6) AS p95_abs, round(avg(error), 6) AS mean_signed, round(avg(rel_error), 6) AS mean_rel,
 count(*) FILTER (side = 'prediction_only') AS prediction_only, count(*) FILTER (side = 'reference_only') AS reference_only FROM pairs"""
)
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volume.paired_summary(_pairs(spark, sf_dir), ["key"])
    doubles = ["mean_abs", "median_abs", "p95_abs", "mean_signed", "mean_rel"]
    return out.select("stations", *[r6(c) for c in doubles], "prediction_only", "reference_only")


@query(
    _PAIRS
    + f""", common AS (SELECT key, s, CASE WHEN side = 'both' THEN predicted END AS p, CASE WHEN side = 'both' THEN referenced END AS q FROM pairs),
{data.runs_sql('common', 'p')}, other AS (SELECT sum((q + lq) / 2 * (s - ls)) AS v FROM (SELECT s, q, lag(q) OVER w AS lq, lag(s) OVER w AS ls FROM traps WINDOW w AS (PARTITION BY key, run ORDER BY s)))
SELECT round(sum(integral), 7) AS predicted_volume, coalesce(sum(hi - lo), 0) AS covered, count(*) AS segments, round(any_value(v), 7) AS referenced_volume,
 round((sum(integral) - any_value(v)) / any_value(v), 6) AS relative FROM segments, other"""
)
def paired_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volume.paired_volumes(_pairs(spark, sf_dir), ["key"], 1.0)
    return out.select(F.round("predicted_volume", 7).alias("predicted_volume"), "covered", "segments", F.round("referenced_volume", 7).alias("referenced_volume"), r6("relative"))


@query(
    """WITH m AS (SELECT user_id, epoch_us(ts) / 1e6 AS moment FROM events UNION ALL
SELECT DISTINCT user_id, e FROM events, (VALUES (1704067200::DOUBLE), (1706659200::DOUBLE)) t(e)),
g AS (SELECT user_id, moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) AS gap FROM m WHERE moment BETWEEN 1704067200 AND 1706659200)
SELECT user_id, round(max(gap), 3) AS gap FROM g GROUP BY 1"""
)
def largest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    out = runs.largest_gap(rows, ["user_id"], "at", F.lit(1704067200.0), F.lit(1706659200.0))
    return out.select("user_id", F.round("gap", 3).alias("gap"))


@query(f"WITH {data.SPANS}, {data.union_sql('spans', 'u')} SELECT key, lo, hi FROM u")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(data.spans(spark, sf_dir), ["key"])


_AB = f"WITH {data.SPANS}, sa AS (SELECT * FROM spans WHERE l_orderkey % 2 = 0), sb AS (SELECT * FROM spans WHERE l_orderkey % 2 = 1), {data.union_sql('sa', 'a')}, {data.union_sql('sb', 'b')}"


def _ab(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = data.spans(spark, sf_dir)
    return rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1")


@query(
    _AB
    + """, cuts AS (SELECT a.key, a.lo AS base_lo, a.hi AS base_hi, greatest(b.lo, a.lo) AS clo, least(b.hi, a.hi) AS chi
  FROM a JOIN b ON a.key = b.key AND b.hi > a.lo AND b.lo < a.hi
  UNION ALL SELECT key, lo, hi, lo, lo FROM a UNION ALL SELECT key, lo, hi, hi, hi FROM a),
g AS (SELECT key, max(chi) OVER w AS lo, lead(clo) OVER w2 AS hi FROM cuts
  WINDOW w AS (PARTITION BY key, base_lo, base_hi ORDER BY clo, chi ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY key, base_lo, base_hi ORDER BY clo, chi))
SELECT key, lo, hi FROM g WHERE hi - lo > 1e-9"""
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    return intervals.subtract(a, b, ["key"])


_INTERSECT = _AB + ", x AS (SELECT a.key, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM a JOIN b ON a.key = b.key AND a.lo < b.hi AND b.lo < a.hi)"


@query(_INTERSECT + " SELECT key, lo, hi FROM x")
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    return intervals.intersect(a, b, ["key"])


@query(_INTERSECT + " SELECT key, sum(hi - lo) AS length, count(*) AS pieces FROM x GROUP BY 1")
def interval_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _ab(spark, sf_dir)
    return intervals.total_length(intervals.intersect(a, b, ["key"]), ["key"])


@query(f"WITH {data.SPANS} SELECT key, lo, hi, l_orderkey FROM spans WHERE NOT ((lo >= 1000 AND hi <= 1500) OR (lo >= 1400 AND hi <= 3000))")
def spans_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(1000.0, 1500.0), (1400.0, 3000.0)], "lo double, hi double")
    return intervals.covered_by(data.spans(spark, sf_dir), ranges)


@query(
    f"""WITH {data.SPANS}, h AS (SELECT *, (hi >= 1200 AND lo <= 1300) OR (hi >= 2000 AND lo <= 2050) AS held FROM spans),
p AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY lo, l_orderkey, key, hi) AS i FROM h)
SELECT key, lo, hi, l_orderkey, CASE WHEN held THEN 'holdout' WHEN i % 4 = 0 THEN 'test' ELSE 'train' END AS role FROM p"""
)
def spans_overlap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = [(1200.0, 1300.0), (2000.0, 2050.0)]
    return chunks.split_roles(data.spans(spark, sf_dir), held, 4, ["lo", "l_orderkey", "key", "hi"], "lo", "hi")
