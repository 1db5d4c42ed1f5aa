"""Small cases with known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.contracts import ContractError, observed, require_metric_frame
from plumbline.functions import sql
from plumbline.operators import axis, chunks, frames_select, intervals, lineage, mesh, nn, points, raster, register, rules, runs, sections, transforms, volume
from plumbline.sources import binary_formats, synthetic, text_formats


def series(spark, areas):
    rows = [("a", i, None if v is None else float(v)) for i, v in enumerate(areas)]
    return spark.createDataFrame(rows, "key string, s int, area double")


def span(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def test_a_gap_is_a_boundary(spark):
    df = series(spark, [10, 10, None, 10, 10])
    assert span(runs.segments(df, ["key"], "s", "area", 1.0)) == [(0, 1), (3, 4)]
    total = runs.integrate(df, ["key"], "s", "area", 1.0).first()
    assert (total.volume, total.covered, total.segments, total.mean_area) == (20.0, 2.0, 2, 10.0)
    ranges = spark.createDataFrame([("a", 0.0, 4.0)], "key string, lo double, hi double")
    cover = volume.coverage(df, ranges, ["key"], "s", "area", 1.0).first()
    assert (cover.requested, cover.covered, cover.missing, cover.fraction) == (4.0, 2.0, 2.0, 0.5)


def test_a_station_alone_is_no_segment(spark):
    df = series(spark, [10, 10, None, 10, None, 10, 10])
    assert span(runs.segments(df, ["key"], "s", "area", 1.0)) == [(0, 1), (5, 6)]
    nothing = runs.integrate(series(spark, [None, 10, None]), ["key"], "s", "area", 1.0).first()
    assert (nothing.volume, nothing.covered, nothing.segments) == (None, 0.0, 0)


def test_nan_is_not_observed_and_duplicates_are_refused(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, float("nan")), ("a", 2, 3.0)], "key string, s int, area double")
    assert runs.segments(df, ["key"], "s", "area", 1.0).count() == 0
    assert df.select(observed(F.col("area")).alias("v")).filter("v IS NULL").count() == 1
    with pytest.raises(ContractError):
        runs.refuse_duplicates(df.unionByName(df), ["key"], "s")


def test_intervals_partition_what_is_asked(spark):
    random.seed(1)
    make = lambda n: [(k % 3, a := random.randint(0, 50), a + random.randint(0, 9)) for k in range(n)]  # noqa: E731, F841
    schema = "key int, lo double, hi double"
    fl = lambda rows: [(k, float(a), float(b)) for k, a, b in rows]
    a, b = (spark.createDataFrame(fl(make(40)), schema) for _ in range(2))
    length = lambda df: {r.key: r.length for r in intervals.total_length(df, ["key"]).collect()}
    whole, inside, rest = length(intervals.union(a, ["key"])), length(intervals.intersect(a, b, ["key"])), length(intervals.subtract(a, b, ["key"]))
    for k, n in whole.items():
        assert n == pytest.approx(inside.get(k, 0) + rest.get(k, 0))
    cells = lambda df: {(r.key, x) for r in df.collect() for x in range(int(r.lo), int(r.hi))}
    assert cells(intervals.subtract(a, b, ["key"])) == cells(a) - cells(b)
    assert cells(intervals.intersect(a, b, ["key"])) == cells(a) & cells(b)


def l_axis(spark):
    rows = [(0, 0.0, 0.0, 0.0), (1, 10.0, 0.0, 0.0), (2, 10.0, 0.0, 0.0), (3, 10.0, 10.0, 0.0)]
    return spark.createDataFrame(rows, "k int, x double, y double, z double")


def test_projection_to_a_bent_axis(spark):
    line = axis.Axis.collect(l_axis(spark), "k")
    assert line.length == 20
    pts = spark.createDataFrame([(0, 5.0, 2.0, 0.0), (1, 12.0, 10.0, 1.0)], "id int, x double, y double, z double")
    for step in (None, 0.25):  # literal segments, and Arrow batches
        got = {r.id: (r.s, r.radial) for r in axis.project(pts, line, step).collect()}
        assert got[0] == pytest.approx((5.0, 2.0)) and got[1] == pytest.approx((20.0, math.sqrt(5)))
    segs = axis.segments(l_axis(spark), "k")
    at = spark.createDataFrame([(15.0,), (5.0,), (-3.0,), (99.0,), (20.0,)], "s double")
    got = {r.s: tuple(r)[1:] for r in axis.points_at(at, segs).collect()}
    assert got[15.0] == (10.0, 5.0, 0.0, 0.0, 1.0, 0.0) and got[5.0][3:] == (1.0, 0.0, 0.0)
    assert got[-3.0][:3] == (0.0, 0.0, 0.0) and got[99.0][:3] == got[20.0][:3] == (10.0, 10.0, 0.0)


def test_stations_are_counted():
    assert axis.stations(0, 1, 0.1)[-1] == pytest.approx(1.0) and len(axis.stations(0, 1, 0.1)) == 11
    assert axis.stations(2, 2, 1) == []


def test_axis_is_found_in_a_cloud(spark):
    cloud = synthetic.tunnel_points(spark, 40.0, 200, origin=(318300.0, 4012300.0, 120.0))
    centre, direction = axis.principal_axis(cloud)
    assert abs(direction[0]) > 0.999 and centre[1] == pytest.approx(4012300.0, abs=0.1)
    line = axis.extract_axis(cloud, 4.0).orderBy("bin").collect()
    assert len(line) >= 9 and all(abs(r.y - 4012300) < 0.5 for r in line)


def test_circle_section_and_overbreak(spark):
    cloud = synthetic.tunnel_points(spark, 20.0, 3000).select("s", "y", "z")
    cut = sections.sections(cloud, [], 0.0, 20.0, 2.0, 1.0, 72)
    inner = [r for r in cut.collect() if 0 < r.station_idx < 10]
    assert all(r.valid and abs(r.area / (math.pi * 6.25) - 1) < 0.003 for r in inner)
    series_ = cut.filter("station_idx BETWEEN 1 AND 9").select(F.lit("t").alias("key"), F.col("chainage").alias("s"), "area")
    got = runs.integrate(series_, ["key"], "s", "area", 2.0).first()
    assert got.volume == pytest.approx(math.pi * 6.25 * 16, rel=0.003)
    compared = volume.against_design(cut.filter("station_idx BETWEEN 1 AND 9"), [], F.lit(2.4), 72).withColumn("key", F.lit("t"))
    five = compared.filter("station_idx = 5").first()
    assert five.over == pytest.approx(math.pi * (2.5**2 - 2.4**2), rel=0.02) and five.under == 0
    total = volume.design_volumes(compared, ["key"], 2.0).first()
    assert total.over_m3 == pytest.approx(math.pi * (2.5**2 - 2.4**2) * 16, rel=0.02) and total.under_m3 == 0
    broken = cut.withColumn("valid", F.col("valid") & (F.col("station_idx") != 4))
    holed = volume.against_design(broken, [], F.lit(2.4), 72).withColumn("key", F.lit("t"))
    assert holed.filter("station_idx = 4").first().over is None
    assert volume.design_volumes(holed.filter("station_idx BETWEEN 1 AND 9"), ["key"], 2.0).first().covered == 4 + 8


def test_station_without_points_appears(spark):
    cloud = synthetic.tunnel_points(spark, 10.0, 500).filter("s < 6").select("s", "y", "z")
    got = {r.station_idx: r for r in sections.sections(cloud, [], 0.0, 10.0, 2.0, 1.0, 36).collect()}
    assert set(got) == set(range(6)) and not got[4].valid and got[4].area is None and got[4].empty_bins == 36


def test_circular_fill_wraps(spark):
    rows = [(1, b, {0: 1.0, 6: 4.0}.get(b)) for b in range(8)]
    got = {r.bin: r.filled for r in runs.circular_fill(spark.createDataFrame(rows, "k int, bin int, v double"), ["k"], "bin", "v", 8).collect()}
    assert got[7] == pytest.approx(2.5) and got[3] == pytest.approx(2.5) and got[6] == 4.0


def test_cores_and_owners(spark):
    assert [p[3:] for p in chunks.core_plan(0, 300, 100, 20)] == [(0, 120), (80, 220), (180, 300)]
    assert len(chunks.core_plan(0, 310, 100, 20)) == 3  # a short rest joins the last core
    df = spark.createDataFrame([(99.999,), (100.0,), (200.0,), (300.0,)], "s double")
    assert [r[0] for r in df.select(chunks.owner(F.col("s"), [100.0, 200.0])).collect()] == [0, 1, 2, 2]
    assert chunks.window_plan(0, 100, 40, 10)[-1] == (2, 60, 100)
    assert chunks.plan_issues(chunks.plan_table(spark, chunks.core_plan(0, 300, 100, 20))).count() == 0
    with pytest.raises(ContractError):
        chunks.window_plan(0, 10, 5, 5)


def test_voxels_floor_below_zero(spark):
    rows = [(0, -0.5, 0.0, 0.0), (1, 0.4, 0.0, 0.0), (2, 0.3, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "pid int, x double, y double, z double")
    assert sorted(r.pid for r in points.voxel_first(df, 1.0, ["pid"]).collect()) == [0, 1]
    assert points.voxel_first(df, 0.0, ["pid"]).count() == 3


def test_colour_and_origin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,)], "v double")
    assert [r[0] for r in df.select(points.rescale_colour(F.col("v"), 0.0, 1.0)).collect()] == [0, 128, 255, 255]
    assert [r[0] for r in df.select(points.rescale_colour(F.col("v"), 1.0, 1.0)).collect()] == [0, 0, 1, 2]


def test_leak_is_an_error(spark):
    df = spark.createDataFrame([(1, 5.0)], "pid int, s double")
    assert points.refuse_in_holdout(df, F.col("s") > 9).count() == 1
    with pytest.raises(Exception, match="holdout"):
        points.refuse_in_holdout(df, F.col("s") > 1).collect()
    with pytest.raises(ContractError):
        require_metric_frame(df.withColumn("frame", F.lit("SOURCE")))


def cloud_rows(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, *map(float, p)) for i, p in enumerate(rng.uniform(-3, 3, size=(n, 3)))]


def test_nearest_is_brute_force(spark):
    schema = "id int, x double, y double, z double"
    a, b = cloud_rows(60, 1), cloud_rows(80, 2)
    da, db = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    d = np.linalg.norm(np.array([r[1:] for r in a])[:, None] - np.array([r[1:] for r in b])[None], axis=2)
    got = {r.id: r.distance for r in nn.nearest(da, db, 0.7).collect()}
    for i, row in enumerate(d):
        assert got[i] == (pytest.approx(row.min()) if row.min() < 0.7 else None)
    far = {r.id: r.distance for r in nn.nearest_unbounded(da, db, 0.1).collect()}
    assert far == pytest.approx({i: row.min() for i, row in enumerate(d)})
    same = nn.compare_clouds(da, da, 0.5, 0.1).first()
    assert (same.chamfer, same.f_score) == (0.0, 1.0)


def test_registration_recovers_a_transform(spark):
    want = transforms.Similarity(transforms.axis_rotation("y", 20) @ transforms.axis_rotation("x", -35), (318300.0, -4.0, 7.0), 0.5)
    schema = "id int, x double, y double, z double"
    source = spark.createDataFrame(cloud_rows(30, 3), schema)
    target = source.select("id", *[c.alias(n) for c, n in zip(want.apply(transforms.vec()), "xyz", strict=True)])
    got = register.fit_similarity(register.match_by_id(source, target))
    assert got.scale == pytest.approx(0.5) and np.allclose(got.r, want.r) and np.allclose(got.t, want.t)
    back = got.inverse() @ got
    assert np.allclose(back.r, np.eye(3)) and np.allclose(back.t, 0, atol=1e-6)
    wrong = target.withColumn("x", F.when(F.col("id") < 6, F.col("x") + 50).otherwise(F.col("x")))
    robust, inliers, fell_back = register.ransac(register.match_by_id(source, wrong))
    assert np.allclose(robust.r, want.r, atol=1e-6) and inliers == list(range(6, 30)) and not fell_back
    with pytest.raises(ContractError):
        register.match_by_id(source.limit(2), target)


def test_icp_aligns(spark):
    schema = "id int, x double, y double, z double"
    source = spark.createDataFrame(cloud_rows(150, 4), schema)
    shift = transforms.Similarity(None, (0.05, -0.04, 0.03))
    target = source.select("id", *[c.alias(n) for c, n in zip(shift.apply(transforms.vec()), "xyz", strict=True)])
    got, history = register.icp(source, target, 0.5, rounds=8)
    assert np.allclose(got.t, shift.t, atol=1e-6) and history[-1][2] < history[0][2]


def test_frames_compare_with_the_last_kept(spark):
    rows = [("a", i, b, h) for i, (b, h) in enumerate([(90, 0b0000), (90, 0b0011), (10, 0b1111), (90, 0b0111), (90, 0b1111)])]
    df = spark.createDataFrame(rows, "source string, seq int, blur int, hash long")
    got = [r.reason for r in frames_select.select_frames(df, ["source"], ["seq"], "blur", "hash", 60, 2).orderBy("seq").collect()]
    assert got == ["keep", "duplicate", "blurred", "keep", "duplicate"]
    capped = frames_select.select_frames(df, ["source"], ["seq"], "blur", "hash", 60, 0, most=1).orderBy("seq").collect()
    assert [r.reason for r in capped] == ["keep", "max_frames", "blurred", "max_frames", "max_frames"]


def test_unit_cube_and_sampling(spark):
    v = [(i + 4 * j + 2 * k, float(i), float(k), float(j)) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    faces = [(2 * n + h, q[0], q[1 + h], q[2 + h]) for n, q in enumerate(quads) for h in (0, 1)]
    tri = mesh.corners(spark.createDataFrame(faces, "face long, a long, b long, c long"), spark.createDataFrame(v, "vertex long, x double, y double, z double"))
    assert mesh.volume(tri).first().volume == pytest.approx(1.0)
    sampled = mesh.sample_surface(tri, 1200).collect()
    assert len(sampled) == 1200
    assert all(min(abs(c), abs(c - 1)) < 1e-9 for r in sampled for c in [min((r.x, r.y, r.z), key=lambda t: min(abs(t), abs(t - 1)))])


def test_images(spark):
    same = spark.createDataFrame([(1, [0.1 * (i % 7) for i in range(64)])], "id int, a array<double>").withColumn("b", F.col("a"))
    assert raster.ssim(same, 8).first().ssim == pytest.approx(1.0)
    px = spark.createDataFrame([(1, 0.5, 0.5)], "id int, a double, b double")
    assert raster.psnr(px, ["id"], "a", "b").first().psnr == float("inf")
    grid = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "image int, row int, col int, value double")
    at = spark.createDataFrame([(1, 0.5, 1.0), (1, 1.25, 0.5), (1, 2.5, 0.0)], "image int, u double, v double")
    got = {(r.u, r.v): r.value for r in raster.bilinear(grid, at, ["image"]).collect()}
    assert got == {(0.5, 1.0): 10.5, (1.25, 0.5): 6.25, (2.5, 0.0): None}


def test_quaternions_and_rotations(spark):
    assert len(transforms.signed_permutations()) == 24
    m = transforms.axis_rotation("z", 90)
    assert np.allclose(m @ [1, 0, 0], [0, 1, 0])
    scaled = transforms.Similarity.from_matrix(np.block([[2 * m, np.array([[1], [2], [3]])], [np.zeros((1, 3)), np.ones((1, 1))]]))
    assert scaled.scale == pytest.approx(2)
    with pytest.raises(ValueError):
        transforms.Similarity(np.diag([1, 1, -1]))


def test_rules_refuse_the_unknown(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 9.0)], "id int, rmse double")
    got = {r.id: (r.allowed, list(r.refusals)) for r in rules.gate(df, {"rmse": ("max", 1.0)}).collect()}
    assert got == {1: (True, []), 2: (False, ["rmse over 1"]), 3: (False, ["rmse over 1"])}


def test_migrations_and_versions(spark):
    steps = lineage.Migrations("2")
    steps.step("1", "2")(lambda df: df.withColumn("b", F.lit(1)))
    assert "b" in steps.migrate(spark.range(1), "1").columns
    with pytest.raises(ValueError):
        steps.migrate(spark.range(1), "3")
    df = spark.createDataFrame([("1.10.0", "1.9.2")], "a string, b string")
    assert df.filter(lineage.version_tuple(F.col("a")) > lineage.version_tuple(F.col("b"))).count() == 1


def test_ply_round_trip(spark, tmp_path):
    cloud = spark.createDataFrame([(1.5, -2.25, 3.0, 10, 200, 255), (0.0, 0.5, 9.0, 1, 2, 3)], "x double, y double, z double, r short, g short, b short")
    data = binary_formats.ply_bytes(cloud.coalesce(1), "LOCAL_METRIC").first().content
    (tmp_path / "a.ply").write_bytes(bytes(data))
    got = sorted((r.x, r.y, r.z, r.r, r.g, r.b, r.frame) for r in binary_formats.read_ply(spark, str(tmp_path / "a.ply")).collect())
    assert got == [(0.0, 0.5, 9.0, 1, 2, 3, "LOCAL_METRIC"), (1.5, -2.25, 3.0, 10, 200, 255, "LOCAL_METRIC")]
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar alpha\nproperty float opacity\nend_header\n1 2 3 9 0.5\n4 5 6 9 0.25\n")
    rows = binary_formats.read_ply(spark, str(tmp_path / "b.ply")).orderBy("pid").collect()
    assert [(r.x, r.attrs, r.frame, r.r) for r in rows] == [(1.0, {"opacity": 0.5}, "UNKNOWN", None), (4.0, {"opacity": 0.25}, "UNKNOWN", None)]
    with pytest.raises(Exception, match="float"):
        binary_formats.ply_bytes(cloud.withColumn("x", F.lit(6000.0))).collect()


def test_text_sources(spark, tmp_path):
    (tmp_path / "axis.csv").write_text("# note\ns,x,y,z\n5,0,0,0\n6,1,0,0\n")
    assert [tuple(r) for r in text_formats.read_axis_csv(spark, str(tmp_path / "axis.csv")).orderBy("vertex").collect()] == [(0, 0.0, 0.0, 0.0, 5.0), (1, 1.0, 0.0, 0.0, 6.0)]
    (tmp_path / "plain.csv").write_text("0,0,0\n1,2,3\n")
    assert text_formats.read_axis_csv(spark, str(tmp_path / "plain.csv")).filter("s IS NULL").count() == 2
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 -1\n")
    vertices, faces = text_formats.read_obj(spark, str(tmp_path / "m.obj"))
    assert vertices.count() == 4 and sorted((r.a, r.b, r.c) for r in faces.collect()) == [(1, 2, 3), (1, 3, 4)]
    (tmp_path / "images.txt").write_text("# c\n1 1 0 0 0 0.5 0 0 7 a b.jpg\n10 20 5 11 21 -1\n2 1 0 0 0 1 2 3 7 c.jpg\n\n")
    images = text_formats.read_colmap_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(i.name, len(i.points), i.tx) for i in images] == [("a b.jpg", 2, 0.5), ("c.jpg", 0, 1.0)]
    (tmp_path / "points3D.txt").write_text("5 1 2 3 10 20 30 0.5 1 0 2 4\n6 1 2 3 10 20 30 0.5\n")
    pts = text_formats.read_colmap_points(spark, str(tmp_path / "points3D.txt")).orderBy("point_id").collect()
    assert [(t.image_id, t.point2d_idx) for t in pts[0].track] == [(1, 0), (2, 4)] and pts[1].track == []
    (tmp_path / "map.csv").write_text("image_name,image_id,scan_id,station_id,note\na.jpg,,S1,,x\n,7,,T2,\n")
    mapped = text_formats.read_mapping(spark, str(tmp_path / "map.csv")).collect()
    assert [tuple(r) for r in mapped] == [
        ("map.csv:line 2", "a.jpg", "image_name", "scan_id", "S1", "explicit_mapping"),
        ("map.csv:line 3", "7", "image_id", "station_id", "T2", "explicit_mapping"),
    ]
    for text in ("image_name,scan_id\na.jpg,\n", "image_name,image_id,scan_id\na.jpg,1,S\n", "file,scan_id\na,S\n", "image_id,scan_id\n"):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ContractError):
            text_formats.read_mapping(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "targets.csv").write_text("id,x,y,z\n")
    with pytest.raises(ContractError):
        text_formats.read_targets_csv(spark, str(tmp_path / "targets.csv"))


def test_depth_maps_and_splats(spark, tmp_path):
    np.save(tmp_path / "im1.npy", np.array([[1.0, np.nan], [2.0, 3.0]]))
    rows = binary_formats.read_depth_maps(spark, str(tmp_path / "im1.npy")).collect()
    assert sorted((r.image, r.row, r.col, r.depth) for r in rows) == [("im1", 0, 0, 1.0), ("im1", 1, 0, 2.0), ("im1", 1, 1, 3.0)]
    names = ["x", "y", "z", "opacity", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)], *[f"f_dc_{i}" for i in range(3)]]
    g = spark.createDataFrame([(float(i), 0.0, 0.0, float(i), *[0.0] * 3, 1.0, 0.0, 0.0, 0.0, *[0.0] * 3) for i in range(3)], names).coalesce(1)
    data = b"".join(bytes(r.content) for r in binary_formats.splat_bytes(g).orderBy("part").collect())
    assert len(data) == 96 and [np.frombuffer(data[k * 32 : k * 32 + 4], "<f4")[0] for k in range(3)] == [2.0, 1.0, 0.0]


def test_sql_surface(spark):
    sql.register(spark)
    assert spark.sql("SELECT hamming(5, 6) AS h, owner_index(100D, array(100D, 200D)) AS o").first() == (2, 1)
    assert [r.s for r in spark.sql("SELECT * FROM stations(0D, 1D, 0.5D)").collect()] == [0.0, 0.5, 1.0]
    assert sql.parse_ranges("0:20, 60:80") == [(0.0, 20.0), (60.0, 80.0)]


def test_strict_documents(spark):
    ok = spark.createDataFrame([('{"schema_version":"1","a":2}',)], "j string")
    schema = "schema_version string, a int"
    assert text_formats.strict_json(ok, "j", schema, ["1"]).select("doc.a").first().a == 2
    for bad in ('{"schema_version":"2","a":2}', '{"schema_version":"1","a":2,"b":1}', "no json"):
        with pytest.raises(ContractError):
            text_formats.strict_json(spark.createDataFrame([(bad,)], "j string"), "j", schema, ["1"])


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
