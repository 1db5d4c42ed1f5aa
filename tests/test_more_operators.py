"""Small cases for the operators that no registered query uses."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from plumbline.contracts import ContractError, float32_safe
from plumbline.operators import axis, lineage, points, raster
from plumbline.sources import binary_formats, text_formats
from plumbline.streaming import coverage


def test_lines_near_the_holdout(spark):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 100.0, 0.0, 0.0)], "k int, x double, y double, z double")
    line = axis.Axis.collect(vertices, "k")
    rows = [(1, 10.0, 0.0, 0.0, 20.0, 0.0, 0.0), (2, 38.0, 0.0, 0.0, 39.6, 0.0, 0.0), (3, 10.0, 0.0, 0.0, 10.0, 30.0, 0.0), (4, 60.0, 1.0, 0.0, 70.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.id: r.touches for r in axis.segment_touches(df, "id", line, [(40.0, 46.0)]).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}  # the third leaves the axis' surroundings


def test_tracks_are_whole_and_near(spark):
    cameras = spark.createDataFrame([(1, 100.0, 100.0, 50.0, 50.0)], "camera_id int, fx double, fy double, cx double, cy double")
    images = spark.createDataFrame([(i, 1, "train" if i < 4 else "test", 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(5)], "image_id int, camera_id int, role string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    obs = lambda ids, u=50.0: [(i, u, 50.0) for i in ids]
    rows = [(1, 0.0, 0.0, 2.0, obs([0, 1, 2])), (2, 0.0, 0.0, 2.0, obs([0, 1, 4])), (3, 0.0, 0.0, 2.0, obs([0, 1])), (4, 0.0, 0.0, 2.0, obs([0, 1, 2], 60.0))]
    df = spark.createDataFrame(rows, "point_id int, x double, y double, z double, track array<struct<image_id:int,u:double,v:double>>")
    got = raster.tracks(df, images, cameras).collect()
    assert {r.point_id for r in got} == {1} and len(got) == 3 and all(r.depth == 2.0 for r in got)


def test_clouds_unite_on_common_columns(spark):
    a = spark.createDataFrame([(0.0, 0.0, 0.0, 1, "A")], "x double, y double, z double, r int, frame string")
    b = spark.createDataFrame([(1.0, 0.0, 0.0, "B", 5)], "x double, y double, z double, frame string, g int")
    both = points.concat(a, b)
    assert both.columns == ["x", "y", "z", "frame"] and {r.frame for r in both.collect()} == {"A"}
    with pytest.raises(ValueError):
        points.concat(a, b.drop("z"))
    checked = a.select(float32_safe(F.lit(5000.0)).alias("ok"), float32_safe(F.lit(-5001.0)).alias("no")).first()
    assert (checked.ok, checked.no) == (True, False)
    lo, hi = [F.lit(0.0)] * 3, [F.lit(1.0), F.lit(float("nan")), F.lit(1.0)]
    assert a.select(points.valid_bounds(lo, lo).alias("v"), points.valid_bounds(lo, hi).alias("w")).first() == (True, False)


def test_colours_masks_and_covariances(spark):
    one = spark.range(1)
    ramp = [tuple(one.select(*raster.turbo_like(F.lit(t))).first()) for t in (0.0, 0.25, 0.5, 0.7, 1.0)]
    assert ramp == [(0, 0, 127), (0, 127, 255), (127, 255, 127), (255, 178, 0), (127, 0, 0)]
    assert one.select(raster.box_mask(F.lit(5.0), F.lit(5.0), [(0, 0, 10, 10)]).alias("m")).first().m is False
    cov = one.select(*[c.alias(f"c{i}") for i, c in enumerate(raster.covariance(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 0.0, 0.5, 1.0)]))]).first()
    assert list(cov) == pytest.approx([1.0, 0, 0, 2.718281828, 0, 7.389056099])
    pairs = spark.createDataFrame([("a", 10, 20, 30, 13, 20, 30), ("a", 0, 0, 0, 0, 0, 3)], "k string, pr int, pg int, pb int, r int, g int, b int")
    assert raster.rgb_residual(pairs, ["k"]).first().residual == pytest.approx(1.0)


def test_files_of_the_tool_chain(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n7 PINHOLE 640 480 500 501 320 240\n")
    cam = text_formats.read_colmap_cameras(spark, str(tmp_path / "cameras.txt")).first()
    assert (cam.camera_id, cam.model, cam.params) == (7, "PINHOLE", [500.0, 501.0, 320.0, 240.0])
    data = struct.pack("<Q", 1) + struct.pack("<QdddBBBdQ", 9, 1.0, 2.0, 3.0, 4, 5, 6, 0.5, 2) + struct.pack("<4i", 1, 0, 2, 7)
    (tmp_path / "points3D.bin").write_bytes(data)
    got = binary_formats.read_colmap_points_bin(spark, str(tmp_path / "points3D.bin"))
    row = got.first()
    assert (row.point_id, row.z, row.g, [(t.image_id, t.point2d_idx) for t in row.track]) == (9, 3.0, 5, [(1, 0), (2, 7)])
    text_formats.write_colmap_points(got, str(tmp_path / "out"))
    again = text_formats.read_colmap_points(spark, str(tmp_path / "out")).first()
    assert tuple(again) == tuple(row)
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0)], "vertex long, x double, y double, z double")
    f = spark.createDataFrame([(0, 1, 2, 3)], "face long, a long, b long, c long")
    text_formats.write_obj(v, f, str(tmp_path / "obj"))
    v2, f2 = text_formats.read_obj(spark, str(tmp_path / "obj"))
    assert v2.count() == 3 and tuple(f2.first()) == (0, 1, 2, 3)
    text_formats.write_axis_csv(v.withColumn("s", F.col("vertex").cast("double")), str(tmp_path / "axis"))
    assert [r.s for r in text_formats.read_axis_csv(spark, str(tmp_path / "axis")).orderBy("vertex").collect()] == [1.0, 2.0, 3.0]
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "b.jpg").write_bytes(b"nothing")
    codecs = {r.path[-5:]: r.codec for r in binary_formats.read_images(spark, str(tmp_path / "*.jpg")).collect()}
    assert codecs == {"a.jpg": "jpeg", "b.jpg": None}


def test_first_of_a_voxel_in_a_stream(spark, sf_dir):
    events = coverage.event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    pts = events.select("ts", *[(F.col("value") / 10).alias(c) for c in "xyz"])
    done = coverage.run_to_end(coverage.first_of_voxel(pts, 1.0), "append")
    want = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("value") / 10)).distinct().count()
    assert done.count() == want


def test_latest_state_and_rollup(spark):
    rows = [("a", "run", 1, 0), ("a", "done", 2, 1), ("b", "run", 5, 2)]
    df = spark.createDataFrame(rows, "k string, state string, at int, id int")
    assert {r.k: r.state for r in lineage.latest_state(df, ["k"], "state", "at", "id").collect()} == {"a": "done", "b": "run"}
    none = lineage.rollup(df.withColumn("sec", F.lit(None).cast("double")), ["k"], "sec").collect()
    assert all(r.seconds is None and r.measured == 0 for r in none)


def test_cameras_are_normalised(spark):
    import numpy as np

    from plumbline.operators import cameras, transforms

    rng = np.random.default_rng(8)
    rows, looks = [], []
    for i in range(31):  # cameras about (5, 2, -3) that look at it, all upright but for a little noise
        turn = transforms.axis_rotation("y", float(rng.uniform(0, 360))) @ transforms.axis_rotation("x", float(rng.normal() * 4))
        r = transforms.axis_rotation("z", 20.0) @ turn
        t = np.array([5.0, 2.0, -3.0]) - 7 * r[:, 2] + rng.normal(size=3) * 0.05
        looks.append((r, t))
        rows.append((*r.ravel().tolist(), *t.tolist()))
    names = [f"r{i}{j} double" for i in range(3) for j in range(3)] + ["tx double", "ty double", "tz double"]
    df = spark.createDataFrame(rows, ", ".join(names))
    for centre, strict in (("focus", False), ("poses", True)):
        found = cameras.normalising(df, strict, centre)
        ups = np.mean([-found.r @ r[:, 1] for r, _ in looks], axis=0)
        assert ups / np.linalg.norm(ups) == pytest.approx([0, -1, 0], abs=1e-9)
        places = np.array([found.scale * found.r @ t + found.t for _, t in looks])
        distance = np.linalg.norm(places, axis=1)
        assert (distance.max() if strict else np.median(distance)) == pytest.approx(1)
        if centre == "focus":
            near = [t - (r[:, 2] @ t) * r[:, 2] for r, t in looks]  # to the origin of the world
            middle = np.median(np.array(near) @ found.r.T, axis=0)
            assert found.scale * middle + found.t == pytest.approx([0, 0, 0], abs=1e-9)
        else:
            assert np.median(places, axis=0) == pytest.approx([0, 0, 0], abs=1e-9)
    assert cameras._upright(np.array([0.0, 1.0, 0.0])) @ [0, 1, 0] == pytest.approx([0, -1, 0])
    with pytest.raises(ContractError):
        cameras.normalising(df.limit(0))


def test_principal_frame_is_about_the_median(spark):
    import numpy as np

    from plumbline.operators import cameras

    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3)) * [9.0, 3.0, 1.0] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + [100, 200, 300]
    found = cameras.principal_frame(spark.createDataFrame(x.tolist(), "x double, y double, z double"))
    y = x @ found.r.T + found.t
    cov = np.cov(y, rowvar=False)
    assert np.abs(cov - np.diag(np.diag(cov))).max() < 1e-8 and (np.diff(np.diag(cov)) < 0).all()
    assert found.r @ np.median(x, axis=0) + found.t == pytest.approx([0, 0, 0], abs=1e-9)
    assert np.linalg.det(found.r) == pytest.approx(1)


def test_projection_rules_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(6)
    line = axis.Axis(np.arange(40.0), np.c_[np.arange(40.0), np.zeros(40), np.zeros(40)])
    q = np.c_[rng.uniform(-3, 45, 300), rng.normal(size=(300, 2))]
    df = spark.createDataFrame(q.tolist(), "x double, y double, z double")
    want = {tuple(p): (min(max(p[0], 0), 39), float(np.linalg.norm(p - [min(max(p[0], 0), 39), 0, 0]))) for p in q}
    for rule in ("segments", "vertex"):
        for pairs in (1 << 20, 100):
            monkeypatch.setattr(axis, "PAIRS", pairs)
            got = axis.project(df, line, rule=rule).collect()
            assert len(got) == 300
            for r in got:
                assert (r.s, r.radial) == pytest.approx(want[(r.x, r.y, r.z)])
    with pytest.raises(ContractError):
        axis.project(df, line, rule="nearest")


def test_frames_are_walked_in_linear_time(spark):
    from plumbline.operators import frames_select

    rows = [(1, i, 50.0, i % 7 * 1_000_003) for i in range(30_000)] + [(2, 0, 1.0, 5), (None, 3, 90.0, -1), (None, 4, 90.0, -2)]
    df = spark.createDataFrame(rows, "source long, seq long, blur double, hash long")
    got = {(r.source, r.seq): (r.keep, r.reason) for r in frames_select.select_frames(df, ["source"], ["seq"], "blur", "hash", 10.0, 0, most=100).collect()}
    assert len(got) == len(rows) and got[(2, 0)] == (False, "blurred")
    assert sum(k for (s, _), (k, _) in got.items() if s == 1) == 100 and got[(1, 101)][1] == "max_frames"


def test_stream_results_stay_off_the_driver(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).write.parquet(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema("id long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
    rows = rows.parquet(f"{tmp_path}/in")
    done = coverage.run_to_end(rows, "append")
    assert sorted(r.id for r in done.collect()) == list(range(30)) and done.inputFiles()
    counts = coverage.run_to_end(rows.groupBy((F.col("id") % 2).alias("k")).count(), "complete")
    assert sorted(map(tuple, counts.collect())) == [(0, 15), (1, 15)] and counts.inputFiles()
    (tmp_path / "empty").mkdir()
    nothing = spark.readStream.schema("id long").parquet(f"{tmp_path}/empty")
    assert coverage.run_to_end(nothing, "append").count() == 0
