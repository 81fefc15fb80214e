"""Small operators that no query holds against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.operators import edits, images, kernels, tables
from trackloom.sources import files
from trackloom.streaming import autotrack


def test_typed_numbers_are_clamped(spark):
    df = spark.createDataFrame([("7.6",), ("-3",), ("99",), ("abc",), ("",), (None,), ("NaN",)], "t string")
    got = [r.x for r in df.select(G.clamp_input(F.col("t"), F.lit(1.0), F.lit(10.0), F.lit(5.0)).alias("x")).collect()]
    assert got == [8.0, 1.0, 10.0, 5.0, 5.0, 5.0, 5.0]


def test_wing_vertices(spark):
    row = spark.createDataFrame([(0.3, -0.2, 0.7, 0.4, 0.1, -0.5)], "a double, b double, c double, roll double, pitch double, yaw double")
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    vertex, axes, root, center = (1.0, 2.0, -0.5), [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)], (0.2, 0.1, 0.0), (10.0, -4.0, 3.0)
    body = G.euler_matrix(F.col("roll"), F.col("pitch"), F.col("yaw"))
    got = row.select(*[c.alias(n) for c, n in zip(G.wing_vertex(lit(*vertex), [lit(*a) for a in axes], [F.col("a"), F.col("b"), F.col("c")], lit(*root), body, lit(*center)), "xyz")]).first()
    p = np.array(vertex)
    for axis, angle in zip(np.array(axes), (0.3, -0.2, 0.7)):
        along = axis * (axis @ p)
        p = along + (p - along) * math.cos(angle) + np.cross(p, axis) * math.sin(angle)
    cr, sr, cp, sp, cy, sy = (f(x) for x in (0.4, 0.1, -0.5) for f in (math.cos, math.sin))
    turn = np.array([[1, 0, 0], [0, cr, sr], [0, -sr, cr]]) @ np.array([[cp, 0, -sp], [0, 1, 0], [sp, 0, cp]]) @ np.array([[cy, sy, 0], [-sy, cy, 0], [0, 0, 1]])
    np.testing.assert_allclose([got.x, got.y, got.z], turn.T @ (p + root) + center, atol=1e-9)


def test_distorted_lines_are_tidied(spark):
    samples = spark.createDataFrame([(1, 3, 5.0, 0.0), (1, 1, 1.0, 0.0), (1, 2, 400.0, 0.0), (1, 4, 1e12, 0.0), (2, 1, 0.0, 60.0)], "line_id int, sample_id int, x double, y double")
    controls = spark.createDataFrame([(1, 0.0, 0.0), (1, 30.0, 0.0), (2, 0.0, 0.0)], "line_id int, cx double, cy double")
    assert [tuple(r) for r in tables.tidy_polyline(samples, controls).orderBy("line_id", "place").collect()] == [(1, 1, 1.0, 0.0), (1, 2, 5.0, 0.0)]


def test_crops_with_a_point_just_outside_are_rejected(spark):
    rows = [("m", 1, 100.0, 100.0), ("m", 2, -4.9, 50.0), ("m", 3, -5.0, 50.0), ("m", 4, 50.0, 228.0), ("m", 5, 229.0, 50.0), ("m", 6, None, 50.0), ("m", 6, 10.0, 10.0)]
    got = {r.frame: r.rejected for r in images.rejected_crops(spark.createDataFrame(rows, "movie string, frame int, u double, v double")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_heat_maps_peak_at_their_points(spark):
    points = spark.createDataFrame([(1, 1, 20.0, 30.0), (1, 2, None, 3.0), (2, 1, 1.0, 1.0)], "frame int, point int, u double, v double")
    got = {(r.frame, r.point): np.reshape(r.heat, (64, 64)) for r in kernels.heat_maps(points, side=64).collect()}
    assert np.unravel_index(got[1, 1].argmax(), (64, 64)) == (30, 20) and got[1, 1].max() == 1 and got[1, 2].max() == 0 and got[2, 1][1, 1] == 1


def test_lens_files_prefixes_and_objects(spark, tmp_path):
    (tmp_path / "a_profile.txt").write_text("1 1500 640 480 320 240 0 0.1 0.2 0.3 0.4 0.5\n2 1400 640 480 321 241 0 0 0 0 0 0\n")
    got = files.read_lenses(spark, f"{tmp_path}/a_profile.txt").orderBy("cam").collect()
    assert [tuple(r) for r in got] == [(1, 1500.0, 1500.0, 320.0, 240.0, 0.1, 0.2, 0.3, 0.4, 0.5), (2, 1400.0, 1400.0, 321.0, 241.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    (tmp_path / "b_profile.txt").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        files.read_lenses(spark, f"{tmp_path}/b_profile.txt")
    paths = spark.createDataFrame([("x/t01_xypts.csv",), ("x/t01_xyzpts.csv",), ("y_xypts.tsv",), ("z.csv",)], "path string")
    assert sorted(r.prefix for r in files.prefixes(paths).collect()) == ["x/t01_", "y_"]
    (tmp_path / "o.csv").write_text("x,y,z\n1,2,3\n4,5,6\n")
    assert [tuple(r) for r in files.read_object(spark, f"{tmp_path}/o.csv").collect()] == [(1, 1.0, 2.0, 3.0), (2, 4.0, 5.0, 6.0)]
    (tmp_path / "p.csv").write_text("x,y\n1,2\n")
    assert files.read_object(spark, f"{tmp_path}/p.csv").first().z is None


def test_stores_are_drawn_in_proportion(spark):
    stores = spark.createDataFrame([("a", 900), ("b", 100), ("none", 0)], "store string, n_frames int")
    got = {r.store: r["count"] for r in kernels.pick_stores(spark.range(4000), stores, 3).groupBy("store").count().collect()}
    assert sum(got.values()) == 4000 and 3450 < got["a"] < 3750 and "none" not in got


def test_points_are_added_behind_the_last(spark):
    names = spark.createDataFrame([(1, "nose"), (4, "tail")], "point int, name string")
    assert {r.point: r.name for r in edits.add_point(names, "wing").collect()} == {1: "nose", 4: "tail", 5: "wing"}
    assert edits.add_point(names.where("false"), "first").first().point == 1


def test_triangulation_needs_two_cameras_that_differ():
    c = [float(i in (0, 6)) for i in range(11)]
    assert autotrack.located({1: (1.0, 2.0)}, {1: c}, {}) is None
    assert autotrack.located({1: (1.0, 2.0), 2: (1.0, 2.0)}, {1: c, 2: c}, {}) is None
