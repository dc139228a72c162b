"""Kernels, codecs and streams on small fixtures."""

import json
import math
import struct
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.operators import joins, kernels, points
from voxloom.sources import codecs
from voxloom.streaming import logs

SF = "/root/testdata/sf0.001"


def square(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], dtype=float)


@settings(max_examples=60, deadline=None)
@given(*(st.floats(0.1, 5) for _ in range(4)), st.floats(-4, 4), st.floats(-4, 4), st.floats(0, 6.28))
def test_overlap_of_turned_boxes(w, h, a, b, x, y, angle):
    p, q = square(0, 0, w, h), square(x, y, a, b)
    want = max(0, min(w, x + a) - max(0, x)) * max(0, min(h, y + b) - max(0, y))
    c, s = math.cos(angle), math.sin(angle)
    turn = np.array([[c, s], [-s, c]])
    assert abs(kernels.overlap_area(p @ turn, q @ turn) - want) < 1e-6


def test_overlap_not_convex():
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], dtype=float)
    assert abs(kernels.overlap_area(ell, square(0, 0, 2, 2)) - 3) < 1e-9
    assert kernels.overlap_area(ell, square(2, 2, 1, 1)) == 0
    assert abs(kernels.areas(kernels.clip_convex(square(-2, -2, 9, 9), (0, 0, 3, 2))[None])[0] - 6) < 1e-9


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(20):
        c = rng.random((4, 6))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))
        assert abs(sum(c[i, j] for i, j in enumerate(kernels.assign_optimally(c))) - best) < 1e-12


def test_sphere_rotations_and_search():
    assert [len(kernels.icosphere(k)) for k in range(4)] == [12, 42, 162, 642]
    r = kernels.rotation_candidates(np.eye(3), np.eye(3))
    assert len(r) == 24 and np.allclose(np.linalg.det(r), 1) and len({tuple(np.round(m, 6).ravel()) for m in r}) == 24
    x, f = kernels.differential_evolution(lambda v: float(((v - 1.5) ** 2).sum()), np.array([[0.0, 3.0]] * 3), rounds=120)
    assert f < 1e-4 and np.allclose(x, 1.5, atol=0.02)
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], dtype=float)
    assert kernels.simplify(line, 0.05).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]


def test_tile_grid_fixtures(spark):
    for side, n in ((5.0, 1), (12.0, 4)):
        box = spark.createDataFrame([(0.0, 0.0), (side, side)], "x double, y double")
        rows = joins.tile_grid(box, "x", "y", 6.0, 1.0).collect()
        assert len(rows) == n and all(r.ex0 <= r.cx0 and r.ex1 >= r.cx1 for r in rows)


def test_voxels_and_empty(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.5), (2, 0.003, 0.0, 0.0, 0.5), (3, 1.0, 1.0, 1.0, 0.2)], "pid long, x double, y double, z double, r double")
    rows = points.voxels(pts, 0.01, ("x", "r")).collect()
    assert sorted(r.n for r in rows) == [1, 2]
    assert points.voxels(pts.limit(0), 0.01, ("x",)).count() == 0
    flat = pts.withColumns({"g": F.lit(0.0), "b": F.lit(0.0)})
    assert points.density(flat.limit(0), 8).count() == 0 and points.density(flat.limit(1), 8).count() == 1


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    q, r = rng.random((60, 3)) * 50, rng.random((40, 3))
    df = lambda a, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], f"{k} long, x double, y double, z double")
    got = {x.q: x.near for x in joins.nearest(df(q, "q"), "q", df(r, "r"), "r", ["x", "y", "z"], 0.5).collect()}
    d = ((q[:, None] - r[None]) ** 2).sum(-1)
    assert got == dict(enumerate(d.argmin(1).tolist()))


def test_merge_arcs_same_for_any_partitioning(spark):
    rng = np.random.default_rng(3)
    n = rng.normal(size=(80, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    df = spark.createDataFrame([(f"p{i % 3}", i, *map(float, v), 1.0 + i % 5) for i, v in enumerate(n)], "pano string, line_id long, nx double, ny double, nz double, len double")
    run = lambda d: sorted((r.pano, r.line_id, round(r.len, 6)) for r in kernels.merge_arcs(d, 0.3).collect())
    assert run(df.repartition(1)) == run(df.repartition(7))
    assert abs(sum(r[2] for r in run(df)) - sum(1.0 + i % 5 for i in range(80))) < 1e-6


def test_ply_png_glb_round_trips(spark, tmp_path):
    v = {"x": np.array([0.0, 1.5]), "y": np.array([2.0, 3.0]), "z": np.array([4.0, 5.0]), "r": np.array([1.0, 0.0]), "g": np.array([0.2, 0.4]), "b": np.array([0.0, 1.0])}
    (tmp_path / "a.ply").write_bytes(codecs.encode_ply(v, [[0, 1, 0]]))
    (tmp_path / "b.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nend_header\n7 8 9\n")
    rows = sorted(codecs.read_ply(spark, str(tmp_path)).collect(), key=lambda r: (r.path, r.pid))
    assert [(r.x, r.y, r.z, r.g) for r in rows] == [(0, 2, 4, 51 / 255), (1.5, 3, 5, 102 / 255), (7, 8, 9, 0)]
    assert codecs.decode_ply((tmp_path / "a.ply").read_bytes())[1] == [[0, 1, 0]]
    image = np.random.default_rng(4).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "c.png").write_bytes(codecs.encode_png(image))
    assert (codecs.decode_png(codecs.encode_png(image)) == image).all()
    assert codecs.read_pixels(spark, str(tmp_path)).count() == 35
    text = json.dumps({"asset": {"version": "2.0"}}).encode()
    text += b" " * (-len(text) % 4)
    glb = struct.pack("<III", codecs.GLB_MAGIC, 2, 20 + len(text) + 8) + struct.pack("<II", len(text), codecs.JSON_CHUNK) + text + b"BIN!BIN!"
    out = bytes(codecs.with_glb_extras(spark.createDataFrame([(bytearray(glb),)], "c binary"), "c", {"unit": "meter", "scale": 1.0}).first().c)
    size = struct.unpack("<I", out[12:16])[0]
    assert json.loads(out[20 : 20 + size])["asset"]["extras"] == {"unit": "meter", "scale": 1.0}
    assert struct.unpack("<I", out[8:12])[0] == len(out) and out.endswith(b"BIN!BIN!")
    assert codecs.patch_glb(b"nope", {}) == b"nope" and codecs.patch_glb(None, {}) is None


def drain(df, spark, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_streams_equal_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = lambda: logs.read_events(spark, str(tmp_path / "ev"))
    got = drain(logs.tumbling_counts(stream(), late="400 days"), spark, "tumbling", "complete").agg(F.sum("n")).first()[0]
    assert got == batch.count()
    assert drain(logs.first_seen(stream(), "400 days"), spark, "seen", "append").count() == batch.count()
    last = drain(logs.stage_states(stream()), spark, "states", "update").groupBy("user_id").agg(F.max("seen").alias("n"))
    want = batch.groupBy("user_id").count()
    assert last.join(want, "user_id").where("n <> count").count() == 0 and last.count() == want.count()


def test_floor_plane_against_brute_force(spark):
    rng = np.random.default_rng(3)
    room = np.c_[rng.uniform(0, 4, 30), rng.uniform(0, 4, 30), rng.uniform(0.5, 2, 30)]
    flat = np.c_[rng.uniform(0, 4, 40), rng.uniform(0, 4, 40), rng.normal(0, 0.01, 40)]
    tilt = np.array([[1, 0, 0], [0, 0.8, -0.6], [0, 0.6, 0.8]])
    clouds = {"two": flat[:2], "three": flat[:3], "line": np.c_[np.arange(5.0), np.arange(5.0), np.arange(5.0)], "floor": np.r_[flat, room], "ceiling": np.r_[flat, room * [1, 1, -1]], "tilted": np.r_[flat, room] @ tilt.T}
    for name, xyz in clouds.items():
        points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double").repartition(3)
        want = None
        for h in range(1000):
            i = np.argsort(kernels.draw(np.arange(len(xyz)), h))[:3]
            normal = np.cross(xyz[i[1]] - xyz[i[0]], xyz[i[2]] - xyz[i[0]]) if len(i) == 3 else np.zeros(3)
            if np.linalg.norm(normal) <= 1e-9:
                continue
            normal = normal / np.linalg.norm(normal)
            on = np.abs((xyz - xyz[i[0]]) @ normal) <= 0.05
            if want is None or on.sum() > want[1]:
                axis = max(range(3), key=lambda c: np.linalg.det(np.delete(np.delete(np.cov(xyz[on].T, bias=True), c, 0), c, 1)))
                rest = [c for c in range(3) if c != axis]
                slope = np.linalg.lstsq(np.c_[xyz[on][:, rest], np.ones(on.sum())], xyz[on][:, axis], rcond=None)[0]
                normal = np.zeros(3)
                normal[axis], normal[rest] = 1, -slope[:2]
                normal /= np.linalg.norm(normal)
                height = xyz[:, 2] if np.hypot(*normal[:2]) < 1e-6 else xyz @ normal
                want = (h, int(on.sum()), bool(not on.all() and np.median(height[~on]) < np.median(height[on])))
                plane = (*normal, -normal @ xyz[on].mean(axis=0))
        rows = kernels.floor_plane(points).collect()
        assert [(r.h, r.inliers, r.flip) for r in rows] == ([] if want is None else [want]), name
        assert not rows or np.allclose([rows[0][k] for k in "abcd"], plane, atol=1e-9), name
        assert (want is None) == (name in ("two", "line"))
