"""Work that grows with the input, not with copies, crowds or the number of input files."""

import re

import numpy as np
import pyarrow as pa
import pytest

from voxloom.llm import simhash
from voxloom.operators import arcs, fits, joins, kernels, raycast, refine, regions
from voxloom.sources import codecs, sinks

SHAPE = "array<struct<x: double, y: double>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def test_equal_pairs_are_aligned_once_in_their_own_tasks(spark, monkeypatch):
    seen, stored = {}, fits.stored
    monkeypatch.setattr(fits, "ALIGN_TASK", 2)
    monkeypatch.setattr(fits, "stored", lambda df, kind: seen.setdefault(kind, (df.count() if kind == "rings" else df.rdd.getNumPartitions(), stored(df, kind)))[1])
    box = np.array([(0, 0), (2, 0), (2, 1), (0, 1)])
    pairs = spark.createDataFrame([(i, ring(box + i % 4), ring(box)) for i in range(40)], f"id long, target {SHAPE}, source {SHAPE}").coalesce(1)
    got = fits.align_rings(pairs, 1.0).collect()
    assert sorted(r.id for r in got) == list(range(40))
    assert all((r.x, r.y) == pytest.approx((1 + r.id % 4, 0.5 + r.id % 4), abs=1e-3) for r in got)
    assert seen["rings"][0] == 4 and seen["aligned"][0] == 3


def test_crowded_references_meet_few_rows(spark, monkeypatch):
    seen, stored = {}, joins.stored
    monkeypatch.setattr(joins, "stored", lambda df, kind="round": seen.setdefault(kind, stored(df, kind)) if kind == "lists" else stored(df, kind))
    rng = np.random.default_rng(7)
    refs, rows = np.vstack([rng.random((2000, 2)), [[500, 500]]]), np.vstack([rng.random((300, 2)), [[np.nan, 0]]])
    table = lambda a, k: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(a)], f"{k} long, x double, y double")
    got = {r.q: r.near for r in joins.nearest(table(rows, "q"), "q", table(refs, "r"), "r", ["x", "y"], 2.0).collect()}
    assert got.pop(300) is None
    assert got == dict(enumerate(((rows[:300, None] - refs[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()))
    # all 2,000 lie within one cell of the side that is asked for
    assert seen["lists"].selectExpr("max(size(_l))").first()[0] <= joins.MANY


def test_equal_plans_share_one_sweep(spark, monkeypatch):
    swept, own = [], fits._swept
    monkeypatch.setattr(fits, "_swept", lambda pieces, scales, step: (swept.append(sorted(r.plan for r in pieces.select("plan").distinct().collect())), own(pieces, scales, step))[1])
    box = np.array([(0, 0), (2, 0), (2, 1), (0, 1)])
    rows = [(p, 10 * p + k, ring(box + k), ring(box * (1 + (p % 2 + k) % 2)), [0.0, 90.0]) for p in range(6) for k in range(2)]
    pieces = spark.createDataFrame(rows, f"plan long, piece long, ring {SHAPE}, room {SHAPE}, angles array<double>")
    scales = spark.createDataFrame([(p, no, s) for p in range(6) for no, s in enumerate((1.0, 1.5) if p < 5 else (0.5, 2.0))], "plan long, no int, scale double")
    got = {(r.plan, r.piece): (r.scale, r.total, r.iou, r.angle, r.tx, r.ty) for r in fits.scale_sweep(pieces, scales, 1.0).collect()}
    assert swept == [[0, 1, 5]] and len(got) == 12
    each = {(r.plan, r.piece): (r.scale, r.total, r.iou, r.angle, r.tx, r.ty) for r in own(pieces, scales, 1.0).collect()}
    assert got == each


def test_cost_matrix_works_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(joins, "SIDE", 8)
    rng = np.random.default_rng(8)
    p, q = rng.random((30, 4)).round(1), rng.random((20, 4)).round(1)
    table = lambda a, k: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)] + [(99, None), (98, [0.5, None, float("nan")])], f"{k} long, _{k} array<double>")
    got = {(r.a, r.b): r.n for r in joins.agreements(table(p, "a"), "a", table(q, "b"), "b", 4, 0.15).collect()}
    assert len(got) == 32 * 22 and got[99, 0] == got[0, 99] == 0 and got[98, 98] == 1
    assert all(got[i, j] == (np.abs(p[i] - q[j]) < 0.15).sum() for i in range(30) for j in range(20))


def test_descents_start_no_job_a_step(spark, monkeypatch):
    kinds, stored = [], refine.stored
    monkeypatch.setattr(refine, "stored", lambda df, kind: (kinds.append(kind), stored(df, kind))[1])
    rng = np.random.default_rng(9)
    room = rng.random((24, 3)) * 6
    seen = room - [3.0, 3.0, 1.5]
    seen /= np.linalg.norm(seen, axis=1)[:, None]
    points = lambda v, lines: spark.createDataFrame([(1, i, i % 3, *map(float, p), *lines(i)) for i, p in enumerate(v)], "pano long, i long, grp int, x double, y double, z double, a long, b long")
    line = lambda v: spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(v)], "pano long, line long, x double, y double, z double")
    flat, solid = points(seen, lambda i: (2 * i, 2 * i + 1)), points(room, lambda i: ((i + 1) % 3, (i + 2) % 3))
    normals = [np.cross(p, np.eye(3)[(i + k) % 3]) for i, p in enumerate(seen) for k in (1, 2)]
    start = spark.createDataFrame([(0, 1, 3.1, 2.9, 1.45, 0.01, 0.0, 0.0)], "cand long, pano long, tx double, ty double, tz double, yaw double, pitch double, roll double")
    one = refine.refine_poses(start, flat, solid, line([n / np.linalg.norm(n) for n in normals]), line(np.eye(3))).first()
    assert len(kinds) < 10 and abs(one.tx - 3) < 0.05 and abs(one.ty - 3) < 0.05 and abs(one.yaw) < 0.02


def test_mutual_pairs_meet_few_points(monkeypatch):
    taken, root = [], np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda v: (taken.append(np.size(v)), root(v))[1])
    rng = np.random.default_rng(10)
    p = rng.normal(size=(3000, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    # a crowd at one place counts once, and its first
    a, b = np.vstack([p, np.repeat(p[:1], 1000, axis=0)]), np.vstack([np.repeat(p[:1], 1000, axis=0), p + rng.normal(size=p.shape) * 1e-3, [[np.nan, 0, 0]]])
    i, j = refine.mutual(a, b, 0.1)
    assert sum(taken) < 100 * (len(a) + len(b))
    d = ((a[:3000, None] - b[None, 999:-1]) ** 2).sum(axis=2)
    to_b, to_a = d.argmin(axis=1), d.argmin(axis=0)
    want = [k for k in range(3000) if to_a[to_b[k]] == k and d[k, to_b[k]] < 0.01]
    assert i.tolist() == want and j.tolist() == [0 if to_b[k] == 0 else to_b[k] + 999 for k in want]


def test_equal_rays_walk_once_past_equal_triangles(spark, monkeypatch):
    seen, stored = {}, raycast.stored
    monkeypatch.setattr(raycast, "stored", lambda df, kind: seen.setdefault(kind, stored(df, kind)) if kind in ("walks", "voxels") else stored(df, kind))
    names = lambda p: ", ".join(f"{q}{c} double" for q in p for c in "xyz")
    faces = spark.createDataFrame([(30 - i, 0.2, 0.2, 1.0 + i % 2, 0.8, 0.2, 1.0 + i % 2, 0.2, 0.8, 1.0 + i % 2) for i in range(30)], "face long, " + names("abc"))
    rays = spark.createDataFrame([(i, 0.3, 0.3, 0.0, 0.0, 0.0, 1.0 - 2 * (i % 4 == 0)) for i in range(40)] + [(99, None, *[1.0] * 5)], "ray long, " + names("od"))
    got = {r.ray: (r.face, r.t) for r in raycast.ray_hits(rays, faces, 5.0).collect()}
    # two triangles of fifteen copies each: the nearer, and of its copies the smallest
    assert got == {i: (2, 1.0) for i in range(40) if i % 4}
    assert seen["walks"].count() == 1 and seen["voxels"].select("face").distinct().count() == 2


def arc_table(spark, n):
    rng = np.random.default_rng(11)
    s, e = (v / np.linalg.norm(v, axis=1)[:, None] for v in rng.normal(size=(2, n, 3)))
    k = np.cross(s, e)
    k /= np.linalg.norm(k, axis=1)[:, None]
    rows = [(i, f"p{i % 2}", i % 3, *map(float, (*s[i], *e[i], *k[i]))) for i in range(n)]
    rows += [(n, None, 0, *rows[0][3:]), (n + 1, "p0", 1, None, *rows[1][4:])]
    return s, e, k, spark.createDataFrame(rows, "id long, pano string, grp int, " + ", ".join(f"{p}{c} double" for p in "sen" for c in "xyz"))


def test_meets_of_arcs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(arcs, "SIDE", 8)
    monkeypatch.setattr(arcs, "TURN", 20)
    s, e, k, df = arc_table(spark, 90)
    want = set()
    for i in range(90):
        for j in range(i % 2, 90, 2):
            if (i + 1) % 3 == j % 3:
                c = np.cross(k[i], k[j])
                for p in (c, -c):
                    if all(p @ u[t] - (s[t] @ e[t]) * (p @ v[t]) >= 0 for t in (i, j) for u, v in ((s, e), (e, s))):
                        want.add((i, j, *(p / np.linalg.norm(p)).round(6)))
    got = arcs.arc_meets(df, ["pano"])
    assert {(r.id, r.o_id, *np.round([r.x, r.y, r.z], 6)) for r in got.collect()} == want and got.count() == len(want) > 50


def test_arcs_count_their_meets_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(arcs, "SIDE", 8)
    _, _, _, df = arc_table(spark, 60)
    met = [(r.pano, r.id, r.o_id) for r in arcs.arc_meets(df, ["pano"]).collect()]
    got = {(r.pano, r.id): (r.n, r.o_n) for r in arcs.arc_meet_counts(df, ["pano"]).collect()}
    assert got == {(p, i): (sum(m[:2] == (p, i) for m in met), sum(m[::2] == (p, i) for m in met)) for p, a, b in met for i in (a, b)}


def test_equal_groups_share_one_union(spark, monkeypatch):
    seen, walk = [], regions.walked
    monkeypatch.setattr(regions, "walked", lambda lines: (seen.append(lines.select("grp").distinct().count()), walk(lines))[1])
    box = ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))
    # groups of two boxes; in every fourth they are apart
    rows = [(g, 2 * g + r, i, x + r * (1 + 3 * (g % 4 == 0)), y) for g in range(12) for r in range(2) for i, (x, y) in enumerate(box)]
    df = spark.createDataFrame(rows, "grp long, ring long, seq int, x double, y double")
    found = regions.shells(df, 2.0)
    got = {}
    for r in found.select("grp", "ring", "area").distinct().collect():
        got.setdefault(r.grp, []).append(round(r.area, 9))
    assert got == {g: [2.0, 2.0] if g % 4 == 0 else [3.0] for g in range(12)} and seen == [2]


def test_large_ply_files_are_written_and_read_in_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(codecs, "RANGE", 1000)
    monkeypatch.setattr(codecs, "FRAME", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        points = spark.range(500).selectExpr("concat('c', id % 2, '.ply') AS name", "499 - id AS pid", "id * 0.5D AS x", "id * 1D AS y", "-id * 1D AS z", "(id % 5) / 5D AS r")
        parts = sinks.ply_files(points).groupBy("name").count().collect()
        assert all(r["count"] > 1 for r in parts) and len(parts) == 2
        sinks.write_files(sinks.ply_files(points), str(tmp_path / "ply"))
        frames = codecs.read_ply(spark, str(tmp_path / "ply"))
        got = sorted((r.path[-6:], r.pid, r.x, r.y, r.z, round(r.r, 2)) for r in frames.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((f"c{i % 2}.ply", (499 - i) // 2, i * 0.5, float(i), -float(i), i % 5 / 5) for i in range(500))
    whole = codecs.encode_ply({"x": [1.0], "y": [2.0], "z": [3.0]}, [[0, 0, 0]])
    assert codecs.decode_ply(whole)[1] == [[0, 0, 0]]


@pytest.mark.parametrize("small", [0, 10**9])
def test_hypotheses_meet_few_points(spark, monkeypatch, small):
    seen, stored = {}, kernels.stored
    monkeypatch.setattr(kernels, "stored", lambda df, kind: seen.setdefault(kind, stored(df, kind)))
    monkeypatch.setattr(kernels, "SHARE", 10**6)
    monkeypatch.setattr(kernels, "MEET", 3)
    monkeypatch.setattr(kernels, "SMALL", small)
    rng = np.random.default_rng(12)
    # every residue twice, so that the smaller pid comes first of equal keys
    pids = rng.integers(0, 1 << 40, 10000)
    pids = np.unique(np.r_[pids, pids + kernels.PRIME])
    df = spark.createDataFrame([(int(p), i * 1.0, 0.0, 0.0) for i, p in enumerate(pids)], "pid long, x double, y double, z double").repartition(3)
    got = {r.h: [(p.pid, p.x) for p in r.p] for r in kernels.triples(df, 6).collect()}
    want = {h: np.lexsort((pids, kernels.draw(pids, h)))[:3].tolist() for h in range(6)}
    assert got == {h: [(pids[i], float(i)) for i in at] for h, at in want.items()}
    # some hypotheses met three points, the others drew from all
    assert 0 < seen["triples"].count() < 6


def test_planes_meet_few_points(monkeypatch):
    monkeypatch.setattr(kernels, "LEAF", 16)
    taken, size = [], np.abs
    rng = np.random.default_rng(13)
    xyz = np.c_[rng.integers(1, 51, 40000), rng.integers(0, 11, 40000), rng.uniform(0, 100, 40000)].T * 1.0
    xyz[:, 7], xyz[2, 9], xyz[0, 11] = np.nan, np.inf, -np.inf
    p = xyz.T[rng.integers(100, 40000, (200, 3))]
    normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    planes = np.c_[normal, -(normal * p[:, 0]).sum(axis=1)] / np.linalg.norm(normal, axis=1)[:, None]
    # neighbours that lie just at the tolerance, and planes without numbers
    planes = np.r_[planes, [(0, 1, 0, -k - 0.05) for k in range(11)], [(0, 1, 0, -k - 1e-2 * 5) for k in range(11)], [(np.nan,) * 4]]
    with np.errstate(invalid="ignore"):
        off = planes[:, :1] * xyz[0] + planes[:, 1:2] * xyz[1]
        off += planes[:, 2:3] * xyz[2]
        off += planes[:, 3:]
    want = np.count_nonzero(size(off) <= 0.05, axis=1)
    monkeypatch.setattr(np, "abs", lambda v, **k: (taken.append(np.size(v)), size(v, **k))[1])
    assert kernels.inlier_counts(xyz, planes, 0.05).tolist() == want.tolist() and want.max() > 3000
    assert sum(taken) < off.size / 3
    assert kernels.inlier_counts(xyz[:, :5], planes, 0.05).tolist() == np.count_nonzero(size(off[:, :5]) <= 0.05, axis=1).tolist()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tiles_meet_without_a_copy_for_each_other(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(14)
    fps = rng.integers(0, 1 << 63, (60, 2), dtype=np.uint64)
    # every third differs from the one before in two bits
    fps[2::3] = fps[1::3] ^ np.uint64(5)
    df = spark.createDataFrame([(v.astype(">u8").tobytes(), i) for i, v in enumerate(fps)], "fp binary, node long")
    within, across = simhash.links(df, 4, 2)
    assert "CartesianProduct" in plan_of(across) and "Exchange" not in plan_of(across)
    linked = [(r.a, r.b) for t in (within, across) for r in t.collect()]
    assert sorted((min(x), max(x)) for x in linked) == [(i, i + 1) for i in range(1, 60, 3)]


def test_sets_of_a_large_class_meet_where_they_are_stored(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", 4)
    monkeypatch.setattr(simhash, "MEET", 2)
    rng = np.random.default_rng(15)
    own = [np.unique(rng.integers(0, 1 << 60, 20, dtype=np.uint64)) for _ in range(30)]
    sets = [v for v in own for _ in range(2)]
    rows = [(i, 7 if i < 52 else i, len(v), v.tobytes()) for i, v in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, class long, n long, shingles binary").repartition(3)
    within, across = simhash.similar_links(df, 0.8)
    assert "CartesianProduct" in plan_of(across)
    linked = [(r.a, r.b) for t in (within, across) for r in t.collect()]
    assert sorted((min(x), max(x)) for x in linked) == [(i, i + 1) for i in range(0, 52, 2)]


def test_simple_rings_overlap_by_their_sides(monkeypatch):
    rng = np.random.default_rng(16)
    ell = np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (0, 2)], float)
    a = np.where(np.arange(600) % 3, rng.uniform(0, 7, 600), np.radians(90 * (np.arange(600) % 4)))
    turn = np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]).transpose(2, 0, 1)
    p = ell @ turn + rng.uniform(-1, 1, (600, 1, 2)).round(1)
    for q in (ell[::-1], np.array([(0, 0), (4, 0), (2, 3), (2, 3)], float)):
        q = np.repeat(q[None], 600, axis=0)
        assert np.allclose(kernels.simple_overlaps(p, q), kernels.overlap_areas(p, q), atol=1e-12)
    bow = np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)
    touching = np.array([(0, 0), (1, 1), (2, 0), (2, 2), (1, 1), (0, 2)], float)
    assert [kernels.is_simple(r) for r in (ell, ell[::-1], np.vstack([ell, ell[:1]]), bow, touching)] == [True] * 3 + [False] * 2
    slow = []
    monkeypatch.setattr(fits, "overlap_areas", lambda p, q: (slow.append(len(p)), kernels.overlap_areas(p, q))[1])
    made = [(0, i, 0, 0, 1.0, ring(r), ring(r), [0.0, 90.0], 0.0, 0.0, area, area, 0.0, 0.0, 3.0, 2.0, kernels.is_simple(r), 0.0) for i, (r, area) in enumerate(((ell, 4.0), (bow, 2.0)))]
    names = ["plan", "piece", "no", "place", "scale", "centred", "room", "angles", "tx", "ty", "area", "room_area", "lx", "ly", "hx", "hy", "plain", "low"]
    batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*made, strict=True)), strict=True)))
    got = next(fits._turned(iter([batch]))).to_pydict()
    # only the ring that crosses itself goes the long way, at both angles
    assert got["iou"] == [1.0, 1.0] and got["turn"] == [0, 0] and slow == [2]


def test_blocks_of_vectors_meet_without_copies(spark, monkeypatch):
    monkeypatch.setattr(joins, "SIDE", 8)
    rng = np.random.default_rng(17)
    p, q = rng.random((50, 4)).round(1), rng.random((40, 4)).round(1)
    table = lambda v, k: spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(v)] + [(None, [None, 0.5])], f"{k} long, _{k} array<double>")
    found = joins.agreements(table(p, "a"), "a", table(q, "b"), "b", 4, 0.15)
    assert "CartesianProduct" in plan_of(found) and "Exchange" not in plan_of(found)
    got = {(r.a, r.b): r.n for r in found.collect()}
    assert len(got) == 51 * 41 and got[None, None] == 1
    assert all(got[i, j] == (np.abs(p[i] - q[j]) < 0.15).sum() for i in range(50) for j in range(40))


def test_blocks_of_arcs_are_copied_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(arcs, "SIDE", 8)
    monkeypatch.setattr(arcs, "STRIPES", 2)
    s, e, k, df = arc_table(spark, 150)
    both = arcs._pairs(df, ["pano"], 3)
    seen = [len(v) for r in both.collect() for v in (r.x, r.y)]
    blocks = both.selectExpr("pano", "grp", "xxhash64(to_json(x)) AS x").distinct().count()
    # each block meets all of the next group, but only two copies of it are sent
    assert max(seen) <= 16 and len(seen) / 2 > 4 * blocks
    sent = [int(x) for x in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan_of(both))]
    assert set(sent) == {12}


def test_still_points_are_ordered_once_in_a_descent(monkeypatch):
    asked, keys = [], refine.Cloud.keys
    monkeypatch.setattr(refine.Cloud, "keys", lambda self, size, *at: (asked.append((id(self), size)) if not at else None, keys(self, size, *at))[1])
    rng = np.random.default_rng(18)
    w = rng.random((2000, 3)).round(2) * [8, 6, 3]
    w = np.vstack([w, w[:300], [[np.nan, 0, 0], [np.inf, 1, 1]]])
    t, rot = np.array([4.0, 3.0, 1.5]), refine.rotation(0.3, 0.05, -0.02)
    p = refine.seen_from(w[:1500], t, rot)[0]
    p = np.vstack([p, p[:100], [[np.nan, 0, 1]]])
    for limit in (0.5, 0.1):
        sight = refine.Sight(p, w, limit)
        asked.clear()
        for k in range(8):
            at = t + rng.normal(0, 0.1, 3)
            got = sight.met(at, rot)
            with np.errstate(invalid="ignore"):
                a, _, s, far = refine.met(p, w, at, rot, limit)
            assert len(s) > 300 and all((x == y).all() for x, y in zip(got, (p[a], s, far), strict=True))
        still = [x for x in asked if x[0] == id(sight.p)]
        assert len(still) == len(set(still)) < 12
    with np.errstate(invalid="ignore"):
        assert all(len(v) == 0 for v in sight.met(np.full(3, np.nan), rot))
    assert all(len(v) == 0 for v in refine.Sight(p[:0], w, 0.5).met(t, rot))
