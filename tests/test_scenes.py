"""Rays, normals, directions and pose refinement against plain numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import directions, normals, raycast, refine

RAY = "ray long, " + ", ".join(f"{p}{c} double" for p in "od" for c in "xyz")
TRI = "face long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz")


def brute_hits(rays, tris, limit):
    out = {}
    for r, o, d in rays:
        best = None
        for f, a, b, c in tris:
            e, g, s = b - a, c - a, o - a
            h = np.cross(d, g)
            det = e @ h
            if abs(det) <= 1e-9:
                continue
            q = np.cross(s, e)
            u, w, t = s @ h / det, d @ q / det, round(float(g @ q / det), 9)
            if u >= -1e-9 and w >= -1e-9 and u + w <= 1 + 1e-9 and 1e-9 < t <= limit and (best is None or (t, f) < best):
                best = (t, f)
        if best:
            out[r] = best
    return out


@pytest.mark.parametrize("size", [0.7, 50.0])
def test_rays_meet_what_all_pairs_meet(spark, size):
    rng = np.random.default_rng(8)
    corner = rng.uniform(-10, 10, (150, 3))
    tris = [(i, a, a + rng.normal(0, 2, 3), a + rng.normal(0, 2, 3)) for i, a in enumerate(corner)]
    tris += [(200, np.array([-9.0, -9, 3]), np.array([9.0, -9, 3]), np.array([0.0, 9, 3])), (201, np.array([-9.0, -9, 3]), np.array([9.0, -9, 3]), np.array([0.0, 9, 3]))]
    rays = [(i, rng.uniform(-14, 14, 3), rng.normal(size=3)) for i in range(60)]
    rays += [(100, np.array([0.5, 0.25, -20.0]), np.array([0.0, 0, 1])), (101, np.array([0.1, 0.2, 5.0]), np.array([0.0, 0, -0.01])), (102, np.array([0.0, 0, 0]), np.zeros(3)), (103, np.array([40.0, 0, 0]), np.array([0.0, 1, 0]))]
    df = spark.createDataFrame([(i, *map(float, (*o, *d))) for i, o, d in rays], RAY)
    faces = spark.createDataFrame([(i, *map(float, (*a, *b, *c))) for i, a, b, c in tris] + [(999, None, *[0.0] * 8)], TRI)
    for limit in (math.inf, 6.0):
        got = {r.ray: (r.t, r.face) for r in raycast.ray_hits(df, faces, size, limit, first=2).collect()}
        want = brute_hits(rays, tris, limit)
        assert len(want) > 5 and got.keys() == want.keys()
        assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], abs_tol=2e-9) for k in want)
    assert raycast.ray_hits(df, faces.limit(0), size).collect() == [] and raycast.ray_hits(df.limit(0), faces, size).collect() == []


def test_neighbours_are_the_nearest(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.uniform(0, 2, (150, 3)), [[1.0, 1, 1]] * 3])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(900, None, 1.0, 1.0)], "pid long, x double, y double, z double")
    got = {}
    for r in normals.neighbours(df, 6, 0.5).collect():
        got.setdefault(r.pid, set()).add(r.o)
    for i in range(len(p)):
        d2 = np.round(((p - p[i]) ** 2).sum(axis=1), 12)
        order = [j for j in np.lexsort((np.arange(len(p)), d2)) if d2[j] <= 0.25][:6]
        assert got[i] == set(order)
    assert 900 not in got


def test_signs_follow_the_lightest_tree(spark):
    rng = np.random.default_rng(2)
    edges = [(a, b, float(rng.integers(0, 6)) / 8, int(rng.choice([-1, 1]))) for a, b in itertools.combinations(range(25), 2) if rng.random() < 0.2]
    part, sign = {i: {i} for i in range(25)}, {i: 1 for i in range(25)}
    for a, b, _, same in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
        if part[a] is not part[b]:
            turn = same * sign[a] * sign[b]
            for i in part[b]:
                sign[i] *= turn
            part[a] |= part[b]
            for i in part[b]:
                part[i] = part[a]
    got = {r.pid: (r.part, r.sign) for r in normals.forest_signs(spark.createDataFrame(edges, "a long, b long, w double, same int"), spark.range(25).withColumnRenamed("id", "pid")).collect()}
    for i, j in itertools.combinations(range(25), 2):
        assert (got[i][0] == got[j][0]) == (part[i] is part[j])
        if part[i] is part[j]:
            assert got[i][1] * got[j][1] == sign[i] * sign[j]


def test_normals_of_a_sphere_look_out(spark):
    k = np.arange(400) + 0.5
    polar, turn = np.arccos(1 - 2 * k / 400), math.pi * (1 + 5**0.5) * k
    p = np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], axis=1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(1000, 50.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    got = {r.pid: r for r in normals.oriented_normals(df, 12, 0.4).collect()}
    assert all(np.array([got[i].nx, got[i].ny, got[i].nz]) @ p[i] > 0.97 for i in range(400))
    assert (got[1000].n, got[1000].nz) == (1, 1.0) and len(got) == 401


def brute_clusters(n, degrees):
    angle = np.arccos(np.clip(np.abs(n @ n.T), 0, 1))
    held = [[i] for i in range(len(n))]
    while len(held) > 1:
        d = {(i, j): round(float(np.mean(angle[np.ix_(held[i], held[j])])), 12) for i, j in itertools.combinations(range(len(held)), 2)}
        i, j = min(d, key=lambda k: (d[k], k))
        if d[i, j] > math.radians(degrees):
            break
        held[i] += held.pop(j)
    return {tuple(sorted(h)) for h in held}


@pytest.mark.parametrize("seed", range(2))
def test_average_link_equals_one_by_one_merging(spark, seed):
    rng = np.random.default_rng(seed)
    main = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [0.6, 0.8, 0]])
    n = main[rng.integers(0, 4, 40)] * rng.choice([-1, 1], (40, 1)) + rng.normal(0, 0.12, (40, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    rows = [(s, 100 * s + i, *map(float, v), float(i % 3 + 1)) for s, part in enumerate((n[:30], n[30:], n[:1])) for i, v in enumerate(part)]
    df = spark.createDataFrame(rows, "scene long, pid long, nx double, ny double, nz double, weight double")
    for degrees in (4.0, 10.0, 25.0):
        got = {}
        for r in directions.average_link(df, "scene", degrees).collect():
            got.setdefault((r.scene, r.label), []).append(r.pid % 100)
        for s, part in enumerate((n[:30], n[30:], n[:1])):
            assert {tuple(sorted(v)) for (q, _), v in got.items() if q == s} == brute_clusters(part, degrees)
    found = directions.dominant_directions(df).collect()
    assert sum(r.n for r in found) == len(rows)
    for r in found:
        assert math.isclose(math.hypot(r.x, r.y, r.z), 1, abs_tol=1e-6) and r.snapped == (max(abs(r.x), abs(r.y), abs(r.z)) == 1.0)
    assert directions.dominant_directions(df.limit(0)).collect() == []


def test_vanishing_points_and_their_fallbacks(spark):
    rng = np.random.default_rng(3)
    turn = refine.rotation(0.4, 0.3, -0.2)
    n = np.vstack([np.cross(turn[:, k], rng.normal(size=(m, 3))) for k, m in ((0, 60), (1, 50), (2, 40))])
    n /= np.linalg.norm(n, axis=1)[:, None]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(n)], "id long, nx double, ny double, nz double")
    rounds = directions.vote_rounds(df)
    got = np.array(directions.vanishing_points([d for _, _, d in rounds]))
    assert np.abs(got @ turn).max(axis=0).min() > 0.99 and np.linalg.det(got) > 0
    x, y, z = (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)
    assert directions.vanishing_points([x, (0.9, 0.43, 0.0), y, (0.0, 0.0, -1.0)]) == [x, y, z]
    pair = directions.vanishing_points([(0.8, 0.6, 0.0), x, (0.12, 0.9928, 0.0)])
    assert pair[0] == x and pair[1] == (0.12, 0.9928, 0.0) and pair[2][2] > 0.9
    assert directions.vanishing_points([x, (0.8, 0.6, 0.0)])[2] == (0.0, -0.0, 0.6)
    assert directions.vanishing_points([x]) == [] and directions.vote_rounds(df.limit(0)) == []


# ---- pose refinement


class Descent:
    """The same descent over three numbers, one candidate at a time."""

    def __init__(self, x, lr):
        self.x, self.lr, self.m, self.v, self.best, self.bad, self.k = np.array(x, float), lr, np.zeros(3), np.zeros(3), math.inf, 0, 0

    def step(self, cost, g):
        self.k += 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.x = self.x - self.lr * (self.m / (1 - 0.9**self.k)) / (np.sqrt(self.v / (1 - 0.999**self.k)) + 1e-8)
        if cost < self.best * (1 - 1e-4):
            self.best, self.bad = cost, 0
        else:
            self.bad += 1
        if self.bad > 5:
            self.lr, self.bad = self.lr * 0.9, 0


def numeric(f, x, h=1e-6):
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(3)])


def brute_refine(t, ypr, flat, solid, flat_lines, solid_lines, steps_t, steps_r):
    rot = refine.rotation(*ypr)
    see = lambda t: (lambda c: c / np.linalg.norm(c, axis=1)[:, None])((np.array([s[2] for s in solid]) - t) @ rot.T)
    p = np.array([f[2] for f in flat])
    d = Descent(t, 0.1)
    track, cost = [], None
    for _ in range(steps_t):
        s, groups = see(d.x), []
        for k in (*range(3), None):
            a = [i for i, f in enumerate(flat) if k is None or f[1] == k]
            b = [i for i, f in enumerate(solid) if k is None or f[1] == k]
            if not a or not b:
                continue
            m = np.sqrt(((p[a][:, None] - s[b][None]) ** 2).sum(axis=2))
            ok = [(a[i], b[j]) for i, j in enumerate(m.argmin(axis=1)) if m[:, j].argmin() == i and m[i, j] < (0.1 if k is None else 0.5)]
            groups.append((k, ok))
        every = [x for _, ok in groups for x in ok]
        if not every:
            break
        f = lambda t: float(np.mean([np.abs(p[i] - see(t)[j]).sum() for i, j in every]))  # noqa: B023, E731
        cost = f(d.x)
        g = numeric(f, d.x)
        d.step(cost, g)
        track = [x for k, ok in groups for x in ok if k is not None]
    rows = [(flat_lines[ln], solid_lines[solid[j][3]], solid_lines[solid[j][4]]) for i, j in track for ln in flat[i][3:]]
    r = Descent(ypr, 0.1)
    turn_cost = None
    for _ in range(steps_r):

        def f(v):
            m = refine.rotation(*v)
            c = np.array([min(np.abs((n @ m) * u).sum(), np.abs((n @ m) * w).sum()) for n, u, w in rows])
            return float(c[c < 0.2].mean() if (c < 0.2).any() else c.mean())

        turn_cost = f(r.x)
        r.step(turn_cost, numeric(f, r.x))
    return d.x, r.x, cost, turn_cost, track


@pytest.fixture(scope="module")
def room():
    rng = np.random.default_rng(4)
    corner = rng.uniform(0, 10, (24, 3)) * [1, 1, 0.3]
    t, ypr = np.array([4.0, 5.0, 1.4]), (0.5, 0.05, -0.04)
    rot = refine.rotation(*ypr)
    solid = [(i, i % 3, c, (i + 1) % 3, (i + 2) % 3) for i, c in enumerate(corner)]
    flat, lines = [], {}
    for i, k, c, a, b in solid:
        if i % 5:
            seen = rot @ (c - t)
            seen /= np.linalg.norm(seen)
            for axis in (a, b):
                n = np.cross(seen, rot[:, axis])
                lines[3 * i + axis] = n / np.linalg.norm(n)
            flat.append((i, k, seen, 3 * i + a, 3 * i + b))
    return t, ypr, flat, solid, lines, {k: np.eye(3)[k] for k in range(3)}


def test_refined_poses_equal_numpy(spark, room):
    t, ypr, flat, solid, flat_lines, solid_lines = room
    starts = [(t + [0.2, -0.15, 0.05], np.array(ypr) + [-0.03, 0.02, 0.025]), (t + [-0.1, 0.3, 0.0], np.array(ypr) + [0.02, -0.01, 0.01])]
    point = "pano long, i long, grp int, x double, y double, z double, a long, b long"
    frames = [spark.createDataFrame([(7, i, k, *map(float, v), a, b) for i, k, v, a, b in rows] + [(7, 999, 0, None, 0.0, 0.0, 0, 0)], point) for rows in (flat, solid)]
    frames += [spark.createDataFrame([(7, k, *map(float, v)) for k, v in d.items()], "pano long, line long, x double, y double, z double") for d in (flat_lines, solid_lines)]
    cand = "cand long, pano long, tx double, ty double, tz double, yaw double, pitch double, roll double"
    rows = [(c, 7, *map(float, (*a, *b))) for c, (a, b) in enumerate(starts)]
    # a pose of a panorama without intersections stays as it is
    rows.append((9, 8, 1.0, 2.0, 3.0, 0.1, 0.2, 0.3))
    got = {r.cand: r for r in refine.refine_poses(spark.createDataFrame(rows, cand), *frames, steps_t=8, steps_r=5).collect()}
    for c, (a, b) in enumerate(starts):
        x, v, cost, turn_cost, track = brute_refine(a, b, flat, solid, flat_lines, solid_lines, 8, 5)
        r = got[c]
        # the plain run takes its slopes by differences
        assert np.allclose([r.tx, r.ty, r.tz], x, atol=1e-4) and np.allclose([r.yaw, r.pitch, r.roll], v, atol=1e-3)
        assert math.isclose(r.cost, cost, abs_tol=1e-4) and math.isclose(r.turn_cost, turn_cost, abs_tol=1e-3)
        assert not r.reverted and r.n0 + r.n1 + r.n2 == len(track)
    assert (got[9].tx, got[9].roll, got[9].n0, got[9].cost) == (1.0, 0.3, 0, None) and not got[9].reverted
    # a drift over the limit gives the first pose back
    back = refine.refine_poses(spark.createDataFrame(rows[:1], cand), *frames, steps_t=3, steps_r=2, max_move=1e-6).first()
    assert back.reverted and (back.tx, back.yaw) == (rows[0][2], rows[0][5])


def test_slopes_are_derivatives(spark, room):
    t, ypr, flat, solid, flat_lines, solid_lines = room
    rows = [(0, *map(float, (*flat_lines[ln], *solid_lines[solid[i][3]], *solid_lines[solid[i][4]]))) for i, _, _, a, b in flat for ln in (a, b)]
    lines = spark.createDataFrame(rows, "cand long, " + ", ".join(f"{p}{c} double" for p in "nuw" for c in "xyz"))
    v = np.array(ypr) + [0.03, -0.02, 0.015]
    got = refine.turn_slopes(lines, spark.createDataFrame([(0, *map(float, v))], "cand long, yaw double, pitch double, roll double"), 0.2).first()

    def f(x):
        m = refine.rotation(*x)
        c = np.array([min(np.abs((np.array(r[1:4]) @ m) * r[4:7]).sum(), np.abs((np.array(r[1:4]) @ m) * r[7:10]).sum()) for r in rows])
        return float(c[c < 0.2].mean())

    assert math.isclose(got.now, f(v), rel_tol=1e-9) and np.allclose([got.g_yaw, got.g_pitch, got.g_roll], numeric(f, v), atol=1e-5)


def test_mutual_pairs_in_blocks(monkeypatch):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(70, 3)), rng.normal(size=(50, 3))
    whole = refine.mutual(a, b, 0.5)
    monkeypatch.setattr(refine, "BLOCK", 120)
    parts = refine.mutual(a, b, 0.5)
    assert len(whole[0]) and all((x == y).all() for x, y in zip(whole, parts, strict=True))
    assert [len(x) for x in refine.mutual(a[:0], b, 0.5)] == [0, 0]
