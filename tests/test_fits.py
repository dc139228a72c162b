"""Sweeps against the full grid, alignments against known offsets and a dense search."""

import numpy as np
import pytest

from voxloom.operators import directions, fits
from voxloom.operators.kernels import icosphere, overlap_area
from voxloom.plans import fits as plans

SF = "/root/testdata/sf0.001"
SHAPE = "array<struct<x: double, y: double>>"


def ring(points):
    return None if points is None else [{"x": float(x), "y": float(y)} for x, y in points]


def area(r):
    n = np.roll(r, -1, axis=0)
    return abs((r[:, 0] * n[:, 1] - n[:, 0] * r[:, 1]).sum()) / 2


def full_grid(plan, scales, step):
    """(scale, total, [(iou, angle, x, y)]) of one plan's (piece, ring, room, angles) by every combination."""
    best = None
    for scale in scales:
        one = []
        for _, r, room, angles in plan:
            r, room = np.array(r, float), np.array(room, float)
            top = (-1.0,)
            for a in angles:
                c, s = np.cos(np.radians(a)), np.sin(np.radians(a))
                t = (r - r.mean(axis=0)) * scale @ np.array([[c, s], [-s, c]])
                for x, y in fits.inner_places(room, step):
                    o = overlap_area(t + [x, y], room)
                    iou = round(o / (area(t) + area(room) - o), 9)
                    if iou > top[0]:
                        top = (iou, a, x, y)
            one.append(top)
        total = round(sum(o[0] for o in one), 8)
        if best is None or total > best[1]:
            best = (scale, total, one)
    return best


def test_sweep_equals_the_full_grid(spark):
    rng = np.random.default_rng(8)
    ell = np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 2), (0, 2)], float)
    rooms = [ell, ell * 1.3 + 5, np.array([(0, 0), (4, 0), (2, 3)], float), np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)]
    made = [(i // 2, i, rng.uniform(0.5, 1.2) * rooms[i % 4] + rng.normal(0, 0.1, rooms[i % 4].shape), rooms[i % 4], [0.0, 40.0, 90.0, 200.0][: 2 + i % 3]) for i in range(6)]
    rows = [(p, i, ring(r), ring(q), a, 1) for p, i, r, q, a in made] + [(7, 70, None, ring(ell), [0.0], 1), (7, 71, ring(ell), ring([(0, 0), (1, 0)]), [0.0], 1), (8, 80, [], ring(ell), [0.0], 1)]
    pieces = spark.createDataFrame(rows, f"plan long, piece long, ring {SHAPE}, room {SHAPE}, angles array<double>, scale int").repartition(3)
    values = np.linspace(0.4, 1.8, 21)
    scales = spark.createDataFrame([(p, i, float(s)) for p in (0, 1, 2, 7, 8) for i, s in enumerate(values)], "plan long, no int, scale double")
    got = {r.piece: r for r in fits.scale_sweep(pieces.drop("scale"), scales, 0.5).collect()}
    assert sorted(got) == list(range(6))
    for p in range(3):
        mine = [m[1:] for m in made if m[0] == p]
        scale, total, one = full_grid(mine, values, 0.5)
        for (i, *_), want in zip(mine, one, strict=True):
            assert (got[i].scale, got[i].total) == pytest.approx((scale, total), abs=1e-7)
            assert (got[i].iou, got[i].angle, got[i].tx, got[i].ty) == pytest.approx(want, abs=1e-8)
    assert fits.scale_sweep(pieces.drop("scale").limit(0), scales, 0.5).count() == 0


def test_places_lie_inside():
    u = np.array([(0, 0), (3, 0), (3, 3), (2, 3), (2, 1), (1, 1), (1, 3), (0, 3)], float)
    got = {tuple(map(float, p)) for p in fits.inner_places(u, 0.5)[1:]}
    want = {(x / 2, y / 2) for x in range(1, 6) for y in range(1, 6) if y < 2 or x < 2 or x > 4}
    assert got == want
    assert {tuple(map(float, p)) for p in fits.inner_places(u[::-1], 0.5)[1:]} == want


def test_alignment_finds_known_offsets(spark):
    ell = np.array([(0, 0), (4, 0), (4, 1), (2, 1), (2, 3), (0, 3)], float)
    rows, want = [], {}
    for i in range(12):
        k, spike = i % 4, [(0, 2), (-0.1 - i / 30, 1.8)]
        c, s = [(1, 0), (0, 1), (-1, 0), (0, -1)][k]
        source = np.vstack([ell, spike])
        at = ell + [i, -i]
        turned = source @ np.array([[c, s], [-s, c]]) * 0.5
        rows.append((i, ring(at), ring(turned), "a"))
        # where the source's box middle lies on the target
        want[i] = ((4 - k) % 4 * 90, *((source.min(axis=0) + source.max(axis=0)) / 2 + [i, -i]))
    rows += [(90, None, ring(ell), "a"), (91, ring(ell), [], "a"), (92, ring([(1, 1), (1, 1)]), ring(ell), "a")]
    pairs = spark.createDataFrame(rows, f"id long, target {SHAPE}, source {SHAPE}, angle string").repartition(3)
    got = {r.id: r for r in fits.align_rings(pairs, 2.0).collect()}
    assert sorted(got) == list(range(12))
    for i, w in want.items():
        assert (got[i].angle, got[i].x, got[i].y) == pytest.approx(w, abs=1e-3)
    free = {r.id: r for r in fits.align_rings(pairs).collect()}
    assert free[0].scale == pytest.approx(np.hypot(4, 3) / np.hypot(*np.ptp(np.array([(p["x"], p["y"]) for p in rows[0][2]]), axis=0)))


def test_alignment_is_as_good_as_a_dense_search():
    rng = np.random.default_rng(4)
    p, q = rng.uniform(-1, 1, (12, 6, 2)), rng.uniform(-1, 1, (12, 5, 2))
    p[3:6, 5] = np.nan
    _, got = fits.direction_search(lambda x: fits.boundary_means(p + x[:, None], q), 12, np.full(12, 1.5))
    grid = np.linspace(-0.75, 0.75, 61)
    dense = np.min([fits.boundary_means(p + [x, y], q) for x in grid for y in grid], axis=0)
    # line searches end in a valley that may not be the deepest
    assert (got <= dense + 0.05).all() and np.median(got - dense) <= 1e-3


def test_registered_alignment_of_all_suppliers(spark):
    got = plans.QUERIES["aligned_rings"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert all(r.angle == (4 - r.id % 4) % 4 * 90 and r.scale == 2 for r in got)


def test_registered_sweep_states_its_overlaps(spark):
    pieces = plans.angled(spark, SF)
    held = {}
    for r in pieces.where("plan = 0").orderBy("piece").collect():
        held[r.piece] = ([(v.x, v.y) for v in r.ring], [(v.x, v.y) for v in r.room])
    got = {r.piece: r for r in plans.QUERIES["scale_sweep"](spark, SF).collect()}
    assert len(got) == pieces.count()
    mine = [r for r in got.values() if r.plan == 0]
    assert len({r.scale for r in mine}) == 1 and mine[0].total == pytest.approx(sum(r.iou for r in mine), abs=1e-5)
    for r in mine:
        ring_, room = (np.array(v, float) for v in held[r.piece])
        c, s = np.cos(np.radians(r.angle)), np.sin(np.radians(r.angle))
        t = (ring_ - ring_.mean(axis=0)) * r.scale @ np.array([[c, s], [-s, c]]) + [r.tx, r.ty]
        o = overlap_area(t, room)
        assert r.iou == pytest.approx(o / (area(t) + area(room) - o), abs=1e-5)


@pytest.mark.parametrize("circles", [False, True])
def test_suppressed_votes_against_brute_force(spark, circles):
    d = np.random.default_rng(2).normal(size=(300, 3))
    d /= np.linalg.norm(d, axis=1)[:, None]
    lines = spark.createDataFrame([(*map(float, v), "a") for v in d] + [(None, 1.0, 0.0, "a")], "x double, y double, z double, votes string").repartition(5)
    points = icosphere(2).round(12)
    cosine = np.abs(points @ d.T)
    left, want = (cosine < 0.05).sum(axis=1).astype(float) if circles else cosine.max(axis=1).round(9), []
    for k in range(3):
        q = int(left.argmax())
        want.append((k, q, left[q]))
        left[np.abs(points @ points[q]) > np.cos(np.radians(30))] = -1
    assert [tuple(r) for r in directions.suppressed_votes(lines, circles, 2).orderBy("round").collect()] == want
    assert directions.suppressed_votes(lines.limit(0), circles, 2).count() == 0
