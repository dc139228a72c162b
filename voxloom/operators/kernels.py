"""Iterative numerics inside grouped or mapped Python, for what columns can't express.

Every kernel takes one group (a polygon pair, a panorama's lines, a tile) and declares
its schema; Spark deals the groups to executors.
"""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators.points import quantiles
from voxloom.session import stored


def icosphere(level: int) -> np.ndarray:
    """Unit vectors of an icosahedron subdivided ``level`` times (10 * 4**level + 2 rows)."""
    g = (1 + math.sqrt(5)) / 2
    v = [np.array(p, dtype=float) for s, t in product((1, -1), (1, -1)) for p in ((0, s, t * g), (s, t * g, 0), (t * g, 0, s))]
    v = [p / np.linalg.norm(p) for p in v]
    near = min(np.linalg.norm(v[0] - q) for q in v[1:]) * 1.01
    faces = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if max(np.linalg.norm(v[a] - v[b]), np.linalg.norm(v[b] - v[c]), np.linalg.norm(v[a] - v[c])) < near]
    for _ in range(level):
        middle: dict[tuple[int, int], int] = {}

        def mid(a, b, middle=middle):
            key = (min(a, b), max(a, b))
            if key not in middle:
                m = v[a] + v[b]
                v.append(m / np.linalg.norm(m))
                middle[key] = len(v) - 1
            return middle[key]

        nxt = []
        for a, b, c in faces:
            ab, bc, ca = mid(a, b), mid(b, c), mid(c, a)
            nxt += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        faces = nxt
    return np.array(v)


def rotation_candidates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The 24 proper rotations that carry the axes ``a`` (rows) onto signed permutations of ``b``."""
    out = []
    for order in permutations(range(3)):
        for signs in product((1, -1), repeat=3):
            target = np.array([s * b[k] for s, k in zip(signs, order, strict=True)])
            u, _, vt = np.linalg.svd(target.T @ a)
            if np.linalg.det(target) * np.linalg.det(a) > 0:
                out.append(u @ np.diag([1, 1, np.linalg.det(u @ vt)]) @ vt)
    return np.array(out)


def overlap_areas(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Areas of the intersections of k pairs of simple polygons (k x n x 2 and k x m x 2), convex or not.

    Between neighbouring event heights (vertices and crossings) the common width is linear
    in y, so its value in the middle times the height is exact. All pairs and heights are
    one array program; short rings are padded by repeating their last vertex.
    """
    if not len(p):
        return np.zeros(0)
    a, b = p[:, :, None, :], np.roll(p, -1, axis=1)[:, :, None, :]
    c, d = q[:, None, :, :], np.roll(q, -1, axis=1)[:, None, :, :]
    r, s, w = b - a, d - c, c - a
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    ok = np.abs(den) > 1e-12
    den = np.where(ok, den, 1)
    t, u = (w[..., 0] * s[..., 1] - w[..., 1] * s[..., 0]) / den, (w[..., 0] * r[..., 1] - w[..., 1] * r[..., 0]) / den
    ok &= (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    y = np.where(ok, a[..., 1] + t * r[..., 1], a[..., 1])
    ys = np.sort(np.concatenate([p[:, :, 1], q[:, :, 1], y.reshape(len(p), -1)], axis=1), axis=1)
    mid, height = (ys[:, 1:] + ys[:, :-1]) / 2, np.diff(ys, axis=1)

    def crossings(ring):
        one, two = ring[:, None, :, :], np.roll(ring, -1, axis=1)[:, None, :, :]
        at = mid[:, :, None]
        on = (one[..., 1] > at) != (two[..., 1] > at)
        rise = np.where(on, two[..., 1] - one[..., 1], 1)
        return np.where(on, one[..., 0] + (at - one[..., 1]) * (two[..., 0] - one[..., 0]) / rise, np.inf)

    x = np.concatenate([crossings(p), crossings(q)], axis=2)
    first = np.arange(x.shape[2]) < p.shape[1]
    order = np.argsort(x, axis=2, kind="stable")
    x, first = np.take_along_axis(x, order, axis=2), first[order]
    there = np.isfinite(x)
    both = (np.cumsum(first & there, axis=2) % 2 == 1) & (np.cumsum(~first & there, axis=2) % 2 == 1)
    gap = np.where(both[:, :, :-1] & there[:, :, 1:], x[:, :, 1:] - np.where(there, x, 0)[:, :, :-1], 0)
    return (gap.sum(axis=2) * height).sum(axis=1)


#: Pairs of simple rings whose sides meet at once: their arrays stay in a core's cache.
SIDES = 512


def simple_overlaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The same of k pairs of rings that are simple (``is_simple``), many times as fast.

    A ring is the signed sum of the strips from below all points up to its sides, so the common area is the
    signed sum over pairs of sides of what both strips share: the integral of the lesser of two lines.
    """
    out = np.zeros(len(p))
    for at in range(0, len(p), SIDES):
        sides = []
        base = np.minimum(p[at : at + SIDES, :, 1].min(axis=1), q[at : at + SIDES, :, 1].min(axis=1))[:, None]
        for ring, axis in ((p, 2), (q, 1)):
            x, y = ring[at : at + SIDES, :, 0], ring[at : at + SIDES, :, 1] - base
            ox, oy = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
            way = np.sign(((x - ox) * (y + oy)).sum(axis=1))[:, None]
            wide = ox - x
            slope = np.where(wide != 0, (oy - y) / np.where(wide != 0, wide, 1), 0)
            sides.append([np.expand_dims(v, axis) for v in (np.minimum(x, ox), np.maximum(x, ox), x, y, slope, -np.sign(wide) * way)])
        (al, ah, ax, ay, am, sa), (bl, bh, bx, by, bm, sb) = sides
        low = np.maximum(al, bl)
        wide = np.minimum(ah, bh) - low
        k, i, j = np.nonzero(wide > 0)
        low, wide = low[k, i, j], wide[k, i, j]
        ax, ay, am, sa = (v[k, i, 0] for v in (ax, ay, am, sa))
        bx, by, bm, sb = (v[k, 0, j] for v in (bx, by, bm, sb))
        b = by + bm * (low - bx)
        d = ay + am * (low - ax) - b
        o = d + (am - bm) * wide
        less, more = np.minimum(d, o), np.maximum(d, o)
        cross = (less < 0) & (more > 0)
        under = np.where(more <= 0, (d + o) / 2, np.where(cross, -less * less / np.where(cross, 2 * (more - less), 1), 0))
        out[at : at + SIDES] = np.bincount(k, sa * sb * wide * (b + bm * wide / 2 + under), minlength=len(base))
    return out


def is_simple(ring: np.ndarray) -> bool:
    """Whether no two sides of a ring meet but neighbours at their common vertex; repeated vertices count once."""
    ring = ring[(ring != np.roll(ring, 1, axis=0)).any(axis=1)]
    n = len(ring)
    if n < 3:
        return False
    a, b = ring[:, None], np.roll(ring, -1, axis=0)[:, None]
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    c, d = a[None, :, 0], b[None, :, 0]
    apart = (side(a, b, c) * side(a, b, d) > 0) | (side(c, d, a) * side(c, d, b) > 0)
    box = lambda u, v: (np.minimum(u, v), np.maximum(u, v))
    (al, ah), (cl, ch) = box(a, b), box(c, d)
    apart |= ((ah < cl) | (ch < al)).any(axis=-1)
    i, j = np.indices((n, n))
    return bool((apart | np.isin((i - j) % n, (0, 1, n - 1))).all())


def overlap_area(p: np.ndarray, q: np.ndarray) -> float:
    """The same of one pair; rings of fewer than three vertices have no area."""
    return 0.0 if len(p) < 3 or len(q) < 3 else float(overlap_areas(p[None], q[None])[0])


def areas(p: np.ndarray) -> np.ndarray:
    """Areas of k rings (k x n x 2)."""
    n = np.roll(p, -1, axis=1)
    return 0.5 * np.abs((p[..., 0] * n[..., 1] - n[..., 0] * p[..., 1]).sum(axis=1))


def padded(rings: list) -> np.ndarray:
    """Rings of (x, y) structs as one array; empty ones become a point."""
    made = [np.array([(v["x"], v["y"]) for v in r], dtype=float).reshape(-1, 2) for r in rings]
    width = max([3, *(len(r) for r in made)])
    return np.array([np.vstack([r, np.repeat(r[-1:] if len(r) else np.zeros((1, 2)), width - len(r), axis=0)]) for r in made])


def fit_scores(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intersection over union, share of p inside q, intersection area) of k pairs of rings."""
    inter, a, b = overlap_areas(p, q), areas(p), areas(q)
    union = a + b - inter
    return np.where(union > 1e-12, inter / np.where(union > 1e-12, union, 1), 0), np.where(a > 1e-12, inter / np.where(a > 1e-12, a, 1), 0), inter


#: Pairs of rings measured at once.
PAIRS = 2000


def polygon_overlap(pairs: DataFrame) -> DataFrame:
    """(id, p, q: arrays of (x, y) structs) to (id, iou, inside, overlap)."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), PAIRS):
                part = frame.iloc[at : at + PAIRS]
                iou, inside, overlap = fit_scores(padded(part["p"]), padded(part["q"]))
                yield pd.DataFrame({"id": part["id"], "iou": iou, "inside": inside, "overlap": overlap})

    return pairs.select("id", "p", "q").mapInPandas(run, "id long, iou double, inside double, overlap double")


def clip_convex(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to an axis-aligned box, side by side."""
    x0, y0, x1, y1 = box
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            da, db = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                out.append(a + (b - a) * (da / (da - db)))
        ring = np.array(out).reshape(-1, 2)
        if not len(ring):
            break
    return ring


def simplify(ring: np.ndarray, epsilon: float) -> np.ndarray:
    """Open polyline with all points within ``epsilon`` of the result (farthest-point splitting, no recursion)."""
    keep, stack = np.zeros(len(ring), dtype=bool), [(0, len(ring) - 1)]
    keep[[0, -1]] = True
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d, w = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        n = math.hypot(*d)
        dist = np.abs(d[0] * w[:, 1] - d[1] * w[:, 0]) / n if n > 0 else np.hypot(w[:, 0], w[:, 1])
        k = int(dist.argmax())
        if dist[k] > epsilon:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep]


def differential_evolution(cost, bounds: np.ndarray, seed: int = 42, population: int = 25, rounds: int = 300, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Best point and cost of a box-bounded minimum, rand/1/bin with dithered scale."""
    rng = np.random.default_rng(seed)
    low, high = bounds[:, 0], bounds[:, 1]
    x = low + rng.random((population, len(low))) * (high - low)
    f = np.array([cost(v) for v in x])
    for _ in range(rounds):
        for i in range(population):
            a, b, c = x[rng.choice(np.delete(np.arange(population), i), 3, replace=False)]
            trial = a + rng.uniform(0.5, 1.0) * (b - c)
            cross = rng.random(len(low)) < 0.7
            cross[rng.integers(len(low))] = True
            trial = np.clip(np.where(cross, trial, x[i]), low, high)
            g = cost(trial)
            if g <= f[i]:
                x[i], f[i] = trial, g
        if f.std() <= tol * abs(f.mean()):
            break
    return x[f.argmin()], float(f.min())


def assign_optimally(cost: np.ndarray) -> list[int]:
    """Column of each row in a least-cost one-to-one assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


#: Fixed values of the draw: the prime that its arithmetic is modulo of, and the multipliers and steps of a hypothesis' line.
PRIME = 2147483647
SLOPE, SLOPE_STEP, SHIFT, SHIFT_STEP = 1103515245, 12345, 22695477, 1


def draw(pids: np.ndarray, h: int | np.ndarray) -> np.ndarray:
    """Key of each point id under hypothesis h: a line modulo PRIME, to the fifth power.

    The power is a bijection modulo PRIME and breaks up the even steps that lines leave
    between their least keys; all products fit 64 bits, so SQL says the same.
    """
    y = (pids.astype(np.int64) % PRIME * (1 + (h * SLOPE + SLOPE_STEP) % (PRIME - 1)) + (h * SHIFT + SHIFT_STEP) % PRIME) % PRIME
    square = y * y % PRIME
    return square * square % PRIME * y % PRIME


#: Points held against all hypotheses at once; points in boxes at once, and those of a box; boxes held against all planes at once.
DRAWN, HELD, LEAF, BOXES = 512, 1 << 19, 128, 64
#: Points that a hypothesis meets on average when keys are turned back to points; the most keys a point for which they are; keys that are broadcast.
MEET, SHARE, SMALL = 16, 16, 2_000_000


def fifth_roots(k: np.ndarray) -> np.ndarray:
    """The values modulo PRIME whose fifth powers are ``k``."""
    out, power, e = np.ones_like(k), k % PRIME, pow(5, -1, PRIME - 1)
    while e:
        if e & 1:
            out = out * power % PRIME
        power, e = power * power % PRIME, e >> 1
    return out


def triples(points: DataFrame, n: int) -> DataFrame:
    """(h, p): the three points of least key per hypothesis, the smaller pid on a tie; none for a hypothesis with fewer.

    With many points the draw is turned round: the least keys 0, 1, 2, ... of a hypothesis
    each belong to one residue of pid, and a join finds the points that have it. The more
    points, the fewer keys, so that the work is no longer points times hypotheses. Where
    three points are not met, or points are few, keys of all points are drawn; every
    partition then gives its own three.
    """

    def gathered(drawn):
        return drawn.groupBy("h").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "pid", *"xyz"))), 1, 3).alias("p")).where(F.size("p") == 3)

    def rooted(frames):
        for f in frames:
            yield pd.DataFrame({"k": f["id"], "root": fifth_roots(f["id"].to_numpy())})

    spark, rows, left, found = points.sparkSession, points.count(), list(range(n)), None
    keys = min(PRIME, -(-MEET * PRIME // max(rows, 1)))
    if n * keys <= SHARE * rows:
        slopes = [1 + (h * SLOPE + SLOPE_STEP) % (PRIME - 1) for h in left]
        lines = spark.createDataFrame([(h, pow(s, -1, PRIME), (h * SHIFT + SHIFT_STEP) % PRIME) for h, s in zip(left, slopes, strict=True)], "h int, back long, shift long")
        roots = spark.range(keys).mapInPandas(rooted, "k long, root long")
        residues = roots.crossJoin(F.broadcast(lines)).select("h", "k", (F.pmod(F.col("root") - F.col("shift"), F.lit(PRIME)) * F.col("back") % PRIME).alias("_r"))
        met = points.withColumn("_r", F.pmod("pid", F.lit(PRIME))).join(F.broadcast(residues) if n * keys <= SMALL else residues, "_r").drop("_r")
        found = stored(gathered(met), "triples")
        # n numbers at most
        left = sorted(set(left) - {r["h"] for r in found.select("h").collect()})
    if found is not None and not left:
        return found

    def least(frames):
        each = np.array(left, dtype=np.int64)
        held, bound = None, np.full((len(each), 1), np.iinfo(np.int64).max)
        for f in frames:
            pids, xyz = f["pid"].to_numpy(), f[list("xyz")].to_numpy()
            for at in range(0, len(pids), DRAWN):
                k = draw(pids[None, at : at + DRAWN], each[:, None])
                # only keys up to the third so far can be among the three least
                h, i = np.nonzero(k <= bound)
                new = pd.DataFrame({"h": h, "k": k[h, i], "pid": pids[at + i], **dict(zip("xyz", xyz[at + i].T, strict=True))})
                held = pd.concat([held, new]).sort_values(["h", "k", "pid"])
                place = held.groupby("h").cumcount()
                third = held[place == 2]
                bound[third["h"].to_numpy(), 0] = third["k"]
                held = held[place < 3]
        if held is not None:
            yield held.assign(h=each[held["h"].to_numpy()])

    drawn = gathered(points.mapInPandas(least, "h int, k long, pid long, x double, y double, z double"))
    return drawn if found is None else found.union(drawn)


def boxed(xyz: np.ndarray) -> np.ndarray:
    """(3, boxes, LEAF) of ``xyz`` (3, LEAF times a power of two): halved by number along the widest side until LEAF are left."""
    nodes = xyz[:, None]
    while nodes.shape[2] > LEAF:
        wide = np.ptp(nodes, axis=2).argmax(axis=0)
        order = np.argpartition(nodes[wide, np.arange(len(wide))], nodes.shape[2] // 2, axis=1)
        nodes = np.take_along_axis(nodes, order[None], axis=2).reshape(3, 2 * len(wide), -1)
    return nodes


def inlier_counts(xyz: np.ndarray, planes: np.ndarray, tolerance: float) -> np.ndarray:
    """Points (3, rows) within ``tolerance`` of each plane (a, b, c, d).

    A box that lies wholly outside or inside a plane's slab, by more than the rounding of
    the sums, is counted as one; only the points of the others are held against the plane.
    """
    normal, d = planes[:, :3].T, planes[:, 3]
    steep, total = np.abs(normal), np.zeros(len(planes), dtype=np.int64)

    def each(points, at):
        off = normal[0, at] * points[0][:, None] + normal[1, at] * points[1][:, None]
        off += normal[2, at] * points[2][:, None]
        off += d[at]
        total[at] += np.count_nonzero(np.abs(off, out=off) <= tolerance, axis=0)

    at = 0
    with np.errstate(invalid="ignore", over="ignore"):
        while xyz.shape[1] - at >= LEAF:
            size = LEAF << ((xyz.shape[1] - at) // LEAF).bit_length() - 1
            boxes = boxed(xyz[:, at : at + size])
            low, high = boxes.min(axis=2).T, boxes.max(axis=2).T
            centre, half = (low + high) / 2, (high - low) / 2 + 1e-12 * np.maximum(np.abs(low), np.abs(high))
            for b in range(0, len(low), BOXES):
                far, reach = np.abs(centre[b : b + BOXES] @ normal + d), half[b : b + BOXES] @ steep + 1e-12 * (np.abs(d) + tolerance)
                inside = far + reach <= tolerance
                total += LEAF * np.count_nonzero(inside, axis=0)
                # a box or plane with NaN is neither
                for i, cut in enumerate(~(inside | (far - reach > tolerance)), b):
                    each(boxes[:, i], np.flatnonzero(cut))
            at += size
        each(xyz[:, at:], np.arange(len(planes)))
    return total


def plane_hypotheses(points: DataFrame, n: int, tolerance: float) -> DataFrame:
    """(h, a, b, c, d, inliers) of planes through hashed triples of points (pid unique).

    The planes, n rows of five numbers, go to the tasks, which gather points in blocks and
    hand on one count a plane and partition. Triples on a line have no plane; points with a
    null coordinate take no part. The points are read three times.
    """
    known = points.select("pid", *"xyz").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    best = triples(known, n)
    p = [tuple(F.col("p")[i][c] for c in "xyz") for i in range(3)]
    normal = G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))
    planes = best.select("h", *(c.alias(k) for k, c in zip("abc", normal, strict=True)), *(c.alias("p" + k) for k, c in zip("xyz", p[0], strict=True))).withColumn("s", G.norm(("a", "b", "c"))).where("s > 1e-9")
    planes = planes.select("h", *((F.col(k) / F.col("s")).alias(k) for k in "abc"), "px", "py", "pz").withColumn("d", -G.dot(("a", "b", "c"), ("px", "py", "pz"))).drop("px", "py", "pz")
    planes = stored(planes, "planes")
    # n rows at most
    rows = planes.collect()
    ids, m = np.array([r["h"] for r in rows], dtype=np.int32), np.array([[r[k] for k in "abcd"] for r in rows]).reshape(-1, 4)

    def count(frames):
        total, parts, held = np.zeros(len(ids), dtype=np.int64), [], 0
        for f in frames:
            parts.append(f[list("xyz")].to_numpy().T)
            held += len(f)
            if held >= HELD:
                total += inlier_counts(np.hstack(parts), m, tolerance)
                parts, held = [], 0
        if parts:
            total += inlier_counts(np.hstack(parts), m, tolerance)
        yield pd.DataFrame({"h": ids, "inliers": total})

    counts = known.select(*"xyz").mapInPandas(count, "h int, inliers long").groupBy("h").agg(F.sum("inliers").alias("inliers"))
    return planes.join(counts, "h").select("h", *"abcd", "inliers")


def refitted(on: DataFrame) -> DataFrame:
    """(a, b, c, d): the plane of least squares through points (x, y, z), along the axis in which they spread least.

    One row from one aggregation; none where the points lie on a line.
    """
    part = {k: F.covar_pop(*k) for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
    m = on.agg(*(F.avg(c).alias("m" + c) for c in "xyz"), *(v.alias(k) for k, v in part.items()))
    v = {k: F.col(k) for k in part}
    minor = {"x": v["yy"] * v["zz"] - v["yz"] * v["yz"], "y": v["xx"] * v["zz"] - v["xz"] * v["xz"], "z": v["xx"] * v["yy"] - v["xy"] * v["xy"]}
    side = {"xy": v["xz"] * v["yz"] - v["xy"] * v["zz"], "xz": v["xy"] * v["yz"] - v["xz"] * v["yy"], "yz": v["xy"] * v["xz"] - v["yz"] * v["xx"]}
    normal = {"x": (minor["x"], side["xy"], side["xz"]), "y": (side["xy"], minor["y"], side["yz"]), "z": (side["xz"], side["yz"], minor["z"])}
    most = F.greatest(*minor.values())
    pick = lambda i: F.when(most == minor["x"], normal["x"][i]).when(most == minor["y"], normal["y"][i]).otherwise(normal["z"][i])
    n = m.select("mx", "my", "mz", most.alias("most"), *(pick(i).alias(k) for i, k in enumerate("abc"))).where("most > 0").withColumn("s", G.norm(("a", "b", "c")))
    n = n.select("mx", "my", "mz", *((F.col(k) / F.col("s")).alias(k) for k in "abc"))
    return n.select(*"abc", (-G.dot(("a", "b", "c"), ("mx", "my", "mz"))).alias("d"))


def floor_plane(points: DataFrame, n: int = 1000, tolerance: float = 0.05) -> DataFrame:
    """(h, a, b, c, d, inliers, flip) of the plane with most inliers, the smaller h on a tie, refitted to them.

    flip: with the normal turned to +z the other points lie, by their median, below the
    plane's, so that the cloud has to be turned over. No row where no three points span a plane.
    """
    points = stored(points.select("pid", *"xyz"), "points")
    best = stored(plane_hypotheses(points, n, tolerance).orderBy(F.col("inliers").desc(), "h").limit(1), "plane")
    found = best.select("h", *(F.col(k).alias("_" + k) for k in "abcd"), "inliers")
    near = F.abs(G.dot(("_a", "_b", "_c"), tuple("xyz")) + F.col("_d")) <= tolerance
    sided = points.select(*"xyz").crossJoin(F.broadcast(found)).withColumn("on", near)
    fit = stored(refitted(sided.where("on")), "plane")
    # a normal along z is left as it is
    height = F.when(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")) < 1e-6, F.col("z")).otherwise(G.dot(tuple("abc"), tuple("xyz")))
    sides = quantiles(sided.crossJoin(F.broadcast(fit)).select("on", height.alias("height")), ["on"], F.col("height"), (0.5,))
    # two rows
    flip = sides.agg((F.max(F.when(~F.col("on"), F.col("q0"))) < F.max(F.when(F.col("on"), F.col("q0")))).alias("flip"))
    return best.select("h", "inliers").crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(flip)).select("h", *"abcd", "inliers", F.coalesce("flip", F.lit(False)).alias("flip"))


def merge_arcs(arcs: DataFrame, angle: float, passes: int = 3) -> DataFrame:
    """(pano, line_id, nx, ny, nz, len) greedily merged by normal direction, longest first, per panorama."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n, w, ids = frame[["nx", "ny", "nz"]].to_numpy(), frame["len"].to_numpy(), frame["line_id"].to_numpy()
        order = np.lexsort((ids, -w))
        n, w, ids = n[order], w[order], ids[order]
        for _ in range(passes):
            used, out = np.zeros(len(n), dtype=bool), []
            for i in range(len(n)):
                if used[i]:
                    continue
                dots = n @ n[i]
                same = ~used & (np.abs(dots) >= math.cos(angle))
                used |= same
                m = (n[same] * (np.sign(dots[same]) * w[same])[:, None]).sum(axis=0)
                out.append((m / max(np.linalg.norm(m), 1e-12), w[same].sum(), ids[same].min()))
            if len(out) == len(n):
                break
            n, w, ids = np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])
        return pd.DataFrame({"pano": frame["pano"].iloc[0], "line_id": ids, "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2], "len": w})

    return arcs.groupBy("pano").applyInPandas(run, "pano string, line_id long, nx double, ny double, nz double, len double")


def normals(points: DataFrame, cell: float, least: int = 5) -> DataFrame:
    """(cx, cy, cz, n, nx, ny, nz): least-variance direction of each occupied cell.

    The covariance sums are ordinary aggregates; only the eigenvector is Python.
    """
    at = [F.floor(F.col(c) / cell).alias("c" + c) for c in "xyz"]
    moments = [F.avg(a).alias("m" + a) for a in "xyz"] + [F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    cells = points.select(*at, "x", "y", "z").groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), *moments).where(F.col("n") >= least)

    def run(frames):
        for f in frames:
            v = {k: f["v" + k].to_numpy() for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
            m = np.stack([np.stack([v["xx"], v["xy"], v["xz"]], 1), np.stack([v["xy"], v["yy"], v["yz"]], 1), np.stack([v["xz"], v["yz"], v["zz"]], 1)], 1)
            e = np.linalg.eigh(m)[1][:, :, 0] if len(f) else np.zeros((0, 3))
            e = np.where(e[:, 2:] < 0, -e, e)
            yield pd.DataFrame({"cx": f["cx"], "cy": f["cy"], "cz": f["cz"], "n": f["n"], "nx": e[:, 0], "ny": e[:, 1], "nz": e[:, 2]})

    return cells.mapInPandas(run, "cx long, cy long, cz long, n long, nx double, ny double, nz double")


def tiles_parallel(points: DataFrame, tile: list[str], least: int, fn, schema: str) -> DataFrame:
    """``fn`` on every tile of at least ``least`` points; smaller tiles are left out by a count."""
    big = points.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    return points.join(big, tile, "left_semi").groupBy(*tile).applyInPandas(fn, schema)
