"""Floor layouts: boundaries to rings, Manhattan snapping, placements in rooms, scales and labels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import kernels as K
from voxloom.operators import rings as R
from voxloom.session import stored


def lon_lat(u, v, width: int, height: int) -> tuple[Column, Column]:
    """Longitude and latitude of a panorama pixel's centre; latitude grows downwards."""
    return ((G.col(u) + 0.5) / width - 0.5) * (2 * G.PI), ((G.col(v) + 0.5) / height - 0.5) * G.PI


def floor_point(lon: Column, lat: Column, plane: float = 1.0) -> tuple[Column, Column]:
    """(x, -z) where the ray meets the plane y = ``plane``."""
    k = F.lit(plane) / F.sin(lat)
    return F.cos(lat) * F.sin(lon) * k, -F.cos(lat) * F.cos(lon) * k


def floor_pixel(x, z, width: int, height: int, plane: float = 1.0) -> tuple[Column, Column]:
    """The panorama pixel of a floor point (x, z as ``floor_point`` gives them)."""
    x, z = G.col(x), -G.col(z)
    r = F.sqrt(x * x + plane * plane + z * z)
    return (F.atan2(x / r, z / r) / (2 * G.PI) + 0.5) * width - 0.5, (F.asin(G.clamp(F.lit(plane) / r, -1.0, 1.0)) / G.PI + 0.5) * height - 0.5


def height_ratio(floor, ceiling, height: int) -> tuple[Column, Column]:
    """(valid, ratio) of one column: ceiling height over camera height by the two boundary rows."""
    f, c = (G.col(floor) / height - 0.5) * G.PI, (F.lit(0.5) - G.col(ceiling) / height) * G.PI
    return (f > 0.01) & (c > 0.01), F.tan(c) / F.tan(f)


def ceiling_to_floor(ceiling, height: int, ratio) -> Column:
    """The floor row that a ceiling row stands for."""
    c = (F.lit(0.5) - G.col(ceiling) / height) * G.PI
    return F.lit(height) * (F.lit(0.5) + F.atan(F.tan(c) / G.col(ratio)) / G.PI)


def densify(edges: DataFrame, keys: list[str], per_unit: int = 50, least: int = 10) -> DataFrame:
    """(keys, j, x, y): points along each edge (x, y, next_x, next_y), its end left out."""
    n = F.greatest(F.floor(F.sqrt(F.pow(F.col("next_x") - F.col("x"), 2) + F.pow(F.col("next_y") - F.col("y"), 2)) * per_unit).cast("int"), F.lit(least))
    e = edges.withColumn("_n", n).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c: (F.col(c) + (F.col("next_" + c) - F.col(c)) * F.col("j") / F.col("_n")).alias(c)
    return e.select(*keys, "j", at("x"), at("y"))


def main_angle(edges: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, angle): middle of the bin of edge directions (mod pi) with the most length; ties to the smaller angle."""
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    n = int(math.pi / step)
    b = F.pmod(F.floor(F.pmod(F.atan2(dy, dx), F.lit(math.pi)) / step).cast("int"), F.lit(n))
    # sums of lengths are rounded, so that equal bins stay equal
    hist = edges.withColumn("_l", F.sqrt(dx * dx + dy * dy)).where("_l >= 1e-6").groupBy(*keys, b.alias("_b")).agg(F.round(F.sum("_l"), 6).alias("_l"))
    return hist.groupBy(*keys).agg((-F.max(F.struct("_l", (-F.col("_b")).alias("b")))["b"]).alias("_b")).select(*keys, ((F.col("_b") + 0.5) * step).alias("angle"))


def snapped(edges: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Adds side (0: main direction, 1: across), ux, uy (unit direction), mx, my (middle) and length to every edge."""
    e = edges.join(main_angle(edges, keys, step), keys)
    dx, dy = F.col("next_x") - F.col("x"), F.col("next_y") - F.col("y")
    own, across = F.pmod(F.atan2(dy, dx), F.lit(math.pi)), F.pmod(F.col("angle") + math.pi / 2, F.lit(math.pi))
    off = lambda a: F.least(F.abs(own - a), F.lit(math.pi) - F.abs(own - a))
    e = e.withColumn("length", F.sqrt(dx * dx + dy * dy)).withColumn("side", F.when((F.col("length") >= 1e-6) & (off(across) < off(F.col("angle"))), 1).otherwise(0))
    to = F.when(F.col("side") == 1, across).otherwise(F.col("angle"))
    e = e.withColumns({"ux": F.cos(to), "uy": F.sin(to)}).withColumn("_s", F.when(dx * F.col("ux") + dy * F.col("uy") < 0, -1.0).otherwise(1.0))
    return e.withColumns({"ux": F.col("ux") * F.col("_s"), "uy": F.col("uy") * F.col("_s"), "mx": (F.col("x") + F.col("next_x")) / 2, "my": (F.col("y") + F.col("next_y")) / 2}).drop("_s", "angle")


def manhattan(rings: DataFrame, keys: list[str], order: str, step: float = math.radians(5)) -> DataFrame:
    """(keys, run, x, y): corners of rings whose edges all follow two directions.

    Edges are snapped, runs of one direction become one line through their length-weighted
    middle (runs do not wrap round), and neighbouring lines are met. Rings of which fewer
    than three runs are left keep their own vertices.
    """
    e = snapped(R.ring_next(rings, keys, order, ["x", "y"]), keys, step)
    lines = R.merge_runs(e.withColumn("_w", F.greatest("length", F.lit(1e-12))), keys, order, "side", "_w", ["mx", "my"])
    first = e.withColumn("_new", F.when(F.lag("side").over(Window.partitionBy(*keys).orderBy(order)) == F.col("side"), 0).otherwise(1)).withColumn("run", F.sum("_new").over(Window.partitionBy(*keys).orderBy(order)))
    heads = first.where("_new = 1").select(*keys, "run", "ux", "uy")
    lines = lines.join(heads, [*keys, "run"])
    n = R.ring_next(lines, keys, "run", ["mx", "my", "ux", "uy"]).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    x, y = R.line_meet(("mx", "my", "ux", "uy"), ("next_mx", "next_my", "next_ux", "next_uy"), 1e-10)
    made = n.where("_n >= 3").select(*keys, "run", x.alias("x"), y.alias("y"))
    kept = rings.join(n.where("_n < 3").select(*keys).distinct(), keys, "left_semi").select(*keys, F.col(order).cast("long").alias("run"), "x", "y")
    return made.unionByName(kept)


def turning(rings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, length, density, wobble): vertices per length and summed turning angle per length of open polylines."""
    w = Window.partitionBy(*keys).orderBy(order)
    v = rings.withColumns({"dx": F.lead("x").over(w) - F.col("x"), "dy": F.lead("y").over(w) - F.col("y")}).withColumn("len", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    v = v.withColumns({c: F.col(d) / (F.col("len") + 1e-6) for c, d in (("hx", "dx"), ("hy", "dy"))})
    turn = F.acos(G.clamp(F.col("hx") * F.lead("hx").over(w) + F.col("hy") * F.lead("hy").over(w), -1.0, 1.0))
    g = v.withColumn("turn", turn).groupBy(*keys).agg(F.sum("len").alias("length"), F.count(F.lit(1)).alias("_n"), F.sum("turn").alias("_t")).where("length > 0")
    return g.select(*keys, "length", (F.col("_n") / F.col("length")).alias("density"), (F.coalesce("_t", F.lit(0.0)) / F.col("length")).alias("wobble"))


def box_ring(x0, y0, x1, y1) -> Column:
    """array<struct<x, y>> of a box."""
    p = lambda a, b: F.struct(G.col(a).cast("double").alias("x"), G.col(b).cast("double").alias("y"))
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))


def placements(pieces: DataFrame, rooms: DataFrame, angles: list[float], steps: int) -> DataFrame:
    """(piece, room, a, i, j, score): every piece (piece, p, key) over a grid of places in every room (room, q) it may go to, by IoU.

    ``pieces`` has one row per piece and room. Rings are turned about their own origin; the
    grid goes over the room's box. Candidates are rows, scored in batches.
    """
    both = pieces.join(rooms, "room")
    turn = F.explode(F.array(*(F.struct(F.lit(k).alias("a"), F.lit(math.cos(a)).alias("c"), F.lit(math.sin(a)).alias("s")) for k, a in enumerate(angles))))
    side = lambda c: F.transform("q", lambda v: v[c])
    lo, hi = ({c: f(side(c)) for c in "xy"} for f in (F.array_min, F.array_max))
    box = both.withColumns({f"l{c}": lo[c] for c in "xy"} | {f"h{c}": hi[c] for c in "xy"}).withColumn("_a", turn)
    at = box.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = at.withColumns({"tx": F.col("lx") + (F.col("hx") - F.col("lx")) * F.col("i") / (steps - 1), "ty": F.col("ly") + (F.col("hy") - F.col("ly")) * F.col("j") / (steps - 1)})

    def run(frames):
        for frame in frames:
            for lo in range(0, len(frame), K.PAIRS):
                f = frame.iloc[lo : lo + K.PAIRS]
                p, c, s = K.padded(f["p"]), f["c"].to_numpy()[:, None], f["s"].to_numpy()[:, None]
                moved = np.stack([c * p[..., 0] - s * p[..., 1] + f["tx"].to_numpy()[:, None], s * p[..., 0] + c * p[..., 1] + f["ty"].to_numpy()[:, None]], axis=2)
                iou, inside, _ = K.fit_scores(moved, K.padded(f["q"]))
                yield f[["piece", "room", "a", "i", "j"]].assign(iou=iou, inside=inside)

    return at.select("piece", "room", "_a.a", "_a.c", "_a.s", "i", "j", "tx", "ty", "p", "q").mapInPandas(run, "piece long, room long, a int, i int, j int, iou double, inside double")


def best_placement(scored: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The first place with the highest score per key, in order of room, angle and grid place."""
    top = F.max(F.struct(F.round(score, 9).alias("score"), *((-F.col(c)).alias(c) for c in ("room", "a", "i", "j"))))
    return scored.groupBy(*keys).agg(top.alias("_m")).select(*keys, "_m.score", *((-F.col(f"_m.{c}")).alias(c) for c in ("room", "a", "i", "j") if c not in keys))


def refine_placements(pieces: DataFrame, rooms: DataFrame, angles: list[float], steps: int, least: float = 0.3, weight: float = 1.5) -> DataFrame:
    """(piece, room, a, i, j, score): pieces placed one after the other in their room, the largest first.

    The score is IoU + share inside - ``weight`` * share under pieces placed before; places
    with less than ``least`` inside don't count. Pieces of one rank are placed in all rooms
    at once, so the rounds are as many as the fullest room has pieces.
    """
    area = F.abs(F.aggregate(F.transform("p", lambda v, k: v["x"] * F.element_at("p", (k + 1) % F.size("p") + 1)["y"] - F.element_at("p", (k + 1) % F.size("p") + 1)["x"] * v["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
    ranked = stored(pieces.withColumn("k", F.row_number().over(Window.partitionBy("room").orderBy(F.round(area, 9).desc(), "piece"))), "pieces")
    done = None
    for k in range(1, (ranked.agg(F.max("k")).first()[0] or 0) + 1):
        cand = placements(ranked.where(F.col("k") == k).select("piece", "room", "p"), rooms, angles, steps).where(F.col("inside") >= least)
        if done is None:
            free = cand.withColumn("over", F.lit(0.0))
        else:
            free = _under(cand, ranked, rooms, done, angles, steps)
        best = best_placement(free, ["piece", "room"], F.col("iou") + F.col("inside") - weight * F.col("over"))
        done = stored(best if done is None else done.unionByName(best), "placed")
    return done if done is not None else pieces.select("piece", "room", F.lit(0.0).alias("score"), *(F.lit(0).alias(c) for c in ("a", "i", "j"))).limit(0)


def _under(cand: DataFrame, ranked: DataFrame, rooms: DataFrame, done: DataFrame, angles: list[float], steps: int) -> DataFrame:
    """``cand`` with over: the share of each candidate that pieces placed before cover, piece by piece."""
    shape = ranked.select("piece", "room", "p").join(rooms, "room")
    held = cand.join(shape, ["piece", "room"]).join(
        done.join(shape, ["piece", "room"]).groupBy("room").agg(F.collect_list(F.struct(F.col("p").alias("p"), "a", "i", "j")).alias("before")), "room", "left"
    )  # one short array: the pieces placed in a room so far
    turn = np.array([(math.cos(a), math.sin(a)) for a in angles])

    def moved(p, q, a, i, j):
        p, box = np.array([(v["x"], v["y"]) for v in p]), np.array([(v["x"], v["y"]) for v in q])
        lo, hi, (c, s) = box.min(axis=0), box.max(axis=0), turn[a]
        return np.stack([c * p[:, 0] - s * p[:, 1], s * p[:, 0] + c * p[:, 1]], axis=1) + lo + (hi - lo) * np.array([i, j]) / (steps - 1)

    def run(frames):
        for frame in frames:
            over = np.zeros(len(frame))
            for n, row in enumerate(frame.itertuples(index=False)):
                own = moved(row.p, row.q, row.a, row.i, row.j)
                whole = K.areas(own[None])[0]
                if row.before is not None and whole > 1e-12:
                    over[n] = sum(K.overlap_area(own, moved(b["p"], row.q, b["a"], b["i"], b["j"])) for b in row.before) / whole
            yield frame[["piece", "room", "a", "i", "j", "iou", "inside"]].assign(over=over)

    return held.mapInPandas(run, "piece long, room long, a int, i int, j int, iou double, inside double, over double")


def optimize_assignments(assigned: DataFrame, rounds: int = 60, scales: tuple[float, float] = (0.2, 2.5), margin: float = 1.0) -> DataFrame:
    """(assignment, scale, score): one scale for all pieces and a turn and place for each, by differential evolution on the sum of IoU.

    ``assigned``: (assignment, piece, p, q), some rows an assignment; each assignment is one group.
    """

    def run(key, frame):
        frame = frame.sort_values("piece")
        p, q = K.padded(frame["p"]), K.padded(frame["q"])
        bounds = [scales]
        for ring in q:
            bounds += [(0.0, 2 * math.pi), *((ring[:, c].min() - margin, ring[:, c].max() + margin) for c in (0, 1))]

        def cost(v):
            t = v[1:].reshape(-1, 3)
            c, s = np.cos(t[:, :1]), np.sin(t[:, :1])
            moved = v[0] * np.stack([c * p[..., 0] - s * p[..., 1], s * p[..., 0] + c * p[..., 1]], axis=2) + t[:, None, 1:]
            return -float(K.fit_scores(moved, q)[0].sum())

        best, value = K.differential_evolution(cost, np.array(bounds), rounds=rounds)
        return pd.DataFrame({"assignment": [key[0]], "scale": [float(best[0])], "score": [-value]})

    return assigned.groupBy("assignment").applyInPandas(run, "assignment long, scale double, score double")


def snap_vertices(pairs: DataFrame) -> DataFrame:
    """(id, p, q) to (id, turn, i, j, error): the quarter turn and pair of vertices that bring ring p nearest to ring q.

    A vertex of p is put on a vertex of q; the error is the mean of the two mean distances
    from the vertices of one ring to the boundary of the other. Ties go to the first.
    """

    def to_ring(points, ring):
        a, d = ring, np.roll(ring, -1, axis=0) - ring
        w = points[:, None, :] - a[None]
        n = (d * d).sum(axis=1)
        t = np.clip((w * d).sum(axis=2) / np.where(n > 0, n, 1), 0, 1)
        return np.sqrt(((w - t[..., None] * d) ** 2).sum(axis=2)).min(axis=1).mean()

    def run(frames):
        for frame in frames:
            rows = []
            for n, p, q in zip(frame["id"], frame["p"], frame["q"], strict=True):
                p, q = (np.array([(v["x"], v["y"]) for v in r], dtype=float) for r in (p, q))
                found = []
                for turn, (c, s) in enumerate(((1, 0), (0, 1), (-1, 0), (0, -1))):
                    r = np.stack([c * p[:, 0] - s * p[:, 1], s * p[:, 0] + c * p[:, 1]], axis=1)
                    for i in range(len(r)):
                        for j in range(len(q)):
                            m = r + q[j] - r[i]
                            found.append((round(0.5 * (to_ring(m, q) + to_ring(q, m)), 9), turn, i, j))
                error, turn, i, j = min(found)
                rows.append((n, turn, i, j, error))
            yield pd.DataFrame(rows, columns=["id", "turn", "i", "j", "error"])

    return pairs.select("id", "p", "q").mapInPandas(run, "id long, turn int, i int, j int, error double")


def contour(mask: np.ndarray) -> np.ndarray:
    """Outer boundary pixels (x, y) of the largest 8-connected part of a mask, in order, by following its border."""
    parts, best = np.zeros(mask.shape, dtype=int), np.zeros((0, 2), dtype=int)
    count = 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if parts[y, x]:
            continue
        count += 1
        parts[y, x], queue, cells = count, [(x, y)], []
        while queue:
            u, v = queue.pop()
            cells.append((u, v))
            for du in (-1, 0, 1):
                for dv in (-1, 0, 1):
                    a, b = u + du, v + dv
                    if 0 <= b < mask.shape[0] and 0 <= a < mask.shape[1] and mask[b, a] and not parts[b, a]:
                        parts[b, a] = count
                        queue.append((a, b))
        if len(cells) > len(best):
            best = np.array(cells)
    if not len(best):
        return best
    own = {tuple(c) for c in best.tolist()}
    ring = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    start = min(own, key=lambda c: (c[1], c[0]))
    at, came, path = start, 4, []
    while True:
        path.append(at)
        for k in range(1, 9):
            way = (came + k) % 8
            nxt = (at[0] + ring[way][0], at[1] + ring[way][1])
            if nxt in own:
                break
        else:
            return np.array(path)
        # the search goes on from the empty pixel looked at last
        at, came = nxt, (way + 4) % 8
        if at == start and len(path) > 1 and _closed(path, own, ring, came, start):
            return np.array(path)


def _closed(path, own, ring, came, start) -> bool:
    """Whether following on from ``start`` leads to the second pixel again."""
    for k in range(1, 9):
        way = (came + k) % 8
        nxt = (start[0] + ring[way][0], start[1] + ring[way][1])
        if nxt in own:
            return nxt == path[1]
    return True


def mask_rings(pixels: DataFrame, key: str, least: int = 50, share: float = 0.002) -> DataFrame:
    """(key, i, x, y, area): simplified outline of the largest part of every mask (key, u, v); parts under ``least`` pixels give none."""

    def run(group, frame):
        u, v = frame["u"].to_numpy(), frame["v"].to_numpy()
        mask = np.zeros((int(v.max()) + 1, int(u.max()) + 1), dtype=bool)
        mask[v, u] = True
        line = contour(mask).astype(float)
        if len(line) < 3:
            return pd.DataFrame({key: [], "i": [], "x": [], "y": [], "area": []})
        area = float(K.areas(line[None])[0])
        around = np.sqrt(((np.roll(line, -1, axis=0) - line) ** 2).sum(axis=1)).sum()
        ring = K.simplify(np.vstack([line, line[:1]]), share * around)[:-1]
        keep = len(frame) >= least
        return pd.DataFrame({key: [group[0]] * len(ring), "i": range(len(ring)), "x": ring[:, 0], "y": ring[:, 1], "area": area}) if keep else pd.DataFrame({key: [], "i": [], "x": [], "y": [], "area": []})

    return pixels.groupBy(key).applyInPandas(run, f"{key} long, i int, x double, y double, area double")


def boundary_ring(boundary: DataFrame, keys: list[str], width: int, height: int, tolerance: float = 0.05) -> DataFrame:
    """(keys, i, x, y): floor rings of boundaries (keys, u, v), simplified."""
    x, z = floor_point(*lon_lat("u", "v", width, height))
    at = boundary.select(*keys, "u", x.alias("x"), z.alias("y"))
    kinds = ", ".join(f"{k} {at.schema[k].dataType.simpleString()}" for k in keys)

    def run(group, frame):
        f = frame.sort_values("u")
        line = f[["x", "y"]].to_numpy(dtype=float)
        ring = K.simplify(np.vstack([line, line[:1]]), tolerance)[:-1]
        return pd.DataFrame({**{k: [g] * len(ring) for k, g in zip(keys, group, strict=True)}, "i": range(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    return at.groupBy(*keys).applyInPandas(run, f"{kinds}, i int, x double, y double")
