"""Great-circle arcs, the sphere of query directions, and distance fields over them.

An arc has unit end points s and e and the unit normal n of its circle; columns sx..nz.
The query sphere is a subdivided icosahedron: a fixed number of points, so it is the side
that may be broadcast, and the work is linear in the arcs, lines or points of the data.
"""

from __future__ import annotations

import math
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators.kernels import icosphere
from voxloom.session import bounded, stored

Q, S, E, N = (tuple(p + c for c in "xyz") for p in ("", "s", "e", "n"))


def sphere(spark: SparkSession, level: int) -> DataFrame:
    """(q, x, y, z): the 10 * 4 ** level + 2 points of the query sphere."""
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(icosphere(level).round(12))], "q int, x double, y double, z double")


def sphere_sql(level: int) -> str:
    """The same points as a common table expression of SQL."""
    return "sphere AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::INT, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for i, (x, y, z) in enumerate(icosphere(level).round(12).tolist())) + ") t(q, x, y, z))"


def to_arc(q=Q, s=S, e=E, n=N) -> Column:
    """Angle from a direction to an arc: to its circle where the foot lies between the ends, else to the nearer end."""
    cs, ce, se = G.dot(q, s), G.dot(q, e), G.dot(s, e)
    between = (cs - se * ce >= 0) & (ce - se * cs >= 0)
    ends = F.acos(G.clamp(F.greatest(cs, ce), -1.0, 1.0))
    return F.when(between, F.asin(F.least(F.abs(G.dot(q, n)), F.lit(1.0)))).otherwise(ends)


def arc_distance(queries: DataFrame, arcs: DataFrame, groups: list[str]) -> DataFrame:
    """(q, groups, d): each query's least angle to an arc of each group. The queries are the sphere's points."""
    both = arcs.select(*groups, *S, *E, *N).crossJoin(F.broadcast(queries.select("q", *Q)))
    return both.groupBy("q", *groups).agg(F.min(to_arc()).alias("d"))


def point_distance(queries: DataFrame, points: DataFrame, groups: list[str]) -> DataFrame:
    """(q, groups, d): each query's least angle to a point (px, py, pz) of each group."""
    both = points.select(*groups, "px", "py", "pz").crossJoin(F.broadcast(queries.select("q", *Q)))
    return both.groupBy("q", *groups).agg(F.acos(G.clamp(F.max(G.dot(Q, ("px", "py", "pz"))), -1.0, 1.0)).alias("d"))


def seen_from(lines: DataFrame, position: tuple[Column, Column, Column]) -> DataFrame:
    """3D segments (sx..ez) as arcs seen from a position: unit ends and normal; segments on one line with it have none."""
    s, e = G.sub(S, position), G.sub(E, position)
    at = lines.withColumns({f"_s{c}": v for v, c in zip(s, "xyz", strict=True)} | {f"_e{c}": v for v, c in zip(e, "xyz", strict=True)})
    at = at.withColumns({f"s{c}": v for v, c in zip(G.unit(("_sx", "_sy", "_sz")), "xyz", strict=True)} | {f"e{c}": v for v, c in zip(G.unit(("_ex", "_ey", "_ez")), "xyz", strict=True)})
    at = at.withColumns({f"n{c}": v for v, c in zip(G.cross(S, E), "xyz", strict=True)}).withColumn("_n", G.norm(N)).where("_n > 1e-9")
    return at.withColumns({f"n{c}": F.col(f"n{c}") / F.col("_n") for c in "xyz"}).drop("_n", *(f"_{p}{c}" for p in "se" for c in "xyz"))


def in_extent(p: tuple, s=S, e=E, slack: float = 0.0) -> Column:
    """Whether a direction on an arc's circle lies between the arc's ends, or within ``slack`` of them (as a cosine)."""
    se = G.dot(s, e)
    return (G.dot(p, s) - se * G.dot(p, e) >= -slack) & (G.dot(p, e) - se * G.dot(p, s) >= -slack)


def _pairs(arcs: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """(keys, grp, x, y) of all pairs of blocks: lists of arcs of a group and of the next.

    Blocks are stored. A block meets those of the next group in up to STRIPES tasks, so that it is copied
    that often at most, however many blocks it meets.
    """
    known = arcs.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "grp")))
    # the largest group tells how finely all are cut
    size = known.groupBy(*keys, "grp").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    m = (size[0] or 0) // (SIDE * 3 // 4) + 1
    stripes = min(m, STRIPES)
    block = F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("_b")
    blocks = known.groupBy(*keys, "grp", block).agg(F.collect_list(F.struct("id", *(F.col(c).cast("double").alias(c) for c in (*S, *E, *N)))).alias("x"))
    blocks = stored(blocks, "blocks")
    n = max(1, min(size[1] * stripes, TASKS))
    by = [*keys, "_g", "_s"]
    x = blocks.select(*keys, "grp", "x", F.pmod(F.col("grp") + 1, F.lit(groups)).cast("long").alias("_g"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("_s"))
    y = blocks.select(*keys, F.col("x").alias("y"), F.col("grp").cast("long").alias("_g"), (F.col("_b") % stripes).alias("_s"))
    # the rows are few and small but their pairs are much work, so their bytes do not tell the tasks
    both = x.repartition(n, *by).join(y.repartition(n, *by).hint("merge"), by)
    return bounded(both).select(*keys, "grp", "x", "y")


def _arrays(found: pa.StructArray) -> list[np.ndarray]:
    """Starts, ends and normals (3 x n) of a block."""
    return [np.stack([found.field(c).to_numpy(zero_copy_only=False).astype(float) for c in part]) for part in (S, E, N)]


def _crossings(x: list[np.ndarray], y: list[np.ndarray]):
    """(i, j, p, both) of the arcs of x in turns: the places of pairs of arcs whose circles cross, a crossing's direction, and whether it, and its opposite, lies on both arcs."""
    (s, e, n), (os, oe, on) = x, y
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    se, ose = dot(s, e), dot(os, oe)
    step = max(1, TURN // max(1, on.shape[1]))
    for at in range(0, n.shape[1], step):
        k = slice(at, at + step)
        a = n[:, k, None]
        c = (a[1] * on[2] - a[2] * on[1], a[2] * on[0] - a[0] * on[2], a[0] * on[1] - a[1] * on[0])
        far = np.sqrt(dot(c, c))
        i, j = np.nonzero(far > 1e-6)
        p = [v[i, j] / far[i, j] for v in c]
        i += at
        ps, pe, ops, ope = dot(p, s[:, i]), dot(p, e[:, i]), dot(p, os[:, j]), dot(p, oe[:, j])
        sides = (ps - se[i] * pe, pe - se[i] * ps, ops - ose[j] * ope, ope - ose[j] * ops)
        yield i, j, p, [np.logical_and.reduce([v * sign >= 0 for v in sides]) for sign in (1, -1)]


def _typed(arcs: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {arcs.schema[c].dataType.simpleString()}" for c in names)


def arc_meets(arcs: DataFrame, keys: list[str], groups: int = 3) -> DataFrame:
    """(keys, id, o_id, grp, x, y, z): where an arc of one group meets one of the next, on both arcs.

    Each pair of blocks of arcs is one array program, bounded in memory: the pairs that
    meet grow with the square of the arcs, so they come out without a shuffle of their own.
    """

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(c)[r].values for c in "xy")
                for i, j, p, both in _crossings(_arrays(x), _arrays(y)):
                    for sign, on in zip((1.0, -1.0), both, strict=True):
                        own = pa.array(np.full(np.count_nonzero(on), r))
                        fixed = {c: batch.column(c).take(own) for c in (*keys, "grp")}
                        met = {"id": x.field("id").take(pa.array(i[on])), "o_id": y.field("id").take(pa.array(j[on])), **{c: pa.array(sign * v[on]) for c, v in zip(Q, p, strict=True)}}
                        if len(own):
                            yield pa.RecordBatch.from_pydict({c: (fixed | met)[c] for c in (*keys, "id", "o_id", "grp", *Q)})

    schema = f"{_typed(arcs, [*keys, 'id'])}, o_id {arcs.schema['id'].dataType.simpleString()}, {_typed(arcs, ['grp'])}, x double, y double, z double"
    return _pairs(arcs, keys, groups).mapInArrow(run, schema)


def arc_meet_counts(arcs: DataFrame, keys: list[str], groups: int = 3) -> DataFrame:
    """(keys, id, n, o_n): how often each arc is the first and the second of ``arc_meets``; arcs that meet none are left out."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x, y = (batch.column(c)[r].values for c in "xy")
                n, o_n = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
                for i, j, _, both in _crossings(_arrays(x), _arrays(y)):
                    for on in both:
                        n += np.bincount(i[on], minlength=len(x))
                        o_n += np.bincount(j[on], minlength=len(y))
                for f, a, b in ((x, n, 0 * n), (y, 0 * o_n, o_n)):
                    own = pa.array(np.full(len(f), r))
                    yield pa.RecordBatch.from_pydict({**{c: batch.column(c).take(own) for c in keys}, "id": f.field("id"), "n": a, "o_n": b})

    each = _pairs(arcs, keys, groups).mapInArrow(run, f"{_typed(arcs, [*keys, 'id'])}, n long, o_n long")
    return each.groupBy(*keys, "id").agg(F.sum("n").alias("n"), F.sum("o_n").alias("o_n")).where("n > 0 OR o_n > 0")


#: Arcs of a block, pairs that are taken at once, copies of a block at most, and tasks at most.
SIDE, TURN, STRIPES, TASKS = 512, 1 << 15, 8, 4096


def plane_uv(p: tuple, plane: int) -> tuple[Column, Column]:
    """(u, v) of a direction on one of the three cyclic planes (1: xy, 2: yz, 3: zx): u from the second axis towards the first."""
    a, b, c = (G.col(p[(plane - 1 + k) % 3]) for k in range(3))
    flat = F.greatest(F.sqrt(a * a + b * b), F.lit(1e-6))
    up = F.asin(G.clamp(a / flat, -1.0, 1.0))
    u = F.when((b < 0) & (up >= 0), F.lit(G.PI) - up).when(b < 0, -F.lit(G.PI) - up).otherwise(up)
    return u, F.asin(G.clamp(c / F.sqrt(a * a + b * b + c * c), -1.0, 1.0))


def plane_xyz(u: Column, v: Column, plane: int) -> tuple[Column, Column, Column]:
    """The direction at (u, v) of a plane: the inverse of ``plane_uv``."""
    abc = (F.cos(v) * F.sin(u), F.cos(v) * F.cos(u), F.sin(v))
    return tuple(abc[(k - plane + 1) % 3] for k in range(3))


def circle_v(n: tuple, u: Column, plane: int) -> Column:
    """v at u on the great circle with normal n."""
    a, b, c = (G.col(n[(plane - 1 + k) % 3]) for k in range(3))
    return F.atan(-(a * F.sin(u) + b * F.cos(u)) / (c + 1e-9))


def view_rotation(yaw: Column, pitch: Column) -> list[list[Column]]:
    """Crop camera to panorama: Ry(yaw) Rx(-pitch), row-wise."""
    cy, sy, cp, sp = F.cos(yaw), F.sin(yaw), F.cos(pitch), F.sin(pitch)
    return [[cy, -sy * sp, sy * cp], [F.lit(0.0), cp, sp], [-sy, -cy * sp, cy * cp]]


def view_angle(name: Column, what: str) -> Column:
    """yaw or pitch in radians of a crop's file name (yaw30_pitch-20.jpg); null where it has none."""
    found = F.regexp_extract(name, r"yaw(-?\d+(?:\.\d+)?)_pitch(-?\d+(?:\.\d+)?)", 1 if what == "yaw" else 2)
    return F.radians(found.try_cast("double"))


def turned(p: tuple, rot: list[list[Column]], back: bool = False) -> tuple[Column, Column, Column]:
    """R p, or its inverse for ``back``."""
    rows = [[rot[j][i] for j in range(3)] for i in range(3)] if back else rot
    return tuple(G.dot(tuple(r), p) for r in rows)


def crop_pixel(c: tuple, size: int, fov: float) -> tuple[Column, Column]:
    """(u, v) of a camera direction in a square crop, whole pixels; null at or behind the camera."""
    x, y, z = (G.col(v) for v in c)
    f, mid = 0.5 * size / math.tan(math.radians(fov) / 2), (size - 1) / 2
    front = z > 1e-4
    return F.when(front, F.rint(f * x / z + mid).cast("int")), F.when(front, F.rint(-f * y / z + mid).cast("int"))


def front_part(a: tuple, b: tuple, near: float = 0.05) -> tuple[tuple, tuple]:
    """Both ends of a camera-space segment, cut to z >= near; all null where it lies behind."""
    a, b = [G.col(v) for v in a], [G.col(v) for v in b]
    gone = (a[2] < near) & (b[2] < near)
    k = F.try_divide(F.lit(near) - a[2], b[2] - a[2])
    cut = [p + k * (q - p) for p, q in zip(a, b, strict=True)]
    end = lambda own, z: tuple(F.when(~gone, F.when(z < near, c).otherwise(o)) for o, c in zip(own, cut, strict=True))
    return end(a, a[2]), end(b, b[2])


def to_up(n: tuple) -> list[list[Column]]:
    """Rotation that carries a unit normal onto +z (the identity near it, diag(1, 1, -1) opposite), row-wise."""
    x, y, z = (G.col(v) for v in n)
    s = F.sqrt(x * x + y * y)
    k = F.try_divide(F.lit(1.0) - z, s * s)
    flat = s < 1e-6
    one, zero = F.lit(1.0), F.lit(0.0)
    rot = [[one - k * x * x, -k * x * y, -x], [-k * x * y, one - k * y * y, -y], [x, y, z]]
    still = [[one, zero, zero], [zero, one, zero], [zero, zero, F.when(z < 0, -1.0).otherwise(1.0)]]
    return [[F.when(flat, b).otherwise(a) for a, b in zip(r, t, strict=True)] for r, t in zip(rot, still, strict=True)]


def ranges_overlap(a: tuple, b: tuple) -> Column:
    """Whether two ranges on the circle [0, 1] overlap; one that ends before it begins goes through 0."""
    (a0, a1), (b0, b1) = [[G.col(v) for v in r] for r in (a, b)]
    cut = lambda lo, hi: ((lo, F.when(hi < lo, 1.0).otherwise(hi)), (F.lit(0.0), F.when(hi < lo, hi).otherwise(0.0)))
    parts = zip(cut(a0, a1), cut(b0, b1), strict=True)
    first, second = (F.greatest(p[0], q[0]) < F.least(p[1], q[1]) for p, q in parts)
    return first | second


def in_range(at, r: tuple) -> Column:
    """Whether a place on the circle [0, 1] lies in a range."""
    at, lo, hi = G.col(at), G.col(r[0]), G.col(r[1])
    return F.when(hi > lo, at.between(lo, hi)).otherwise(((at >= lo) & (at <= 1)) | ((at >= 0) & (at <= hi)))


def signed_rotations(proper: bool = True) -> list[list[list[int]]]:
    """The signed permutations of the axes: 24 proper rotations, or all 48."""
    out = []
    for order in permutations(range(3)):
        turns = sum(order[i] > order[j] for i in range(3) for j in range(i + 1, 3))
        for signs in product((1, -1), repeat=3):
            if not proper or math.prod(signs) * (-1) ** turns == 1:
                out.append([[signs[i] if j == order[i] else 0 for j in range(3)] for i in range(3)])
    return out


def axis_class(d: tuple, axes: list[tuple], limit: float) -> Column:
    """Index of the axis to which a normal is nearest to perpendicular, if |cosine| < limit; else null. Ties go to the first."""
    c = [F.abs(G.dot(d, a)) for a in axes]
    least = F.least(*c)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(c))):
        out = F.when(c[i] == least, F.lit(i)).otherwise(out)
    return F.when(least < limit, out)
