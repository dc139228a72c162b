"""Ray casting by voxel traversal: rays and triangles meet in the voxels that both pass through.

Triangles stand in the voxels of their box that their plane cuts. A ray is cut at every
voxel wall it crosses, so its steps are its voxels in order. Rays walk in rounds of 8, 16, 32, ...
steps: a ray whose nearest hit lies within the steps walked so far is done, so only rays in
empty space walk on, and the rounds grow with the logarithm of the grid. Equal rays walk once, equal
triangles stand once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.session import stored

O, D, A, B, C = (tuple(p + c for c in "xyz") for p in "odabc")
KEYS = ("kx", "ky", "kz")
#: Decimals of a hit's parameter: nearer ones than these tell are at one place.
DIGITS = 9
#: How far, in barycentric weights, an edge is still hit: rays do not slip between faces that share one.
EDGE = 1e-9


def _gradients() -> dict[str, Column]:
    """What a triangle gives to every ray: its normal n, and per barycentric weight u, w and 1 - u - w a gradient and an offset.

    A point p of the plane has the weights g . p + k, so a ray costs five products of vectors
    once its parameter is known, and the row's expressions stay small enough to be compiled.
    """
    e, f = G.sub(B, A), G.sub(C, A)
    n = G.cross(e, f)
    nn = G.dot(n, n)
    gu, gw = (tuple(F.try_divide(c, nn) for c in G.cross(*v)) for v in ((f, n), (n, e)))
    gv = tuple(-(p + q) for p, q in zip(gu, gw, strict=True))
    out = dict(zip(("nx", "ny", "nz"), n, strict=True)) | {"nk": G.dot(n, A)}
    for name, g, one in (("u", gu, 0.0), ("w", gw, 0.0), ("v", gv, 1.0)):
        out |= dict(zip((name + "x", name + "y", name + "z"), g, strict=True)) | {name + "k": one - G.dot(g, A)}
    return out


def _meets(eps: float, limit: float) -> tuple[Column, Column]:
    """(t, inside): the parameter of ray (o, d) on the plane of a row of ``_gradients``, null where they are parallel, and whether the triangle is hit."""
    axes = lambda v: tuple(v + c for c in "xyz")
    det = G.dot(D, axes("n"))
    t = F.when(F.abs(det) > eps, (F.col("nk") - G.dot(O, axes("n"))) / det)
    weight = lambda v: G.dot(O, axes(v)) + F.col("t") * G.dot(D, axes(v)) + F.col(v + "k")
    inside = (F.col("t") > eps) & (F.col("t") <= limit)
    for v in "uwv":
        inside &= weight(v) >= -EDGE
    return t, inside


def voxels(triangles: DataFrame, low: tuple, size: float, pad: float) -> DataFrame:
    """Triangles (face, ax..cz) once per voxel that their box touches and their plane cuts."""
    span = lambda c, k: F.sequence(F.floor((F.least(*(p + c for p in "abc")) - pad - low[k]) / size), F.floor((F.greatest(*(p + c for p in "abc")) + pad - low[k]) / size))
    at = triangles
    for k, c in enumerate("xyz"):
        at = at.withColumn(KEYS[k], F.explode(span(c, k)))
    n = G.cross(G.sub(B, A), G.sub(C, A))
    middle = tuple(low[k] + (F.col(KEYS[k]) + 0.5) * size for k in range(3))
    reach = (size / 2 + pad) * (F.abs(n[0]) + F.abs(n[1]) + F.abs(n[2])) + pad
    return at.where(F.abs(G.dot(n, G.sub(middle, A))) <= reach)


def steps(rays: DataFrame, low: tuple, high: tuple, size: float, limit: float) -> DataFrame:
    """Adds ``at``: the parameters at which a ray enters the box, crosses a voxel wall, and leaves; rays that miss the box or stand still go."""
    near, far = F.lit(0.0), F.lit(float(limit))
    for k in range(3):
        o, d = F.col(O[k]), F.col(D[k])
        a, b = F.try_divide(F.lit(low[k]) - o, d), F.try_divide(F.lit(high[k]) - o, d)
        # a ray along the box's side has no bound by it, or is outside
        outside = (d == 0) & ~o.between(low[k], high[k])
        near = F.greatest(near, F.when(outside, math.inf).otherwise(F.least(a, b)))
        far = F.least(far, F.greatest(a, b))
    # stored, because the walls of three axes repeat both
    inside = stored(rays.withColumns({"_in": near, "_out": far}).where("_in <= _out AND _out < double('infinity')"), "entries")
    cuts = []
    for k in range(3):
        o, d = F.col(O[k]), F.col(D[k])
        cell = lambda t: F.floor((o + t * d - low[k]) / size)  # noqa: B023, E731
        first, last = F.least(cell(F.col("_in")), cell(F.col("_out"))) + 1, F.greatest(cell(F.col("_in")), cell(F.col("_out")))
        walls = F.when((d != 0) & (last >= first), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        cuts.append(F.transform(walls, lambda w: G.clamp((low[k] + w * size - o) / d, F.col("_in"), F.col("_out"))))  # noqa: B023
    return inside.withColumn("at", F.array_sort(F.concat(F.array("_in"), *cuts, F.array("_out")))).drop("_in", "_out")


def ray_hits(rays: DataFrame, triangles: DataFrame, size: float, limit: float = math.inf, eps: float = 1e-9, first: int = 8) -> DataFrame:
    """(ray, face, t): the nearest triangle in front of each ray within ``limit``; ties, to DIGITS decimals, to the smaller face. Rays without a hit have no row.

    ``rays``: (ray, ox..oz, dx..dz), ``triangles``: (face, ax..cz); t is in lengths of d. Null
    coordinates, rays without direction and flat triangles meet nothing.
    """
    known = triangles.where(" AND ".join(f"{c} IS NOT NULL" for c in (*A, *B, *C)))
    # the smallest face of equal triangles wins every tie between them; equal rays have one hit
    every = stored(known.groupBy(*A, *B, *C).agg(F.min("face").alias("face")), "faces")
    each = stored(rays.groupBy(*O, *D).agg(F.min("ray").alias("once")), "rays")
    e = every.agg(*(f(F.col(p + c)) for c in "xyz" for p in "abc" for f in (F.min, F.max))).first()
    if e[0] is None:
        return rays.select("ray").limit(0).select("ray", *(F.lit(None).cast(t).alias(n) for n, t in (("face", triangles.schema["face"].dataType), ("t", "double"))))
    pad = 1e-6 * size
    low = tuple(min(e[6 * k : 6 * k + 6]) - pad for k in range(3))
    high = tuple(max(e[6 * k : 6 * k + 6]) + pad for k in range(3))
    held = stored(voxels(every, low, size, pad).select("face", *KEYS, *(c.alias(k) for k, c in _gradients().items())), "voxels")
    left = stored(steps(each.select(F.col("once").alias("ray"), *O, *D), low, high, size, limit), "walks").select("*", F.lit(None).cast("struct<t: double, face: bigint>").alias("best"))
    t, inside = _meets(eps, limit)
    done, begin, count = [], 0, first
    while True:
        end = begin + count
        step = F.sequence(F.lit(begin), F.least(F.lit(end), F.size("at") - 1) - 1)
        walk = left.withColumn("_i", F.explode(step)).withColumn("_m", (F.get("at", F.col("_i")) + F.get("at", F.col("_i") + 1)) / 2)
        walk = walk.select("ray", *O, *D, *(F.floor((F.col(O[k]) + F.col("_m") * F.col(D[k]) - low[k]) / size).alias(KEYS[k]) for k in range(3)))
        met = walk.join(held, list(KEYS)).withColumn("t", t).where(inside).select("ray", "face", F.round("t", DIGITS).alias("t"))
        found = met.groupBy("ray").agg(F.min(F.struct("t", F.col("face").cast("long").alias("face"))).alias("_b"))
        reached = F.get("at", F.least(F.lit(end), F.size("at") - 1))
        over = (F.size("at") - 1 <= end) | (F.coalesce(F.col("best.t"), F.lit(math.inf)) <= reached)
        now = stored(left.join(found, "ray", "left").withColumn("best", F.coalesce(F.least("best", "_b"), "best", "_b")).drop("_b").withColumn("_over", over), "walked")
        done.append(now.where("_over AND best IS NOT NULL").select("ray", F.col("best.face").alias("face"), F.col("best.t").alias("t")))
        left = now.where("NOT _over").drop("_over")
        if left.isEmpty():
            break
        begin, count = end, 2 * count
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    alike = rays.select("ray", *O, *D).join(each, [*O, *D]).select("ray", "once")
    return alike.join(out.withColumnRenamed("ray", "once"), "once").select("ray", "face", "t")
