"""Planes, rays, triangles, texels and pixel components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators.joins import components
from voxloom.operators.points import quantiles
from voxloom.session import stored


def plane_lines(planes: DataFrame, parallel: float = 0.99) -> DataFrame:
    """(a, b, point, direction) of the crossing lines of all plane pairs a < b of one room that are not near parallel.

    ``planes``: (room, pid, nx, ny, nz, d) with unit normals and n . p + d = 0. The point is the
    one of the line that is nearest to the origin.
    """
    o = planes.select(*(F.col(c).alias("o_" + c) for c in planes.columns))
    pairs = planes.join(o, (F.col("room") == F.col("o_room")) & (F.col("pid") < F.col("o_pid"))).withColumn("dot", G.dot(("nx", "ny", "nz"), ("o_nx", "o_ny", "o_nz"))).where(F.abs("dot") < parallel)
    ux, uy, uz = G.cross(("nx", "ny", "nz"), ("o_nx", "o_ny", "o_nz"))
    den = F.lit(1.0) - F.col("dot") * F.col("dot")
    k1, k2 = (F.col("o_d") * F.col("dot") - F.col("d")) / den, (F.col("d") * F.col("dot") - F.col("o_d")) / den
    at = {c: k1 * F.col("n" + c) + k2 * F.col("o_n" + c) for c in "xyz"}
    return pairs.select(F.col("pid").alias("a"), F.col("o_pid").alias("b"), *(v.alias("p" + c) for c, v in at.items()), ux.alias("ux"), uy.alias("uy"), uz.alias("uz"))


def bake(faces: DataFrame, size: int, slack: float = 0.01) -> DataFrame:
    """(u, v, face, r, g, b) of the texels that faces (face, u0..v2, r0..b2) cover in a square atlas.

    Each face visits the texels of its box; barycentric weights within (-slack, 1 + slack)
    count; where faces meet, the last one wins.
    """
    box = lambda f, c, g: g(f(*(F.col(f"{c}{i}") for i in range(3))) * (size - 1))
    lo = lambda c: F.greatest(F.floor(box(F.least, c, lambda x: x)), F.lit(0))
    hi = lambda c: F.least(F.ceil(box(F.greatest, c, lambda x: x)), F.lit(size - 1))
    at = faces.withColumn("u", F.explode(F.sequence(lo("u").cast("int"), hi("u").cast("int")))).withColumn("v", F.explode(F.sequence(lo("v").cast("int"), hi("v").cast("int"))))
    x, y = F.col("u") / (size - 1), F.col("v") / (size - 1)
    den = (F.col("v1") - F.col("v2")) * (F.col("u0") - F.col("u2")) + (F.col("u2") - F.col("u1")) * (F.col("v0") - F.col("v2"))
    w0 = F.try_divide((F.col("v1") - F.col("v2")) * (x - F.col("u2")) + (F.col("u2") - F.col("u1")) * (y - F.col("v2")), den)
    w1 = F.try_divide((F.col("v2") - F.col("v0")) * (x - F.col("u2")) + (F.col("u0") - F.col("u2")) * (y - F.col("v2")), den)
    at = at.withColumns({"w0": w0, "w1": w1}).withColumn("w2", F.lit(1.0) - F.col("w0") - F.col("w1"))
    at = at.where(" AND ".join(f"w{i} > {-slack} AND w{i} < {1 + slack}" for i in range(3)))
    rgb = [(F.col("w0") * F.col(c + "0") + F.col("w1") * F.col(c + "1") + F.col("w2") * F.col(c + "2")).alias(c) for c in "rgb"]
    return at.groupBy("u", "v").agg(F.max(F.struct("face", *rgb)).alias("_m")).select("u", "v", "_m.*")


def cube_rays(faces: DataFrame, size: int) -> DataFrame:
    """(cube, i, j, x, y, z): the viewing direction of each pixel of six 90-degree faces (cube 0..5: +x -x +y -y +z -z)."""
    px = faces.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    a, b = (F.col("i") + 0.5) / size * 2 - 1, (F.col("j") + 0.5) / size * 2 - 1
    one, k = F.lit(1.0), F.col("cube")
    pick = lambda *six: F.element_at(F.array(*six), k + 1)
    x, y, z = pick(one, -one, a, a, a, -a), pick(a, -a, one, -one, b, b), pick(b, b, b, -b, one, -one)
    n = F.sqrt(a * a + b * b + 1)
    return px.select("cube", "i", "j", (x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z"))


def pixel_components(pixels: DataFrame, least: int) -> DataFrame:
    """Set pixels (u, v) of 8-connected components with at least ``least`` pixels: (u, v, component, n)."""
    ids = pixels.select("u", "v", (F.col("v").cast("long") * (1 << 20) + F.col("u")).alias("id")).distinct()
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, -1), (1, 0), (1, 1), (0, 1))))
    near = ids.withColumn("s", F.explode(steps)).select(F.col("id").alias("a"), (F.col("u") + F.col("s.i")).alias("u"), (F.col("v") + F.col("s.j")).alias("v"))
    edges = near.join(ids.withColumnRenamed("id", "b"), ["u", "v"]).select("a", "b")
    found = ids.join(components(edges), ids["id"] == F.col("node"), "left").select("u", "v", F.coalesce("component", "id").alias("component"))
    big = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(big, "component")


def translation_grid(points: DataFrame, n: int) -> DataFrame:
    """About ``n`` positions: odd counts per axis in proportion to the squared extents, at even quantiles of the points."""
    e = points.agg(*(F.max(c) - F.min(c) for c in "xyz")).first()
    if e[0] is None:
        return points.select("x", "y", "z").limit(0)
    share = [max(float(v), 1e-9) ** 2 for v in e]
    base = (n / math.prod(share)) ** (1 / 3)
    counts = [max(1, 2 * int(base * s / 2) + 1) if base * s < n else n | 1 for s in share]
    counts = [min(c, 2 * int(n ** (1 / 2)) + 1) for c in counts]
    axes = [quantiles(points, [], F.col(c), tuple((k + 0.5) / m for k in range(m))).select(F.explode(F.array(*(F.col(f"q{k}") for k in range(m)))).alias(c)) for c, m in zip("xyz", counts, strict=True)]
    # at most about n rows in all
    return axes[0].crossJoin(F.broadcast(axes[1])).crossJoin(F.broadcast(axes[2]))


def orthogonal_triple(directions: DataFrame, limit: float = 0.1, first: int = 64) -> DataFrame:
    """(i, j, k) of three directions whose pairwise |cos| is below the limit: the triple that is complete first when directions come by length.

    ``directions``: (i, x, y, z, length); ties in length go to the smaller i. Of triples that the same direction
    completes the one of smallest ranks counts. The longest 64, 128, 256, ... are searched until a triple is found or
    all are in: none that a longer prefix holds could be complete earlier.
    """
    total, keep = directions.count(), first
    while True:
        d = stored(directions.orderBy(F.col("length").desc(), "i").limit(keep), "longest")
        d = d.withColumn("n", F.row_number().over(Window.orderBy(F.col("length").desc(), "i"))).select("n", "i", "x", "y", "z")
        named = lambda p: d.select(*(F.col(c).alias(p + c) for c in ("n", "i", "x", "y", "z")))  # noqa: B023, E731
        off = lambda p, q: F.abs(G.dot((p + "x", p + "y", p + "z"), (q + "x", q + "y", q + "z"))) < limit
        ab = named("a").join(named("b"), F.col("an") < F.col("bn")).where(off("a", "b"))
        abc = ab.join(named("c"), F.col("bn") < F.col("cn")).where(off("a", "c") & off("b", "c"))
        best = stored(abc.agg(F.min(F.struct("cn", "an", "bn", "ai", "bi", "ci")).alias("_m")).where("_m is not null").select(F.col("_m.ai").alias("i"), F.col("_m.bi").alias("j"), F.col("_m.ci").alias("k")), "triple")
        if keep >= total or not best.isEmpty():
            return best
        keep *= 2


def octahedron_lines(points: DataFrame, radius: float) -> DataFrame:
    """(n, line): OBJ text of an octahedron (6 vertices, 8 faces) around every point (pid, x, y, z)."""
    verts = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    tris = [(a, b, c) if (a % 2 + b % 2 + c % 2) % 2 == 1 else (a, c, b) for a in (1, 2) for b in (3, 4) for c in (5, 6)]
    base = F.col("pid") * 6
    at = lambda c, k: F.col(c) + k * radius
    v = [F.format_string("v %.6f %.6f %.6f", at("x", i), at("y", j), at("z", k)) for i, j, k in verts]
    f = [F.concat(F.lit("f "), F.concat_ws(" ", *((base + i).cast("string") for i in t))) for t in tris]
    return points.select("pid", F.posexplode(F.array(*v, *f)).alias("i", "line")).select((F.col("pid") * 14 + F.col("i")).alias("n"), "line")


def histogram_consensus(df: DataFrame, value: Column, low: float, high: float, n: int, apart: int, keep: int) -> DataFrame:
    """(bin, mass): peaks of a histogram at least max(mean, 1) high, the higher of two within ``apart`` bins, top ``keep``.

    A peak stands unless a higher one (or an equal one before it) lies within reach.
    """
    bins = df.select(G.histogram_bin(value, low, high, n).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("mass"))
    tall = bins.crossJoin(F.broadcast(bins.agg((F.sum("mass") / n).alias("mean")))).where(F.col("mass") >= F.greatest(F.col("mean"), F.lit(1.0))).select("bin", "mass")
    o = bins.select(F.col("bin").alias("ob"), F.col("mass").alias("om"))
    lower = tall.join(o, (F.abs(F.col("bin") - F.col("ob")) <= apart) & (F.col("bin") != F.col("ob")) & ((F.col("om") > F.col("mass")) | ((F.col("om") == F.col("mass")) & (F.col("ob") < F.col("bin")))), "left_anti")
    return lower.orderBy(F.col("mass").desc(), "bin").limit(keep)
