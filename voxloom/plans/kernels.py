"""Kernel-backed queries and the direction vote, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import arcs as A
from voxloom.operators import joins as J
from voxloom.operators import kernels as K
from voxloom.plans.joins import VEC, vectors
from voxloom.plans.points import CLOUD, cloud
from voxloom.session import stored, table

LEVEL, CELL = 5, 0.05


def q_polygon_overlap(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7 + 1.0).alias("w"), (F.col("p_partkey") % 5 + 1.0).alias("h"), (F.col("p_partkey") % 4 * 0.5).alias("s"))
    box = lambda x, y, w, h: F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))))
    zero = F.lit(0.0)
    pairs = p.select("id", box(zero, zero, F.col("w"), F.col("h")).alias("p"), box(F.col("s"), F.col("s"), F.lit(3.0), F.lit(2.0)).alias("q"))
    return K.polygon_overlap(pairs).select("id", *(F.round(c, 6).alias(c) for c in ("iou", "inside", "overlap")))


def q_direction_vote(spark, sf):
    """Three rounds over 10,242 points: each line votes for its closest point of the sphere; lines along the winner leave.

    A line's closest point lies within a cell's width, so lines and points meet in cells. A
    point and its opposite count as the one of smaller number.
    """
    lines = vectors(spark, sf).select("vec_id", "x", "y", "z")
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    lines = lines.where(n > 1e-9).select("vec_id", *((F.col(c) / n).alias(c) for c in "xyz"))
    points = A.sphere(spark, LEVEL).select(F.col("q").alias("i"), *(F.col(c).alias("p" + c) for c in "xyz"))
    # both of a pair of opposite points stand in the table, so the nearer of the two is met
    same = points.select(F.round("px", 9).alias("a"), F.round("py", 9).alias("b"), F.round("pz", 9).alias("c"), "i")
    pair = same.join(same.select((-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (-F.col("c")).alias("c"), F.col("i").alias("o")), ["a", "b", "c"]).select("i", F.least("i", "o").alias("point"))
    right = J.spread(points.join(pair, "i").select("point", "px", "py", "pz"), ["px", "py", "pz"], CELL)
    own = lines.select("vec_id", *"xyz", *(c.alias(f"_k{i}") for i, c in enumerate(J.cells(list("xyz"), CELL))))
    score = F.round(F.abs(F.col("x") * F.col("px") + F.col("y") * F.col("py") + F.col("z") * F.col("pz")), 9)
    near = own.join(F.broadcast(right), ["_k0", "_k1", "_k2"]).groupBy("vec_id", *"xyz").agg((-F.max(F.struct(score.alias("d"), (-F.col("point")).alias("p")))["p"]).alias("point"))
    near = stored(near, "votes")
    out = None
    for k in range(3):
        votes = near.groupBy("point").agg(F.count(F.lit(1)).alias("votes"))
        win = votes.orderBy(F.col("votes").desc(), "point").limit(1)
        one = win.select(F.lit(k).alias("round"), "point", "votes")
        out = one if out is None else out.union(one)
        at = win.select(F.col("point").alias("i")).join(points, "i").select("px", "py", "pz")
        near = near.crossJoin(F.broadcast(at)).where(F.abs(F.col("x") * F.col("px") + F.col("y") * F.col("py") + F.col("z") * F.col("pz")) < 0.95).drop("px", "py", "pz")
    return out


def q_plane_inliers(spark, sf):
    pts = cloud(spark, sf).groupBy("pid").agg(*(F.min(c).alias(c) for c in "xyz"))
    return K.floor_plane(pts).select("h", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in "abcd"), "inliers", "flip")


def q_cell_normals(spark, sf):
    return K.normals(cloud(spark, sf), 10.0).select("cx", "cy", "cz", "n", *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")))


def q_merge_arcs(spark, sf):
    v = vectors(spark, sf).select((F.col("label") % 4).cast("string").alias("pano"), F.col("vec_id").alias("line_id"), F.col("x"), F.col("y"), F.col("z"))
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    arcs = v.where(n > 1e-9).select("pano", "line_id", *((F.col(c) / n).alias("n" + c) for c in "xyz"), n.alias("len"))
    return K.merge_arcs(arcs, 0.1).select("pano", "line_id", F.round("len", 6).alias("len"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

SQL = {
    "polygon_overlap": """WITH p AS (SELECT p_partkey AS id, p_size % 7 + 1.0::DOUBLE AS w, p_partkey % 5 + 1.0::DOUBLE AS h, p_partkey % 4 * 0.5::DOUBLE AS s FROM part),
 o AS (SELECT id, w, h, greatest(least(w, s + 3) - s, 0) * greatest(least(h, s + 2) - s, 0) AS o FROM p) SELECT id, round(o / (w * h + 6 - o), 6) AS iou, round(o / (w * h), 6) AS inside, round(o, 6) AS overlap FROM o""",
    "plane_inliers": f"""WITH {CLOUD}, p AS (SELECT pid, min(x) AS x, min(y) AS y, min(z) AS z FROM pts GROUP BY pid), l AS (SELECT h, 1 + (h * {K.SLOPE} + {K.SLOPE_STEP}) % {K.PRIME - 1} AS s, (h * {K.SHIFT} + {K.SHIFT_STEP}) % {K.PRIME} AS t FROM range(1000) r(h)),
 r1 AS (SELECT h, p.*, (pid % {K.PRIME} * s + t) % {K.PRIME} AS r FROM p, l), r2 AS (SELECT *, r * r % {K.PRIME} AS r2 FROM r1), k AS (SELECT *, r2 * r2 % {K.PRIME} * r % {K.PRIME} AS k FROM r2),
 g AS (SELECT h, min(struct_pack(k := k, pid := pid, x := x, y := y, z := z), 3) AS p FROM k GROUP BY h), e AS (SELECT h, p[1].x AS px, p[1].y AS py, p[1].z AS pz, p[2].x - p[1].x AS ex, p[2].y - p[1].y AS ey, p[2].z - p[1].z AS ez, p[3].x - p[1].x AS fx, p[3].y - p[1].y AS fy, p[3].z - p[1].z AS fz FROM g WHERE len(p) = 3),
 n AS (SELECT *, ey * fz - ez * fy AS nx, ez * fx - ex * fz AS ny, ex * fy - ey * fx AS nz FROM e), u AS (SELECT h, px, py, pz, nx / s AS a, ny / s AS b, nz / s AS c FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS s FROM n) WHERE s > 1e-9), pl AS (SELECT h, a, b, c, -(a * px + b * py + c * pz) AS d FROM u),
 best AS (SELECT h, a, b, c, d, count(*) FILTER (abs(a * x + b * y + c * z + d) <= 0.05) AS inliers FROM p, pl GROUP BY ALL ORDER BY inliers DESC, h LIMIT 1), side AS (SELECT p.*, h, inliers, abs(a * x + b * y + c * z + d) <= 0.05 AS o FROM p, best),
 m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, y) AS yy, covar_pop(y, z) AS yz, covar_pop(z, z) AS zz FROM side WHERE o), t AS (SELECT *, yy * zz - yz * yz AS tx, xx * zz - xz * xz AS ty, xx * yy - xy * xy AS tz, xz * yz - xy * zz AS sxy, xy * yz - xz * yy AS sxz, xy * xz - yz * xx AS syz FROM m),
 w AS (SELECT mx, my, mz, CASE WHEN tx >= ty AND tx >= tz THEN tx WHEN ty >= tz THEN sxy ELSE sxz END AS a, CASE WHEN tx >= ty AND tx >= tz THEN sxy WHEN ty >= tz THEN ty ELSE syz END AS b, CASE WHEN tx >= ty AND tx >= tz THEN sxz WHEN ty >= tz THEN syz ELSE tz END AS c FROM t WHERE greatest(tx, ty, tz) > 0),
 f AS (SELECT mx, my, mz, a / s AS a, b / s AS b, c / s AS c FROM (SELECT *, sqrt(a * a + b * b + c * c) AS s FROM w)), hs AS (SELECT o, median(CASE WHEN sqrt(a * a + b * b) < 1e-6 THEN z ELSE a * x + b * y + c * z END) AS q FROM side, f GROUP BY o)
 SELECT CAST(h AS INT) AS h, round(f.a, 5) + 0.0::DOUBLE AS a, round(f.b, 5) + 0.0::DOUBLE AS b, round(f.c, 5) + 0.0::DOUBLE AS c, round(-(f.a * mx + f.b * my + f.c * mz), 5) + 0.0::DOUBLE AS d, inliers, coalesce((SELECT min(q) FROM hs WHERE NOT o) < (SELECT min(q) FROM hs WHERE o), false) AS flip FROM best, f""",
    "direction_vote": f"""WITH {VEC}, {A.sphere_sql(LEVEL)}, l AS (SELECT vec_id, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v) WHERE n > 1e-9),
 s AS (SELECT vec_id, l.x, l.y, l.z, q, round(abs(l.x * sphere.x + l.y * sphere.y + l.z * sphere.z), 9) AS d FROM l, sphere), l0 AS (SELECT vec_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, arg_max(q, (d, -q)) AS point FROM s GROUP BY vec_id),
"""
    + ",\n".join(
        f""" w{k} AS (SELECT point, count(*) AS votes FROM l{k} GROUP BY point ORDER BY votes DESC, point LIMIT 1), l{k + 1} AS (SELECT l{k}.* FROM l{k}, (SELECT sphere.* FROM w{k} JOIN sphere ON q = point) p WHERE abs(l{k}.x * p.x + l{k}.y * p.y + l{k}.z * p.z) < 0.95)"""
        for k in range(3)
    )
    + " SELECT 0 AS round, * FROM w0 UNION ALL SELECT 1, * FROM w1 UNION ALL SELECT 2, * FROM w2",
}
