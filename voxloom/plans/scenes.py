"""Queries over scenes: rays, normals, dominant directions, vanishing points and pose refinement, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import arcs as A
from voxloom.operators import directions as D
from voxloom.operators import normals as N
from voxloom.operators import raycast as R
from voxloom.operators import refine as P
from voxloom.operators import surfaces as S
from voxloom.plans.joins import ARCS, arcs
from voxloom.plans.surfaces import UNIT, units
from voxloom.session import stored, table

VOXEL = 2.0
#: Largest distance to an opposite wall and to an opposite floor or ceiling, and the step off the wall.
WALL_REACH, HEIGHT_REACH, OFF_WALL = 20.0, 10.0, 0.02

TRIANGLES = """tri AS (SELECT face, ax, ay, az, ax + ex AS bx, ay + ey AS b_y, az + ez AS bz, ax + fx AS cx, ay + fy AS cy, az + fz AS cz, ex, ey, ez, fx, fy, fz FROM (SELECT p_partkey AS face,
 (p_partkey * 7919 % 400)::DOUBLE / 10 AS ax, (p_partkey * 7013 % 100)::DOUBLE / 10 AS ay, (p_partkey * 3571 % 400)::DOUBLE / 10 AS az,
 (p_partkey % 5 + 1)::DOUBLE AS ex, (p_partkey % 3)::DOUBLE AS ey, (p_partkey % 4)::DOUBLE / 2 AS ez, -(p_partkey % 2)::DOUBLE AS fx, (p_partkey % 7)::DOUBLE / 1.5::DOUBLE AS fy, (p_partkey % 6 + 1)::DOUBLE / 2 AS fz FROM part))"""


def triangles(spark, sf):
    """One triangle a part in a hall of 40 x 10 x 40, y up."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(
        k.alias("face"), (k * 7919 % 400 / 10.0).alias("ax"), (k * 7013 % 100 / 10.0).alias("ay"), (k * 3571 % 400 / 10.0).alias("az"),
        ((k % 5 + 1) / 1.0).alias("ex"), (k % 3 / 1.0).alias("ey"), (k % 4 / 2.0).alias("ez"), (-(k % 2) / 1.0).alias("fx"), (k % 7 / 1.5).alias("fy"), ((k % 6 + 1) / 2.0).alias("fz"),
    )
    return p.withColumns({q + c: F.col("a" + c) + F.col(d + c) for q, d in (("b", "e"), ("c", "f")) for c in "xyz"})


def q_ray_hits(spark, sf):
    k = F.col("c_custkey")
    rays = table(spark, sf, "customer").select(
        k.alias("ray"), (k * 331 % 400 / 10.0 + 0.013).alias("ox"), (k * 57 % 100 / 10.0 + 0.017).alias("oy"), (k * 173 % 400 / 10.0 + 0.019).alias("oz"),
        ((k % 9 - 4) / 4.0).alias("dx"), ((k % 11 - 5) / 5.0).alias("dy"), ((k % 5 - 2) / 2.0).alias("dz"),
    )
    return R.ray_hits(rays, triangles(spark, sf), VOXEL).select("ray", "face", F.round(F.col("t") + 1e-9, 6).alias("t"))


def q_opposite_surface(spark, sf):
    """Each face's opposite one: from walls along the snapped normal within 20, from floors up and from ceilings down within 10."""
    tri = triangles(spark, sf)
    n = G.unit(G.cross(("ex", "ey", "ez"), ("fx", "fy", "fz")))
    at = tri.select("face", *(((F.col("a" + c) + F.col("b" + c) + F.col("c" + c)) / 3).alias("m" + c) for c in "xyz"), *(v.alias("n" + c) for v, c in zip(n, "xyz", strict=True)))
    at = stored(at, "faces")
    kind = F.when(F.abs("ny") <= 0.5, "wall").otherwise(F.when(F.col("ny") > 0, "floor").otherwise("ceiling"))
    side = G.snap_cardinal("nx", "ny", "nz")
    at = at.withColumns({"kind": kind, "dx": F.when(side == "+x", 1.0).when(side == "-x", -1.0).otherwise(0.0), "dy": F.when(side == "floor", 1.0).when(side == "ceiling", -1.0).otherwise(0.0), "dz": F.when(side == "+z", 1.0).when(side == "-z", -1.0).otherwise(0.0)})
    off = F.when(F.col("kind") == "wall", OFF_WALL).otherwise(0.0)
    # stored: the rays are read twice
    rays = at.select(F.col("face").alias("ray"), "kind", off.alias("off"), *((F.col("m" + c) + off * F.col("d" + c)).alias("o" + c) for c in "xyz"), "dx", "dy", "dz")
    rays = stored(rays, "rays")
    hits = R.ray_hits(rays, tri, VOXEL, WALL_REACH)
    found = rays.select("ray", "kind", "off").join(hits, "ray").where(F.col("t") <= F.when(F.col("kind") == "wall", WALL_REACH).otherwise(HEIGHT_REACH))
    return found.select("ray", "kind", F.col("face").alias("opposite"), F.round(F.col("t") + F.col("off") + 1e-9, 6).alias("distance"))


#: Sides of the hall whose surface the cloud samples, the voxel it is thinned to, and the search radius.
HALL, THIN, RADIUS, NEAR = (12.0, 8.0, 4.0), 0.2, 0.5, 30


def hall(spark, sf):
    """(pid, x, y, z) of points on the six sides of a hall, one a voxel: side k of a line item is its partkey's remainder."""
    k = table(spark, sf, "lineitem").select((F.col("l_partkey") % 6).alias("side"), *(((F.col("l_orderkey") * a + F.col("l_linenumber") * b) % m / m).alias(n) for n, a, b, m in (("u", 7919, 1237, 10007), ("v", 4337, 2741, 9973))))
    axis, high = F.floor(F.col("side") / 2), (F.col("side") % 2).cast("double")
    at = [F.when(axis == 0, high).otherwise(F.col("u")), F.when(axis == 1, high).when(axis == 0, F.col("u")).otherwise(F.col("v")), F.when(axis == 2, high).otherwise(F.col("v"))]
    p = k.select("side", *((a * h).alias(c) for a, h, c in zip(at, HALL, "xyz", strict=True)))
    cell = [F.floor(F.col(c) / THIN) for c in "xyz"]
    thin = p.groupBy("side", *(c.alias("k" + n) for c, n in zip(cell, "xyz", strict=True))).agg(*(F.round(F.avg(c), 9).alias(c) for c in "xyz"))
    return thin.select((((F.col("side") * 1000 + F.col("kx")) * 1000 + F.col("ky")) * 1000 + F.col("kz")).alias("pid"), "side", *"xyz")


def q_oriented_normals(spark, sf):
    """Normals of a hall's surface with signs spread over it: of points further than the radius from every edge, by side."""
    cloud = hall(spark, sf)
    found = N.oriented_normals(cloud.select("pid", *"xyz"), NEAR, RADIUS).join(cloud, "pid")
    free = " AND ".join(f"({c} < 1e-9 OR {c} > {h - 1e-9} OR {c} BETWEEN {RADIUS} + 1e-6 AND {h - RADIUS} - 1e-6)" for c, h in zip("xyz", HALL, strict=True))
    return found.where(free).where("n >= 6").groupBy("side", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in D.N)).agg(F.count(F.lit(1)).alias("n"))


def patches(spark, sf):
    """Plane patches of scans of sixty, with their numbers of points."""
    v = table(spark, sf, "embeddings").select("vec_id", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")))
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return v.where(n > 1e-9).select(F.floor(F.col("vec_id") / 60).alias("scene"), F.col("vec_id").alias("pid"), *((F.col(c) / n).alias("n" + c) for c in "xyz"), (F.col("vec_id") % 9 + 1.0).alias("weight"))


def q_dominant_directions(spark, sf):
    """Average-link clusters of each scan's normals at 10 degrees, snapped to axes within 15."""
    found = D.dominant_directions(patches(spark, sf))
    return found.select("scene", "label", "n", "weight", *(F.round(c, 6).alias(c) for c in "xyz"), "snapped")


def q_vanishing_points(spark, sf):
    """Three vanishing points of all arcs, out of up to twenty rounds of votes on the half sphere of level 5."""
    found = D.vanishing_points([d for _, _, d in D.vote_rounds(arcs(spark, sf))])
    return spark.createDataFrame([(k, *d) for k, d in enumerate(found)], "k int, x double, y double, z double")


def q_vote_rounds(spark, sf):
    """The winner of each round and its votes."""
    return spark.createDataFrame([(k, q, n) for k, (q, n, _) in enumerate(D.vote_rounds(arcs(spark, sf)))], "round int, q int, votes long")


def pose_tables(spark, sf):
    """Panoramas (one a nation) with the true pose known: corners of the room (one a customer) and what the panorama sees of them.

    A corner of group k lies on two lines, one along each other axis; every fifth corner goes unseen.
    """
    k, pano = F.col("c_custkey"), F.col("c_nationkey")
    solid = table(spark, sf, "customer").select(
        pano.alias("pano"), k.alias("i"), (k % 3).alias("grp"), (k * 37 % 100 / 10.0).alias("x"), (k * 91 % 83 / 8.3).alias("y"), (k * 53 % 31 / 10.0).alias("z"), ((k + 1) % 3).alias("a"), ((k + 2) % 3).alias("b")
    )
    poses = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pano"), (5 + F.col("n_nationkey") % 3 * 0.3).alias("tx"), (5 - F.col("n_nationkey") % 4 * 0.2).alias("ty"), F.lit(1.5).alias("tz"), (F.col("n_nationkey") * 0.2 - 2.4).alias("yaw"), F.lit(0.05).alias("pitch"), F.lit(-0.03).alias("roll"))
    rot = G.rotation_from_ypr(*P.ANGLES)
    m = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
    posed = poses.select("*", *(rot[i][j].alias(m[i][j]) for i in range(3) for j in range(3)))
    seen = solid.where("i % 5 <> 0").join(posed, "pano")
    seen = seen.withColumns({"p" + c: v for c, v in zip("xyz", G.unit(G.world_to_camera(("x", "y", "z"), m, P.T)), strict=True)})
    flat = seen.select("pano", "i", "grp", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), (F.col("i") * 3 + F.col("a")).alias("a"), (F.col("i") * 3 + F.col("b")).alias("b"))
    # the circle of a line along axis c through the corner: the corner's direction times the turned axis
    lines = seen.select("pano", "i", "px", "py", "pz", *(x for r in m for x in r), F.explode(F.array("a", "b")).alias("axis"))
    along = [F.when(F.col("axis") == 0, F.col(m[i][0])).when(F.col("axis") == 1, F.col(m[i][1])).otherwise(F.col(m[i][2])) for i in range(3)]
    normal = G.unit(G.cross(("px", "py", "pz"), along))
    flat_lines = lines.select("pano", (F.col("i") * 3 + F.col("axis")).alias("line"), *(v.alias(c) for v, c in zip(normal, "xyz", strict=True)))
    solid_lines = poses.select("pano", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("line")).select("pano", "line", *((F.col("line") == j).cast("double").alias(c) for j, c in enumerate("xyz")))
    return poses, flat, solid, flat_lines, solid_lines


#: Offsets of the starts from the true pose: along x and y, and in yaw.
STARTS = ((0.25, -0.2, 0.02), (-0.3, 0.1, -0.03), (1.4, 1.2, 0.3))


def starts(poses):
    """Three starts a panorama."""
    off = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("dw")) for i, (a, b, w) in enumerate(STARTS))))
    return poses.withColumn("_o", off).select((F.col("pano") * 3 + F.col("_o.c")).cast("long").alias("cand"), "pano", (F.col("tx") + F.col("_o.dx")).alias("tx"), (F.col("ty") + F.col("_o.dy")).alias("ty"), "tz", (F.col("yaw") + F.col("_o.dw")).alias("yaw"), "pitch", "roll")


def q_pose_pairs(spark, sf):
    """Mutual nearest intersections of every start: in each group under 0.5 apart, and over all groups under 0.1."""
    poses, flat, solid, _, _ = pose_tables(spark, sf)
    found = P.pairs(stored(P.grouped(flat, solid), "groups"), starts(poses), 0.5)
    return found.groupBy("cand", "track").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("i2") * 7 + F.col("i3")).alias("ids"), F.round(F.sum(F.abs(F.col("px") - F.col("sx"))), 6).alias("off"))


def q_refined_poses(spark, sf):
    """Three starts near every true pose, refined by 100 steps of translation and 50 of rotation."""
    poses, *rest = pose_tables(spark, sf)
    found = P.refine_poses(starts(poses), *rest)
    return found.select("cand", "pano", *(F.round(c, 4).alias(c) for c in (*P.T, *P.ANGLES, "cost", "turn_cost", "moved", "turned")), "reverted", "n0", "n1", "n2")


#: Half the side of a plane's square, and the shortest crossing that is kept.
HALF, SHORTEST = 1.5, 0.1


def q_line_clip(spark, sf):
    """Crossing lines of the planes of a room, cut to what lies within the extents of both planes' corners; what is shorter than SHORTEST goes."""
    u = units(spark, sf).where("abs(z) < 0.999")
    planes = u.select(F.floor(F.col("i") / 40).alias("room"), F.col("i").alias("pid"), *(F.col(c).alias("n" + c) for c in "xyz"), (F.col("i") % 5 / 4.0 - 0.5).alias("d"))
    lines = S.plane_lines(planes)
    # corners of a square on the plane, around its point nearest the origin: one side level, one uphill
    side = G.unit(G.cross(("nx", "ny", "nz"), (0.0, 0.0, 1.0)))
    up = G.cross(("nx", "ny", "nz"), side)
    sign = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-HALF, HALF) for b in (-HALF, HALF))))
    corner = planes.withColumn("_s", sign).select("pid", *((-F.col("d") * F.col("n" + c) + F.col("_s.a") * side[k] + F.col("_s.b") * up[k]).alias("v" + c) for k, c in enumerate("xyz")))
    span = lambda p, lo, hi: lines.join(corner, F.col(p) == F.col("pid")).groupBy("a", "b").agg(*(f(G.dot(G.sub(("vx", "vy", "vz"), ("px", "py", "pz")), G.unit(("ux", "uy", "uz")))).alias(n) for f, n in ((F.min, lo), (F.max, hi))))
    both = span("a", "lo", "hi").join(span("b", "o_lo", "o_hi"), ["a", "b"])
    cut = both.select("a", "b", F.greatest("lo", "o_lo").alias("t0"), F.least("hi", "o_hi").alias("t1")).where(F.col("t1") - F.col("t0") >= SHORTEST)
    return cut.select("a", "b", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("t0", "t1")))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}


def hits_sql(rays: str, limit: str) -> str:
    """SQL of the nearest hit of every row of ``rays`` (ray, ox..dz) among all triangles."""
    return f"""met AS (SELECT *, ex * hx + ey * hy + ez * hz AS det FROM (SELECT *, dy * fz - dz * fy AS hx, dz * fx - dx * fz AS hy, dx * fy - dy * fx AS hz, sy * ez - sz * ey AS qx, sz * ex - sx * ez AS qy, sx * ey - sy * ex AS qz
 FROM (SELECT r.*, t.*, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM {rays} r, tri t))),
 hit AS (SELECT *, round((fx * qx + fy * qy + fz * qz) / det, 9) AS t FROM met WHERE abs(det) > 1e-9 AND (sx * hx + sy * hy + sz * hz) / det >= -1e-9 AND (dx * qx + dy * qy + dz * qz) / det >= -1e-9 AND (sx * hx + sy * hy + sz * hz) / det + (dx * qx + dy * qy + dz * qz) / det <= 1 + 1e-9),
 best AS (SELECT * FROM hit WHERE t > 1e-9 AND t <= {limit} QUALIFY row_number() OVER (PARTITION BY ray ORDER BY t, face) = 1)"""


_HALF = (10 * 4**5 + 2) // 2
ROUNDS_SQL = f"""{ARCS}, {A.sphere_sql(5)}, half AS MATERIALIZED (SELECT * FROM sphere WHERE q < {_HALF}), l0 AS MATERIALIZED (SELECT id, nx, ny, nz FROM arcs),
""" + ",\n".join(
    f""" w{k} AS MATERIALIZED (SELECT q, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, count(*) AS votes FROM l{k}, half WHERE abs(nx * x + ny * y + nz * z) < 0.05 GROUP BY q ORDER BY votes DESC, q LIMIT 1), l{k + 1} AS MATERIALIZED (SELECT l{k}.* FROM l{k}, w{k} WHERE abs(nx * x + ny * y + nz * z) > 0.05)"""
    for k in range(D.ROUNDS)
) + ", won AS (" + " UNION ALL ".join(f"SELECT {k}::INT AS round, * FROM w{k}" for k in range(D.ROUNDS)) + ")"
_FREE = " AND ".join(f"({c} < 1e-9 OR {c} > {h - 1e-9} OR {c} BETWEEN {RADIUS} + 1e-6 AND {h - RADIUS} - 1e-6)" for c, h in zip("xyz", HALL, strict=True))

_ROT = "cos({w}) * cos({p}) AS m00, cos({w}) * sin({p}) * sin({r}) - sin({w}) * cos({r}) AS m01, cos({w}) * sin({p}) * cos({r}) + sin({w}) * sin({r}) AS m02, sin({w}) * cos({p}) AS m10, sin({w}) * sin({p}) * sin({r}) + cos({w}) * cos({r}) AS m11, sin({w}) * sin({p}) * cos({r}) - cos({w}) * sin({r}) AS m12, -sin({p}) AS m20, cos({p}) * sin({r}) AS m21, cos({p}) * cos({r}) AS m22".format(w="yaw", p="pitch", r="roll")
_SEEN = "SELECT {keys}, cx / k AS x, cy / k AS y, cz / k AS z FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS k FROM (SELECT {keys}, " + ", ".join(f"m{r}0 * (x - tx) + m{r}1 * (y - ty) + m{r}2 * (z - tz) AS c{c}" for r, c in enumerate("xyz")) + " FROM solid JOIN {poses} USING (pano) {where}))"

SQL = {
    "pose_pairs": f"""WITH solid AS (SELECT c_nationkey AS pano, c_custkey AS i, c_custkey % 3 AS grp, (c_custkey * 37 % 100)::DOUBLE / 10 AS x, (c_custkey * 91 % 83)::DOUBLE / 8.3::DOUBLE AS y, (c_custkey * 53 % 31)::DOUBLE / 10 AS z FROM customer),
 poses AS (SELECT n_nationkey AS pano, 5 + n_nationkey % 3 * 0.3::DOUBLE AS tx, 5 - n_nationkey % 4 * 0.2::DOUBLE AS ty, 1.5::DOUBLE AS tz, n_nationkey * 0.2::DOUBLE - 2.4::DOUBLE AS yaw, 0.05::DOUBLE AS pitch, -0.03::DOUBLE AS roll FROM nation), true_pose AS (SELECT *, {_ROT} FROM poses),
 begun AS (SELECT pano, pano * 3 + c AS cand, tx + dx AS tx, ty + dy AS ty, tz, yaw + dw AS yaw, pitch, roll FROM poses, (VALUES {', '.join(f'({i}, {a}::DOUBLE, {b}::DOUBLE, {w}::DOUBLE)' for i, (a, b, w) in enumerate(STARTS))}) t(c, dx, dy, dw)), start AS (SELECT *, {_ROT} FROM begun),
 flat AS ({_SEEN.format(keys='pano, i, grp', poses='true_pose', where='WHERE i % 5 <> 0')}), seen AS ({_SEEN.format(keys='pano, cand, i, grp', poses='start', where='')}),
 d AS (SELECT cand, g = 3 AS whole, g, a.i AS i2, b.i AS i3, abs(a.x - b.x) AS off, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d FROM flat a JOIN seen b USING (pano), (VALUES (0), (1), (2), (3)) t(g) WHERE g = 3 OR (a.grp = g AND b.grp = g)),
 r AS (SELECT *, row_number() OVER (PARTITION BY cand, g, i2 ORDER BY d, i3) AS k2, row_number() OVER (PARTITION BY cand, g, i3 ORDER BY d, i2) AS k3 FROM d)
 SELECT cand, NOT whole AS track, count(*) AS n, sum(i2 * 7 + i3)::BIGINT AS ids, round(sum(off), 6) AS off FROM r WHERE k2 = 1 AND k3 = 1 AND d < CASE WHEN whole THEN 0.1 ELSE 0.5 END GROUP BY cand, whole""",
    "line_clip": f"""WITH {UNIT}, p AS (SELECT i, x, y, z, (i % 5)::DOUBLE / 4 - 0.5::DOUBLE AS d FROM un WHERE abs(z) < 0.999), q AS (SELECT a.i AS a, b.i AS b, a.x AS ax, a.y AS ay, a.z AS az, a.d AS ad, b.x AS bx, b.y AS b_y, b.z AS bz, b.d AS bd, a.x * b.x + a.y * b.y + a.z * b.z AS k FROM p a JOIN p b ON a.i < b.i AND a.i // 40 = b.i // 40),
 l AS (SELECT a, b, s * ax + t * bx AS px, s * ay + t * b_y AS py, s * az + t * bz AS pz, (ay * bz - az * b_y) / n AS ux, (az * bx - ax * bz) / n AS uy, (ax * b_y - ay * bx) / n AS uz FROM (SELECT *, (bd * k - ad) / (1 - k * k) AS s, (ad * k - bd) / (1 - k * k) AS t, greatest(sqrt(pow(ay * bz - az * b_y, 2) + pow(az * bx - ax * bz, 2) + pow(ax * b_y - ay * bx, 2)), 1e-10) AS n FROM q WHERE abs(k) < 0.99)),
 c AS (SELECT i, -d * x + e * y / h - f * z * x / h AS vx, -d * y - e * x / h - f * z * y / h AS vy, -d * z + f * h AS vz FROM (SELECT *, sqrt(x * x + y * y) AS h FROM p), (VALUES ({-HALF}::DOUBLE), ({HALF}::DOUBLE)) a(e), (VALUES ({-HALF}::DOUBLE), ({HALF}::DOUBLE)) b(f)),
 t AS (SELECT a, b, i = a AS own, min((vx - px) * ux + (vy - py) * uy + (vz - pz) * uz) AS lo, max((vx - px) * ux + (vy - py) * uy + (vz - pz) * uz) AS hi FROM l JOIN c ON c.i = l.a OR c.i = l.b GROUP BY a, b, i = a)
 SELECT a, b, round(t0, 5) + 0.0::DOUBLE AS t0, round(t1, 5) + 0.0::DOUBLE AS t1 FROM (SELECT a, b, max(lo) AS t0, min(hi) AS t1 FROM t GROUP BY a, b) WHERE t1 - t0 >= {SHORTEST}""",
    "oriented_normals": f"""WITH k AS (SELECT l_partkey % 6 AS side, ((l_orderkey * 7919 + l_linenumber * 1237) % 10007)::DOUBLE / 10007 AS u, ((l_orderkey * 4337 + l_linenumber * 2741) % 9973)::DOUBLE / 9973 AS v FROM lineitem),
 p AS (SELECT side, {HALL[0]}::DOUBLE * CASE WHEN side // 2 = 0 THEN side % 2 ELSE u END AS x, {HALL[1]}::DOUBLE * CASE side // 2 WHEN 1 THEN side % 2 WHEN 0 THEN u ELSE v END AS y, {HALL[2]}::DOUBLE * CASE WHEN side // 2 = 2 THEN side % 2 ELSE v END AS z FROM k),
 t AS (SELECT side, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z FROM p GROUP BY side, floor(x / {THIN}::DOUBLE), floor(y / {THIN}::DOUBLE), floor(z / {THIN}::DOUBLE)),
 f AS (SELECT *, row_number() OVER () AS i FROM t), c AS (SELECT a.i, count(*) AS n FROM f a JOIN f b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= {RADIUS * RADIUS} GROUP BY a.i)
 SELECT side, CASE side WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 1 ELSE 0 END AS nx, CASE side WHEN 2 THEN -1.0::DOUBLE WHEN 3 THEN 1 ELSE 0 END AS ny, CASE side WHEN 4 THEN -1.0::DOUBLE WHEN 5 THEN 1 ELSE 0 END AS nz, count(*) AS n FROM f JOIN c USING (i) WHERE {_FREE} AND n >= 6 GROUP BY side""",
    "vote_rounds": f"WITH {ROUNDS_SQL} SELECT round, q, votes FROM won",
    "vanishing_points": f"""WITH {ROUNDS_SQL}, c AS (SELECT a.round AS i, b.round AS j, c.round AS k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS b_y, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM won a JOIN won b ON a.round < b.round JOIN won c ON b.round < c.round),
 m AS (SELECT *, abs(ax * bx + ay * b_y + az * bz) AS ab, abs(bx * cx + b_y * cy + bz * cz) AS bc, abs(cx * ax + cy * ay + cz * az) AS ca FROM c), s AS (SELECT 0 AS way, i, j, k, 0 AS side, ax, ay, az, bx, b_y, bz, cx, cy, cz FROM m WHERE ab < 0.1 AND bc < 0.1 AND ca < 0.1
  UNION ALL SELECT 1, i, j, k, 0, ax, ay, az, bx, b_y, bz, NULL, NULL, NULL FROM m WHERE ab < 0.15 UNION ALL SELECT 1, i, j, k, 1, bx, b_y, bz, cx, cy, cz, NULL, NULL, NULL FROM m WHERE bc < 0.15 UNION ALL SELECT 1, i, j, k, 2, cx, cy, cz, ax, ay, az, NULL, NULL, NULL FROM m WHERE ca < 0.15
  UNION ALL SELECT 2, 0, 1, 0, 0, a.x, a.y, a.z, b.x, b.y, b.z, NULL, NULL, NULL FROM won a, won b WHERE a.round = 0 AND b.round = 1),
 t AS (SELECT ax, ay, az, bx, b_y, bz, coalesce(cx, ay * bz - az * b_y) AS cx, coalesce(cy, az * bx - ax * bz) AS cy, coalesce(cz, ax * b_y - ay * bx) AS cz FROM s ORDER BY way, i, j, k, side LIMIT 1),
 d AS (SELECT *, sign((ay * bz - az * b_y) * cx + (az * bx - ax * bz) * cy + (ax * b_y - ay * bx) * cz) AS s FROM t)
 SELECT 0::INT AS k, ax AS x, ay AS y, az AS z FROM d UNION ALL SELECT 1, bx, b_y, bz FROM d UNION ALL SELECT 2, CASE WHEN s < 0 THEN -cx ELSE cx END, CASE WHEN s < 0 THEN -cy ELSE cy END, CASE WHEN s < 0 THEN -cz ELSE cz END FROM d""",
    "ray_hits": f"""WITH {TRIANGLES}, rays AS (SELECT c_custkey AS ray, (c_custkey * 331 % 400)::DOUBLE / 10 + 0.013::DOUBLE AS ox, (c_custkey * 57 % 100)::DOUBLE / 10 + 0.017::DOUBLE AS oy, (c_custkey * 173 % 400)::DOUBLE / 10 + 0.019::DOUBLE AS oz,
 (c_custkey % 9 - 4)::DOUBLE / 4 AS dx, (c_custkey % 11 - 5)::DOUBLE / 5 AS dy, (c_custkey % 5 - 2)::DOUBLE / 2 AS dz FROM customer), {hits_sql("rays", "'inf'::DOUBLE")} SELECT ray, face, round(t + 1e-9, 6) AS t FROM best""",
    "opposite_surface": f"""WITH {TRIANGLES}, n AS (SELECT *, nx / k AS ux, ny / k AS uy, nz / k AS uz FROM (SELECT *, greatest(sqrt(nx * nx + ny * ny + nz * nz), 1e-10) AS k FROM (SELECT *, ey * fz - ez * fy AS nx, ez * fx - ex * fz AS ny, ex * fy - ey * fx AS nz FROM tri))),
 s AS (SELECT face AS ray, CASE WHEN abs(uy) <= 0.5 THEN 'wall' WHEN uy > 0 THEN 'floor' ELSE 'ceiling' END AS kind, (ax + bx + cx) / 3 AS mx, (ay + b_y + cy) / 3 AS my, (az + bz + cz) / 3 AS mz,
  CASE WHEN abs(uy) > 0.5 OR abs(ux) <= abs(uz) THEN 0.0::DOUBLE WHEN ux >= 0 THEN 1 ELSE -1 END AS dx, CASE WHEN uy > 0.5 THEN 1.0::DOUBLE WHEN uy < -0.5 THEN -1 ELSE 0 END AS dy, CASE WHEN abs(uy) > 0.5 OR abs(ux) > abs(uz) THEN 0.0::DOUBLE WHEN uz >= 0 THEN 1 ELSE -1 END AS dz FROM n),
 rays AS (SELECT ray, kind, o, mx + o * dx AS ox, my + o * dy AS oy, mz + o * dz AS oz, dx, dy, dz FROM (SELECT *, CASE WHEN kind = 'wall' THEN {OFF_WALL}::DOUBLE ELSE 0 END AS o FROM s)), {hits_sql("rays", f"CASE WHEN kind = 'wall' THEN {WALL_REACH} ELSE {HEIGHT_REACH} END")}
 SELECT ray, kind, face AS opposite, round(t + o + 1e-9, 6) AS distance FROM best""",
}
