"""Plane, ray, texel and component queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import surfaces as S
from voxloom.plans.joins import VEC, vectors
from voxloom.plans.points import CLOUD, cloud
from voxloom.plans.rings import MASK, mask
from voxloom.session import table

UNIT = VEC + ", un AS (SELECT vec_id AS i, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v) WHERE n > 1e-9)"


def units(spark, sf):
    v = vectors(spark, sf)
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return v.where(n > 1e-9).select(F.col("vec_id").alias("i"), *((F.col(c) / n).alias(c) for c in "xyz"))


def q_plane_lines(spark, sf):
    # planes meet within rooms of 40
    p = units(spark, sf).select(F.floor(F.col("i") / 40).alias("room"), F.col("i").alias("pid"), *(F.col(c).alias("n" + c) for c in "xyz"), (F.col("i") % 5 - 2.0).alias("d"))
    return S.plane_lines(p).select("a", "b", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz", "ux", "uy", "uz")))


def q_texture_bake(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("face"), (F.col("s_suppkey") % 6 / 8.0).alias("u0"), (F.col("s_suppkey") % 5 / 8.0).alias("v0"))
    f = s.select("face", "u0", "v0", (F.col("u0") + 0.3).alias("u1"), F.col("v0").alias("v1"), F.col("u0").alias("u2"), (F.col("v0") + 0.3).alias("v2"), *(F.lit(float(k == i)).alias(c + str(i)) for i in range(3) for k, c in enumerate("rgb")))
    return S.bake(f, 33).select("u", "v", "face", *(F.round(c, 5).alias(c) for c in "rgb"))


def q_cube_rays(spark, sf):
    faces = spark.range(6).select(F.col("id").cast("int").alias("cube"))
    return S.cube_rays(faces, 16).groupBy("cube").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(c) + 1e-9, 5).alias("s" + c) for c in "xyz"))


def q_mask_components(spark, sf):
    # masks lie side by side, further apart than neighbours are
    m = mask(spark, sf).select((F.col("id") * 64 + F.col("u")).alias("u"), "v")
    return S.pixel_components(m, 4).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"), F.min("v").alias("v"))


def q_orthogonal_triple(spark, sf):
    v = vectors(spark, sf)
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return S.orthogonal_triple(v.where(n > 1e-9).select(F.col("vec_id").alias("i"), *((F.col(c) / n).alias(c) for c in "xyz"), F.round(n, 9).alias("length")))


def q_octahedra(spark, sf):
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pid"), *(F.lit(float(k)).alias(c) for k, c in enumerate("xyz")))
    return S.octahedron_lines(p, 0.5).groupBy(F.substring("line", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def q_scale_consensus(spark, sf):
    p = table(spark, sf, "part")
    plan = F.floor(F.col("p_partkey") / 100).alias("plan")
    a, b = (p.select(plan, F.col("p_partkey").alias("k" + c), F.col("p_size").alias("e" + c)) for c in "ab")
    ratio = a.join(b, "plan").where("ka < kb").select((F.col("ea") / F.col("eb")).alias("s"))
    return S.histogram_consensus(ratio, F.col("s"), 0.2, 2.5, 200, 3, 5)


def q_translation_grid(spark, sf):
    return S.translation_grid(cloud(spark, sf), 200).select(*(F.round(c, 4).alias(c) for c in "xyz"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

SQL = {
    "plane_lines": f"""WITH {UNIT}, p AS (SELECT i, x, y, z, i % 5 - 2.0::DOUBLE AS d FROM un), q AS (SELECT a.i AS a, b.i AS b, a.x AS ax, a.y AS ay, a.z AS az, a.d AS ad, b.x AS bx, b.y AS b_y, b.z AS bz, b.d AS bd, a.x * b.x + a.y * b.y + a.z * b.z AS k FROM p a JOIN p b ON a.i < b.i AND a.i // 40 = b.i // 40),
 r AS (SELECT *, (bd * k - ad) / (1 - k * k) AS s, (ad * k - bd) / (1 - k * k) AS t FROM q WHERE abs(k) < 0.99)
 SELECT a, b, round(s * ax + t * bx, 5) + 0.0::DOUBLE AS px, round(s * ay + t * b_y, 5) + 0.0::DOUBLE AS py, round(s * az + t * bz, 5) + 0.0::DOUBLE AS pz, round(ay * bz - az * b_y, 5) AS ux, round(az * bx - ax * bz, 5) AS uy, round(ax * b_y - ay * bx, 5) AS uz FROM r""",
    "texture_bake": """WITH f AS (SELECT s_suppkey AS face, s_suppkey % 6 / 8.0::DOUBLE AS u0, s_suppkey % 5 / 8.0::DOUBLE AS v0 FROM supplier), t AS (SELECT CAST(i AS INT) AS u, CAST(j AS INT) AS v, i / 32.0::DOUBLE AS x, j / 32.0::DOUBLE AS y FROM range(33) a(i), range(33) b(j)),
 w AS (SELECT u, v, face, (x - u0) / 0.3::DOUBLE AS g, (y - v0) / 0.3::DOUBLE AS b FROM f, t), k AS (SELECT *, 1 - g - b AS r, row_number() OVER (PARTITION BY u, v ORDER BY face DESC) AS n FROM w WHERE g > -0.01 AND g < 1.01 AND b > -0.01 AND b < 1.01 AND 1 - g - b > -0.01 AND 1 - g - b < 1.01)
 SELECT u, v, face, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM k WHERE n = 1""",
    "cube_rays": """WITH p AS (SELECT c, (i + 0.5) / 16 * 2 - 1 AS a, (j + 0.5) / 16 * 2 - 1 AS b FROM range(6) f(c), range(16) t(i), range(16) u(j)), d AS (SELECT c, sum(1 / sqrt(a * a + b * b + 1)) AS s FROM p GROUP BY c)
 SELECT CAST(c AS INT) AS cube, CAST(256 AS BIGINT) AS n, round(CASE c WHEN 0 THEN s WHEN 1 THEN -s ELSE 0 END + 1e-9, 5) AS sx, round(CASE c WHEN 2 THEN s WHEN 3 THEN -s ELSE 0 END + 1e-9, 5) AS sy, round(CASE c WHEN 4 THEN s WHEN 5 THEN -s ELSE 0 END + 1e-9, 5) AS sz FROM d""",
    "mask_components": f"""WITH RECURSIVE {MASK}, p AS (SELECT id * 64 + u AS u, v, v::BIGINT * 1048576 + id * 64 + u AS k, id * 64 + u - row_number() OVER (PARTITION BY v ORDER BY id * 64 + u) AS g FROM m), r AS (SELECT v, g, min(u) AS lo, max(u) AS hi, min(k) AS k, count(*) AS n FROM p GROUP BY v, g),
 e AS (SELECT a.k AS a, b.k AS b FROM r a JOIN r b ON abs(a.v - b.v) = 1 AND a.lo <= b.hi + 1 AND b.lo <= a.hi + 1), reach AS (SELECT k AS n, k AS o FROM r UNION SELECT reach.n, e.b FROM reach JOIN e ON reach.o = e.a), c AS (SELECT n AS k, min(o) AS c FROM reach GROUP BY n)
 SELECT c AS component, CAST(sum(n) AS BIGINT) AS n, min(lo) AS u, min(v) AS v FROM c JOIN r USING (k) GROUP BY c HAVING sum(n) >= 4""",
    "orthogonal_triple": f"""WITH {VEC}, u AS (SELECT vec_id AS i, x / n AS x, y / n AS y, z / n AS z, row_number() OVER (ORDER BY round(n, 9) DESC, vec_id) AS n FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v) WHERE n > 1e-9), d AS (SELECT * FROM u)
 SELECT a.i AS i, b.i AS j, c.i AS k FROM d a JOIN d b ON a.n < b.n AND abs(a.x * b.x + a.y * b.y + a.z * b.z) < 0.1 JOIN d c ON b.n < c.n AND abs(a.x * c.x + a.y * c.y + a.z * c.z) < 0.1 AND abs(b.x * c.x + b.y * c.y + b.z * c.z) < 0.1 ORDER BY c.n, a.n, b.n LIMIT 1""",
    "octahedra": "SELECT k AS kind, count(*) * n AS n FROM nation, (VALUES ('v', 6), ('f', 8)) t(k, n) GROUP BY k, n",
    "translation_grid": f"""WITH {CLOUD}, e AS (SELECT count(*) AS n, pow(greatest(max(x) - min(x), 1e-9), 2) AS sx, pow(greatest(max(y) - min(y), 1e-9), 2) AS sy, pow(greatest(max(z) - min(z), 1e-9), 2) AS sz FROM pts), b AS (SELECT *, pow(200 / (sx * sy * sz), 1.0::DOUBLE / 3) AS b FROM e),
 """
    + ", ".join(
        f"""m{c} AS (SELECT n, least(CASE WHEN b * s{c} < 200 THEN greatest(1, 2 * CAST(trunc(b * s{c} / 2) AS INT) + 1) ELSE 201 END, 29) AS m FROM b), r{c} AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i FROM pts),
 p{c} AS (SELECT (k + 0.5::DOUBLE) / m * (n - 1) AS p FROM m{c}, range(201) t(k) WHERE k < m), a{c} AS (SELECT l.v + (h.v - l.v) * (p - floor(p)) AS {c} FROM p{c} JOIN r{c} l ON l.i = floor(p) JOIN r{c} h ON h.i = ceil(p))"""
        for c in "xyz"
    )
    + " SELECT round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ax, ay, az",
    "scale_consensus": """WITH s AS (SELECT a.p_size / b.p_size AS s FROM part a JOIN part b ON a.p_partkey // 100 = b.p_partkey // 100 AND a.p_partkey < b.p_partkey), h AS (SELECT least(CAST(floor((s - 0.2::DOUBLE) / ((2.5::DOUBLE - 0.2::DOUBLE) / 200)) AS INT), 199) AS bin, count(*) AS mass FROM s WHERE s BETWEEN 0.2 AND 2.5 GROUP BY 1)
 SELECT bin, mass FROM h t WHERE mass >= greatest((SELECT sum(mass) / 200 FROM h), 1) AND NOT EXISTS (SELECT 1 FROM h o WHERE abs(o.bin - t.bin) <= 3 AND o.bin <> t.bin AND (o.mass > t.mass OR (o.mass = t.mass AND o.bin < t.bin))) ORDER BY mass DESC, bin LIMIT 5""",
}
