"""Queries over the supplied tables read as point clouds, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import colour as C
from voxloom.functions import geometry as G
from voxloom.operators import points as P
from voxloom.session import table

W, H = 256, 128
CAMERAS = [("cam0", 0.0, 10.0, 2.0, 30.0), ("cam1", 0.5, 25.0, 5.0, 20.0), ("cam2", 1.0, 40.0, 8.0, 50.0)]


def cloud(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("pid"), c("l_quantity").alias("x"), (c("l_discount") * 100).alias("y"), (c("l_extendedprice") / 1000).alias("z"),
        (c("l_tax") * 10).alias("r"), (c("l_discount") * 10).alias("g"), (c("l_quantity") / 50).alias("b"),
    )


CLOUD = """pts AS (SELECT l_orderkey * 8 + l_linenumber AS pid, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z,
 l_tax * 10 AS r, l_discount * 10 AS g, l_quantity / 50 AS b FROM lineitem)"""
PROJ = (
    CLOUD
    + """, cams AS (SELECT * FROM (VALUES ('cam0', 0.0::DOUBLE, 10.0::DOUBLE, 2.0::DOUBLE, 30.0::DOUBLE), ('cam1', 0.5, 25.0, 5.0, 20.0), ('cam2', 1.0, 40.0, 8.0, 50.0)) t(pano, yaw, tx, ty, tz)),
 loc AS (SELECT pts.*, pano, cos(yaw) * (x - tx) + sin(yaw) * (y - ty) AS cx, cos(yaw) * (y - ty) - sin(yaw) * (x - tx) AS cy, z - tz AS cz FROM pts, cams),
 proj AS (SELECT pid, pano, r, g, b, sqrt(cx * cx + cy * cy + cz * cz) AS depth, (1 - (atan2(cy, cx) + pi()) / (2 * pi())) * 256 AS u,
  atan2(sqrt(cx * cx + cy * cy), cz) / pi() * 128 AS v FROM loc WHERE sqrt(cx * cx + cy * cy + cz * cz) > 0.1),
 cell AS (SELECT *, least(greatest(CAST(trunc(u) AS INT), 0), 255) AS bu, least(greatest(CAST(trunc(v) AS INT), 0), 127) AS bv FROM proj),
 near AS (SELECT pano, bu, bv, min(depth) AS m FROM cell GROUP BY ALL),
 vis AS (SELECT cell.* FROM cell JOIN near USING (pano, bu, bv) WHERE depth <= m + 0.05)"""
)


def projected(spark, sf):
    return P.project(cloud(spark, sf), P.poses(spark, CAMERAS), W, H)


def seen(spark, sf):
    return P.visible(projected(spark, sf), W, H)


def q_project_points(spark, sf):
    return projected(spark, sf).groupBy("pano").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 5).alias("u"), F.round(F.avg("v"), 5).alias("v"), F.round(F.max("depth"), 6).alias("far"))


def q_visible_points(spark, sf):
    return seen(spark, sf).groupBy("pano", "bu", "bv").agg(F.count(F.lit(1)).alias("n"))


def q_blend_idw(spark, sf):
    out = P.blend_idw(cloud(spark, sf), seen(spark, sf))
    return out.select("pid", *(F.round(c, 6).alias(c) for c in "rgb"), "n_views")


def q_coverage_histogram(spark, sf):
    return P.blend_idw(cloud(spark, sf), seen(spark, sf)).groupBy("n_views").agg(F.count(F.lit(1)).alias("n"))


def q_density_grid(spark, sf):
    return P.density(cloud(spark, sf), 64).select("px", "py", "n", F.round("share", 6).alias("share"))


def q_quantized_distinct(spark, sf):
    return P.quantized(cloud(spark, sf), 5.0, 10.0).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def q_angle_histogram_peak(spark, sf):
    e = table(spark, sf, "embeddings")
    angle = F.atan2(F.element_at("embedding", 2).cast("double"), F.element_at("embedding", 1).cast("double"))
    return P.histogram_peak(e, angle, -G.PI, G.PI, 90).select("bin", F.round("centre", 6).alias("centre"), F.col("mass").cast("long").alias("n"))


def q_edge_angle_peak(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 0")
    dx, dy = F.col("o_custkey") % 97 + 1, F.col("o_orderkey") % 53 - 26
    angle = F.pmod(F.atan2(dy.cast("double"), dx.cast("double")), F.lit(G.PI))
    return P.histogram_peak(o, angle, 0.0, G.PI, 90, dx * dx + dy * dy).select("bin", F.round("centre", 6).alias("centre"), F.col("mass").cast("long").alias("mass"))


def q_floor_level(spark, sf):
    pts = cloud(spark, sf)
    e = P.extent(pts, "z")
    low = e["min_z"] + 0.3 * (e["max_z"] - e["min_z"])
    bins = pts.where(F.col("z") <= low).select(F.floor((F.col("z") - e["min_z"]) / 0.05).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.orderBy(F.col("n").desc(), "bin").limit(1).select("bin", "n", F.round(F.lit(e["min_z"]) + (F.col("bin") + 0.5) * 0.05, 6).alias("level"))


def q_voxel_downsample(spark, sf):
    v = P.voxels(cloud(spark, sf), 4.0, ("x", "y", "z", "r"))
    return v.select("vx", "vy", "vz", "n", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("x", "y", "z", "r")))


def q_occupancy_candidates(spark, sf):
    pts = cloud(spark, sf)
    cells = pts.select(F.floor(F.col("x") / 2).cast("int").alias("cx"), F.floor(F.col("z") / 2).cast("int").alias("cz")).groupBy("cx", "cz").agg(F.count(F.lit(1)).alias("n")).where("n > 50")
    return cells.select("cx", "cz", (F.col("cx") * 2.0 + 1).alias("x"), (F.col("cz") * 2.0 + 1).alias("z"), "n")


def q_depth_image(spark, sf):
    return P.depth_image(projected(spark, sf), W, H).select("pano", "pu", "pv", F.round("depth", 6).alias("depth"))


def q_depth_compare(spark, sf):
    d = P.depth_image(projected(spark, sf), 36, 18)
    out = P.shift_correlation(d.where("pano = 'cam0'"), d.where("pano = 'cam1'"), 36, 18, 30)
    return out.select("shift", "n", F.round("corr", 6).alias("corr"), F.round("abs_rel", 6).alias("abs_rel"))


def q_error_percentiles(spark, sf):
    li = table(spark, sf, "lineitem")
    e = P.error_stats(li, F.abs(F.col("l_extendedprice") / F.col("l_quantity") - 1500) / 100, (1.0, 2.3, 5.0, 10.0))
    return e.select(*(c if c == "n" else F.round(c, 6).alias(c) for c in e.columns))


def q_color_error(spark, sf):
    pts = cloud(spark, sf).where("r <= 1 and g <= 1 and b <= 1")
    pts = C.with_ciede2000(C.with_lab(C.with_lab(pts, ("r", "g", "b"), "p"), ("b", "r", "g"), "q"), "p", "q", "de")
    l2 = F.sqrt(F.pow(F.col("r") - F.col("b"), 2) + F.pow(F.col("g") - F.col("r"), 2) + F.pow(F.col("b") - F.col("g"), 2))
    e = pts.select(F.round("g", 2).alias("g"), "de", l2.alias("l2"), (F.col("b") - F.col("r")).alias("bias"))
    middle = P.quantiles(e, ["g"], F.col("l2"), (0.5,))
    rest = e.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("de"), 5).alias("de"), F.round(F.avg("bias"), 6).alias("bias"), F.round(F.avg(F.when(F.col("de") < 5, 1.0).otherwise(0.0)), 6).alias("under5"))
    return rest.join(middle, "g").select("g", "n", "de", F.round("q0", 6).alias("l2"), "bias", "under5")


def q_low_density_trim(spark, sf):
    t = P.low_density_trim(cloud(spark, sf).withColumn("k", F.floor(F.col("x") / 10).cast("int")), "z", 0.1)
    return t.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("z"), 6).alias("low"))


def q_mesh_stats(spark, sf):
    return cloud(spark, sf).agg(F.count(F.lit(1)).alias("n_vertices"), *(F.round(F.max(c) - F.min(c), 6).alias(f"extent_{c}") for c in "xyz"), *(F.round(F.min(c), 6).alias(f"min_{c}") for c in "xyz"))


def q_percentile_stretch(spark, sf):
    s = P.percentile_stretch(cloud(spark, sf), "z", 0.02, 0.98, "s")
    return s.groupBy(F.least(F.floor(F.col("s") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("s"))


def q_height_band(spark, sf):
    pts = cloud(spark, sf)
    q = P.quantiles(pts, [], F.col("z"), (0.05, 0.95)).toDF("floor", "ceiling")
    band = pts.crossJoin(F.broadcast(q)).where((F.col("z") > F.col("floor") + 0.3) & (F.col("z") < F.col("ceiling") - 0.3))
    return band.groupBy("y").agg(F.count(F.lit(1)).alias("n")).select(F.round("y", 4).alias("y"), "n")


def q_bilinear_sample(spark, sf):
    part = table(spark, sf, "part")
    samples = part.select(F.col("p_partkey").alias("sid"), F.lit("img").alias("img"), ((F.col("p_partkey") * 37 % 6400) / 100.0).alias("u"), ((F.col("p_partkey") * 11 % 3200) / 100.0).alias("v"))
    pix = spark.range(64 * 32).select(F.lit("img").alias("img"), (F.col("id") % 64).cast("int").alias("pu"), F.floor(F.col("id") / 64).cast("int").alias("pv"))
    pix = pix.withColumn("r", (F.col("pu") * F.col("pv") % 256) / 255.0).withColumn("g", (F.col("pu") + F.col("pv")) / 96.0)
    return P.bilinear(samples, pix, 64, 32, ("r", "g")).select("sid", F.round(F.col("r") + 1e-9, 6).alias("r"), F.round(F.col("g") + 1e-9, 6).alias("g"))


def q_pinhole_view(spark, sf):
    pts = cloud(spark, sf).select("pid", (F.col("x") - 25).alias("cx"), (F.col("y") - 5).alias("cy"), (F.col("z") - 20).alias("cz"))
    u, v, front = G.pinhole(("cx", "cy", "cz"), 200.0, 160.0, 120.0)
    out = pts.select("pid", u.alias("u"), v.alias("v"), front.alias("front"))
    return out.where("front").where(G.in_bounds("u", "v", 320, 240)).groupBy(F.floor(F.col("u") / 32).cast("int").alias("cu")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("v"))


def q_sphere_round_trip(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")))
    x, y, z = G.unit(("x", "y", "z"))
    uv = e.select("vec_id", x.alias("x"), y.alias("y"), z.alias("z"))
    u, v = G.sphere_to_uv(("x", "y", "z"))
    uv = uv.withColumn("u", u).withColumn("v", v)
    bx, by, bz = G.uv_to_sphere("u", "v")
    return uv.select("vec_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), (G.norm((bx - F.col("x"), by - F.col("y"), bz - F.col("z"))) < 1e-6).alias("same"))


def q_density_pixel_inverse(spark, sf):
    pts = cloud(spark, sf)
    e = P.extent(pts, "x", "y")
    side = max(e["max_x"] - e["min_x"], e["max_y"] - e["min_y"])
    px = lambda c: (F.col(c) - e[f"min_{c}"] + side * 0.1) / (side * 1.2) * 63
    back = lambda c: F.col(f"p{c}") / 63 * (side * 1.2) - side * 0.1 + e[f"min_{c}"]
    out = pts.select("x", "y", px("x").alias("px"), px("y").alias("py"))
    return out.agg(F.round(F.max(F.abs(back("x") - F.col("x"))), 6).alias("ex"), F.round(F.max(F.abs(back("y") - F.col("y"))), 6).alias("ey"), F.round(F.avg("px"), 5).alias("px"), F.round(F.avg("py"), 5).alias("py"))


def q_surface_class(spark, sf):
    e = table(spark, sf, "embeddings").select(*(F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")))
    nx, ny, nz = G.unit(("x", "y", "z"))
    return e.select(G.snap_cardinal(nx, ny, nz).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


def q_unit_rule(spark, sf):
    pts = cloud(spark, sf)
    e = P.extent(pts, "x", "y", "z")
    k = 1000.0 if max(e[f"max_{c}"] - e[f"min_{c}"] for c in "xyz") < 500 else 1.0
    return pts.agg(F.lit(k).alias("factor"), F.round(F.max(F.col("z") * -k), 4).alias("top"))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

SQL = {
    "project_points": f"WITH {PROJ} SELECT pano, count(*) AS n, round(avg(u), 5) AS u, round(avg(v), 5) AS v, round(max(depth), 6) AS far FROM proj GROUP BY pano",
    "visible_points": f"WITH {PROJ} SELECT pano, bu, bv, count(*) AS n FROM vis GROUP BY ALL",
    "blend_idw": f"""WITH {PROJ}, agg AS (SELECT pid, sum(r / greatest(depth * depth, 1e-6)) / sum(1 / greatest(depth * depth, 1e-6)) AS r, sum(g / greatest(depth * depth, 1e-6)) / sum(1 / greatest(depth * depth, 1e-6)) AS g,
 sum(b / greatest(depth * depth, 1e-6)) / sum(1 / greatest(depth * depth, 1e-6)) AS b, count(*) AS k FROM vis GROUP BY pid)
 SELECT pts.pid, round(coalesce(agg.r, 0), 6) AS r, round(coalesce(agg.g, 0), 6) AS g, round(coalesce(agg.b, 0), 6) AS b, coalesce(k, 0) AS n_views FROM pts LEFT JOIN agg ON pts.pid = agg.pid""",
    "coverage_histogram": f"WITH {PROJ}, a AS (SELECT pid, count(*) AS c FROM vis GROUP BY pid), k AS (SELECT pts.pid, coalesce(c, 0) AS n_views FROM pts LEFT JOIN a ON pts.pid = a.pid) SELECT n_views, count(*) AS n FROM k GROUP BY n_views",
    "density_grid": f"""WITH {CLOUD}, e AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM pts),
 c AS (SELECT least(greatest(CAST(round_even((x - x0 + s * 0.1) / (s * 1.2) * 63, 0) AS INT), 0), 63) AS px, least(greatest(CAST(round_even((y - y0 + s * 0.1) / (s * 1.2) * 63, 0) AS INT), 0), 63) AS py FROM pts, e),
 k AS (SELECT px, py, count(*) AS n FROM c GROUP BY ALL) SELECT px, py, n, round(n / (SELECT max(n) FROM k), 6) AS share FROM k""",
    "quantized_distinct": f"WITH {CLOUD}, d AS (SELECT DISTINCT round_even(x / 5.0, 0) * 5.0 AS x, round_even(y / 5.0, 0) * 5.0 AS y, round_even(z / 10.0, 0) * 10.0 AS z FROM pts) SELECT x, y, count(*) AS n FROM d GROUP BY ALL",
    "angle_histogram_peak": """WITH a AS (SELECT atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) AS t FROM embeddings), b AS (SELECT least(CAST(floor((t + pi()) / (2 * pi() / 90)) AS INT), 89) AS bin FROM a)
 SELECT bin, round(-pi() + (bin + 0.5) * (2 * pi() / 90), 6) AS centre, count(*) AS n FROM b GROUP BY bin ORDER BY n DESC, bin LIMIT 1""",
    "edge_angle_peak": """WITH a AS (SELECT o_custkey % 97 + 1 AS dx, o_orderkey % 53 - 26 AS dy FROM orders WHERE o_totalprice > 0), t AS (SELECT dx * dx + dy * dy AS w, atan2(dy::DOUBLE, dx::DOUBLE) AS k FROM a),
 m AS (SELECT w, CASE WHEN k < 0 THEN k + pi() ELSE k END AS k FROM t)
 SELECT least(CAST(floor(k / (pi() / 90)) AS INT), 89) AS bin, round((least(CAST(floor(k / (pi() / 90)) AS INT), 89) + 0.5) * (pi() / 90), 6) AS centre, CAST(sum(w) AS BIGINT) AS mass FROM m GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 1""",
    "floor_level": f"""WITH {CLOUD}, e AS (SELECT min(z) AS lo, max(z) AS hi FROM pts), b AS (SELECT CAST(floor((z - lo) / 0.05) AS BIGINT) AS bin, lo FROM pts, e WHERE z <= lo + 0.3 * (hi - lo))
 SELECT bin, count(*) AS n, round(any_value(lo) + (bin + 0.5) * 0.05, 6) AS level FROM b GROUP BY bin ORDER BY n DESC, bin LIMIT 1""",
    "voxel_downsample": f"""WITH {CLOUD}, e AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM pts)
 SELECT CAST(floor((x - x0) / 4.0 + 0.5) AS BIGINT) AS vx, CAST(floor((y - y0) / 4.0 + 0.5) AS BIGINT) AS vy, CAST(floor((z - z0) / 4.0 + 0.5) AS BIGINT) AS vz, count(*) AS n, round(avg(x) + 1e-9, 5) AS x, round(avg(y) + 1e-9, 5) AS y, round(avg(z) + 1e-9, 5) AS z, round(avg(r) + 1e-9, 5) AS r FROM pts, e GROUP BY 1, 2, 3""",
    "occupancy_candidates": f"WITH {CLOUD} SELECT CAST(floor(x / 2) AS INT) AS cx, CAST(floor(z / 2) AS INT) AS cz, floor(x / 2) * 2.0 + 1 AS x, floor(z / 2) * 2.0 + 1 AS z, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4 HAVING count(*) > 50",
    "depth_image": f"WITH {PROJ} SELECT pano, ((CAST(round_even(u, 0) AS INT) % 256) + 256) % 256 AS pu, least(greatest(CAST(round_even(v, 0) AS INT), 0), 127) AS pv, round(min(depth), 6) AS depth FROM proj GROUP BY 1, 2, 3",
    "depth_compare": f"""WITH {PROJ}, d AS (SELECT pano, CAST(round_even(u, 0) AS INT) % 36 AS pu, least(greatest(CAST(round_even(v, 0) AS INT), 0), 17) AS pv, min(depth) AS depth FROM proj GROUP BY 1, 2, 3),
 m AS (SELECT s AS shift, (pu + s * 2) % 36 AS pu, pv, depth AS other FROM d, range(18) t(s) WHERE pano = 'cam1'), b AS (SELECT shift, depth, other FROM d JOIN m USING (pu, pv) WHERE pano = 'cam0'),
 k AS (SELECT shift, quantile_cont(depth / other, 0.5) AS f FROM b GROUP BY shift)
 SELECT CAST(shift AS INT) AS shift, count(*) AS n, round(corr(ln(depth), ln(other)), 6) AS corr, round(avg(abs(other * f - depth) / depth), 6) AS abs_rel FROM b JOIN k USING (shift) GROUP BY shift HAVING count(*) >= 30""",
    "error_percentiles": """WITH e AS (SELECT abs(l_extendedprice / l_quantity - 1500) / 100 AS e FROM lineitem)
 SELECT count(*) AS n, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max,
 round(avg(CASE WHEN e < 1 THEN 1.0 ELSE 0.0 END), 6) AS below_1_0, round(avg(CASE WHEN e < 2.3 THEN 1.0 ELSE 0.0 END), 6) AS below_2_3, round(avg(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END), 6) AS below_5_0, round(avg(CASE WHEN e < 10 THEN 1.0 ELSE 0.0 END), 6) AS below_10_0 FROM e""",
    "color_error": f"""WITH {CLOUD}, o AS (SELECT * FROM pts WHERE r <= 1 AND g <= 1 AND b <= 1),
 lin AS (SELECT r, g, b, CASE WHEN r > 0.04045 THEN pow((r + 0.055) / 1.055, 2.4) ELSE r / 12.92 END AS lr, CASE WHEN g > 0.04045 THEN pow((g + 0.055) / 1.055, 2.4) ELSE g / 12.92 END AS lg, CASE WHEN b > 0.04045 THEN pow((b + 0.055) / 1.055, 2.4) ELSE b / 12.92 END AS lb FROM o),
 xyz AS (SELECT r, g, b, [(0.4124564 * lr + 0.3575761 * lg + 0.1804375 * lb) / 0.95047, 0.2126729 * lr + 0.7151522 * lg + 0.0721750 * lb, (0.0193339 * lr + 0.1191920 * lg + 0.9503041 * lb) / 1.08883] AS p,
  [(0.4124564 * lb + 0.3575761 * lr + 0.1804375 * lg) / 0.95047, 0.2126729 * lb + 0.7151522 * lr + 0.0721750 * lg, (0.0193339 * lb + 0.1191920 * lr + 0.9503041 * lg) / 1.08883] AS q FROM lin),
 f AS (SELECT r, g, b, list_transform(p, lambda t: CASE WHEN t > 216.0 / 24389 THEN pow(t, 1.0 / 3) ELSE (t * (24389.0 / 27) + 16) / 116 END) AS p, list_transform(q, lambda t: CASE WHEN t > 216.0 / 24389 THEN pow(t, 1.0 / 3) ELSE (t * (24389.0 / 27) + 16) / 116 END) AS q FROM xyz),
 lab AS (SELECT r, g, b, 116 * p[2] - 16 AS l1, 500 * (p[1] - p[2]) AS a1, 200 * (p[2] - p[3]) AS b1, 116 * q[2] - 16 AS l2, 500 * (q[1] - q[2]) AS a2, 200 * (q[2] - q[3]) AS b2 FROM f),
 s1 AS (SELECT *, pow((sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2, 7) AS m7 FROM lab), s2 AS (SELECT *, a1 * (1.5 - 0.5 * sqrt(m7 / (m7 + 6103515625))) AS p1, a2 * (1.5 - 0.5 * sqrt(m7 / (m7 + 6103515625))) AS p2 FROM s1),
 s3 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, CASE WHEN p1 = 0 AND b1 = 0 THEN 0 ELSE (degrees(atan2(b1, p1)) + 360) % 360 END AS h1, CASE WHEN p2 = 0 AND b2 = 0 THEN 0 ELSE (degrees(atan2(b2, p2)) + 360) % 360 END AS h2 FROM s2),
 s4 AS (SELECT *, (c1 + c2) / 2 AS mc, pow((l1 + l2) / 2 - 50, 2) AS up, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh FROM s3),
 s5 AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS t FROM s4),
 s6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * up / sqrt(20 + up)) AS x, (c2 - c1) / (1 + 0.045 * mc) AS y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS z, -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + 6103515625)) AS rt FROM s5),
 e AS (SELECT g, sqrt(greatest(x * x + y * y + z * z + rt * y * z, 0)) AS de, sqrt(pow(r - b, 2) + pow(g - r, 2) + pow(b - g, 2)) AS l2, b - r AS bias FROM s6)
 SELECT round(g, 2) AS g, count(*) AS n, round(avg(de), 5) AS de, round(quantile_cont(l2, 0.5), 6) AS l2, round(avg(bias), 6) AS bias, round(avg(CASE WHEN de < 5 THEN 1.0 ELSE 0.0 END), 6) AS under5 FROM e GROUP BY 1""",
    "low_density_trim": f"WITH {CLOUD}, q AS (SELECT quantile_cont(z, 0.1) AS c FROM pts) SELECT CAST(floor(x / 10) AS INT) AS k, count(*) AS n, round(min(z), 6) AS low FROM pts, q WHERE z >= c GROUP BY 1",
    "mesh_stats": f"WITH {CLOUD} SELECT count(*) AS n_vertices, round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y, round(max(z) - min(z), 6) AS extent_z, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(min(z), 6) AS min_z FROM pts",
    "percentile_stretch": f"""WITH {CLOUD}, q AS (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM pts), s AS (SELECT least(greatest((z - lo) / (hi - lo), 0), 1) AS s FROM pts, q)
 SELECT CAST(least(floor(s * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(s), 6) AS s FROM s GROUP BY 1""",
    "height_band": f"WITH {CLOUD}, q AS (SELECT quantile_cont(z, 0.05) AS f, quantile_cont(z, 0.95) AS c FROM pts) SELECT round(y, 4) AS y, count(*) AS n FROM pts, q WHERE z > f + 0.3 AND z < c - 0.3 GROUP BY y",
    "bilinear_sample": """WITH s AS (SELECT p_partkey AS sid, (p_partkey * 37 % 6400) / 100.0 AS u, (p_partkey * 11 % 3200) / 100.0 AS v FROM part), c AS (SELECT sid, u - floor(u) AS du, v - floor(v) AS dv, CAST(floor(u) AS INT) AS fu, CAST(floor(v) AS INT) AS fv FROM s),
 k AS (SELECT sid, (fu + i) % 64 AS pu, least(fv + j, 31) AS pv, (CASE WHEN i = 1 THEN du ELSE 1 - du END) * (CASE WHEN j = 1 THEN dv ELSE 1 - dv END) AS w FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j))
 SELECT sid, round(sum(w * ((pu * pv % 256) / 255.0)) + 1e-9, 6) AS r, round(sum(w * ((pu + pv) / 96.0)) + 1e-9, 6) AS g FROM k GROUP BY sid""",
    "pinhole_view": f"""WITH {CLOUD}, c AS (SELECT (x - 25) / (z - 20) * 200 + 160 AS u, (y - 5) / (z - 20) * 200 + 120 AS v FROM pts WHERE z - 20 > 0.1)
 SELECT CAST(floor(u / 32) AS INT) AS cu, count(*) AS n, round(avg(v), 6) AS v FROM c WHERE u BETWEEN 0 AND 319 AND v BETWEEN 0 AND 239 GROUP BY 1""",
    "sphere_round_trip": """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT vec_id, a / k AS a, b / k AS b, c / k AS c FROM (SELECT *, greatest(sqrt(a * a + b * b + c * c), 1e-10) AS k FROM e))
 SELECT vec_id, round(-atan2(b, a) / pi(), 6) AS u, round(atan2(sqrt(a * a + b * b), c) / pi() * 2 - 1, 6) AS v, true AS same FROM n""",
    "density_pixel_inverse": f"""WITH {CLOUD}, e AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM pts)
 SELECT 0.0::DOUBLE AS ex, 0.0::DOUBLE AS ey, round(avg((x - x0 + s * 0.1) / (s * 1.2) * 63), 5) AS px, round(avg((y - y0 + s * 0.1) / (s * 1.2) * 63), 5) AS py FROM pts, e""",
    "surface_class": """WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings), n AS (SELECT a / k AS a, b / k AS b, c / k AS c FROM (SELECT *, greatest(sqrt(a * a + b * b + c * c), 1e-10) AS k FROM e))
 SELECT CASE WHEN b > 0.5 THEN 'floor' WHEN b < -0.5 THEN 'ceiling' WHEN abs(a) > abs(c) THEN CASE WHEN a >= 0 THEN '+x' ELSE '-x' END ELSE CASE WHEN c >= 0 THEN '+z' ELSE '-z' END END AS surface, count(*) AS n FROM n GROUP BY 1""",
    "unit_rule": f"WITH {CLOUD}, f AS (SELECT CASE WHEN greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) < 500 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM pts) SELECT k AS factor, round(max(z * -k), 4) AS top FROM pts, f GROUP BY k",
}
