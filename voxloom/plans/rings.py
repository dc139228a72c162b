"""Ring, sequence, raster, ranking and set queries over the supplied tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import rings as R
from voxloom.plans.points import CLOUD, cloud
from voxloom.session import table

RING = "ring AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, (o_orderkey % 101)::DOUBLE AS x, (o_orderkey % 67)::DOUBLE AS y FROM orders)"
HOUR = "h AS (SELECT event_type AS k, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2)"
MASK = "m AS (SELECT DISTINCT CAST(l_suppkey % 12 AS INT) AS id, CAST(l_quantity AS INT) AS u, CAST(l_partkey % 40 AS INT) AS v FROM lineitem)"


def ring(spark, sf):
    o = table(spark, sf, "orders")
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("k"), i.alias("i"), (F.col("o_orderkey") % 101).cast("double").alias("x"), (F.col("o_orderkey") % 67).cast("double").alias("y"))


def hourly(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("k"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def mask(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_suppkey") % 12).cast("int").alias("id"), F.col("l_quantity").cast("int").alias("u"), (F.col("l_partkey") % 40).cast("int").alias("v")).distinct()


def q_polygon_measures(spark, sf):
    m = R.ring_measures(ring(spark, sf), ["k"], "i", "x", "y")
    return m.select("k", "n", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("area", "perimeter", "mean_x", "mean_y", "width", "height", "spread")))


def q_min_area_box(spark, sf):
    n = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"))
    box = n.withColumn("i", F.explode(F.array(*map(F.lit, range(4))))).withColumn("a", (F.col("k") + 1) * 0.2)
    px, py = F.when(F.col("i").isin(1, 2), F.col("k") + 3.0).otherwise(0.0), F.when(F.col("i") >= 2, F.col("k") + 2.0).otherwise(0.0)
    pts = box.select("k", "i", (F.cos("a") * px - F.sin("a") * py).alias("x"), (F.sin("a") * px + F.cos("a") * py).alias("y"))
    return R.min_area_box(pts, ["k"], "i", "x", "y").select("k", F.round("area", 6).alias("area"), F.round(F.greatest("width", "height"), 6).alias("long_side"))


def q_polygon_transform(spark, sf):
    rings = ring(spark, sf).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r")).select("k", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    moved = rings.select("k", R.transform_ring(F.col("r"), 1.5, 0.3, 2.0, -1.0).alias("r"))
    return moved.select("k", F.explode("r").alias("p")).groupBy("k").agg(F.round(F.sum("p.x"), 5).alias("sx"), F.round(F.sum("p.y"), 5).alias("sy"), F.count(F.lit(1)).alias("n"))


def q_polygon_about_centroid(spark, sf):
    """Rings scaled and turned about the mean of their corners, which becomes the origin."""
    c = ring(spark, sf).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    turned = c.select("k", R.transform_about_mean(F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), 1.5, 0.3).alias("r"))
    return turned.select("k", F.posexplode("r").alias("i", "p")).select("k", "i", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def q_polygon_expand(spark, sf):
    rings = spark.sql("SELECT 0 AS k, array(struct(0.0D AS x, 0.0D AS y), struct(4.0D AS x, 0.0D AS y), struct(4.0D AS x, 3.0D AS y), struct(0.0D AS x, 3.0D AS y)) AS r")
    return rings.select("k", F.posexplode(R.expand_ring(F.col("r"), 0.5)).alias("i", "p")).select("i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def q_gap_fill_linear(spark, sf):
    h = hourly(spark, sf)
    full = h.groupBy("k").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("k", F.explode(F.sequence("a", "b")).alias("t"))
    filled = R.fill_gaps(full.join(h, ["k", "t"], "left"), ["k"], "t", "v", "f")
    return filled.select("k", "t", F.round("f", 6).alias("f"))


def q_median_filter_circular(spark, sf):
    v = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 96).cast("int").alias("u")).agg(F.max("l_extendedprice").alias("v")).withColumn("k", F.lit(0))
    return R.circular_median(v, ["k"], "u", 96, "v", 15, "m").select("u", F.round("m", 4).alias("m"))


def q_resample(spark, sf):
    v = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 96).cast("int").alias("u")).agg(F.max("l_extendedprice").alias("v")).withColumn("k", F.lit(0))
    return R.resample(v, ["k"], "u", "v", 95, 256).select("i", F.round("v", 4).alias("v"))


def q_fuse_boundaries(spark, sf):
    m = mask(spark, sf)
    low, high = R.column_edge(m.where("id < 6"), [], False), R.column_edge(m.where("id >= 6"), [], True)
    both = low.withColumnRenamed("edge", "a").join(high.withColumnRenamed("edge", "b"), "u", "full_outer")
    return both.select("u", F.least("a", "b").alias("edge"))


def q_sorted_gap_groups(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("v"))
    g = R.gap_groups(p, ["p_brand"], "v", 2.0)
    return g.groupBy("p_brand", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("v"), 4).alias("lo"), F.round(F.max("v"), 4).alias("hi"))


def q_local_maxima(spark, sf):
    h = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("k"), (F.col("l_partkey") % 60).alias("t")).agg(F.count(F.lit(1)).alias("v"))
    return R.local_maxima(h, ["k"], "t", "v")


def q_merge_collinear(spark, sf):
    r = ring(spark, sf).withColumn("d", (F.col("x") > 50).cast("int")).withColumn("w", F.col("y") + 1)
    m = R.merge_runs(r, ["k"], "i", "d", "w", ["x"])
    return m.select("k", "run", "d", F.round("w", 4).alias("w"), F.round("x", 5).alias("x"))


def q_corner_rebuild(spark, sf):
    r = ring(spark, sf).withColumns({"dx": F.col("i") % 3 - 1.0, "dy": F.col("i") % 2 + 0.5})
    n = R.ring_next(r, ["k"], "i", ["x", "y", "dx", "dy"])
    x, y = R.line_meet(("x", "y", "dx", "dy"), ("next_x", "next_y", "next_dx", "next_dy"))
    return n.select("k", "i", F.round(x, 5).alias("cx"), F.round(y, 5).alias("cy"))


#: Rounds that grow a texture over its gaps.
ROUNDS = 8


def q_dilate(spark, sf):
    m = mask(spark, sf).select("id", "u", "v", (F.col("u") + F.col("v")).cast("double").alias("c"))
    # whole numbers in every round, as in an image of bytes
    return R.dilate(m, ["id"], ["c"], 51, 40, ROUNDS, whole=True)


def q_mask_difference(spark, sf):
    m = mask(spark, sf)
    inside = m.where("id < 9").select("u", "v").distinct()
    return inside.join(m.where("id >= 9").select("u", "v"), ["u", "v"], "left_anti").groupBy("u").agg(F.count(F.lit(1)).alias("n"))


def q_mask_union(spark, sf):
    m = mask(spark, sf)
    parts = [m.where(F.col("id") % 4 == k).select((F.col("id") / 4).cast("int").alias("g"), "u", "v") for k in range(4)]
    # a set per group of four masks
    return reduce(DataFrame.union, parts).distinct().groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))


def q_mask_classes(spark, sf):
    m = mask(spark, sf)
    whole = m.select("u", "v").distinct().agg(F.count(F.lit(1)).alias("w"))
    c = m.groupBy("id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole))
    share, image = F.col("n") / F.col("w"), F.col("n") / 2000.0
    return c.select("id", "n", F.round(share, 6).alias("share"), F.when(image > 0.70, "junk").when(share > 0.85, "outline").otherwise("room").alias("class"))


def q_column_coverage(spark, sf):
    m = mask(spark, sf).groupBy("id", "u").agg((F.count(F.lit(1)) / 40).alias("share"))
    return m.where("share > 0.6").groupBy("id").agg(F.count(F.lit(1)).alias("n_columns"), F.round(F.max("share"), 4).alias("top"))


def q_column_boundary(spark, sf):
    m = mask(spark, sf)
    return R.column_edge(m, ["id"], True).withColumnRenamed("edge", "first").join(R.column_edge(m, ["id"], False).withColumnRenamed("edge", "last"), ["id", "u"])


def q_largest_mask(spark, sf):
    return mask(spark, sf).groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col("id")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("id"), F.col("m.n").alias("n"))


def q_azimuth_max(spark, sf):
    pts = cloud(spark, sf).select((F.col("x") - 25).alias("x"), (F.col("y") - 5).alias("y"), F.col("r"))
    a = F.least(F.floor((F.atan2("y", "x") + G.PI) / (2 * G.PI / 64)), F.lit(63)).cast("int")
    return pts.select(a.alias("bin"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("d")).groupBy("bin").agg(F.round(F.max("d"), 6).alias("far"), F.count(F.lit(1)).alias("n"))


def q_circular_shift(spark, sf):
    return mask(spark, sf).select("id", F.pmod(F.col("u") + 37, F.lit(51)).alias("u"), "v").groupBy("id", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))


def q_intersection_groups(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 3).alias("pair"))
    return s.withColumn("grp", F.explode(F.array(F.col("pair"), (F.col("pair") + 1) % 3))).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("s"))


def q_top_k_longest(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("length")).orderBy(F.col("length").desc(), "o_orderkey").limit(25)


def q_top_k_diverse(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 24).alias("r"), F.col("o_orderkey").alias("t"), F.round("o_totalprice", 2).alias("cost"))
    best = o.groupBy("r").agg(F.min("cost").alias("m")).orderBy("m", "r").limit(5).select("r")
    k = F.row_number().over(Window.partitionBy("r").orderBy("cost", "t"))
    return o.join(F.broadcast(best), "r").withColumn("k", k).where("k <= 3").select("r", "t", "cost", "k")


def q_candidate_choice(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_tight"), F.round(F.avg("o_totalprice"), 4).alias("avg_dist"))
    return o.orderBy(F.col("n_tight").desc(), "avg_dist", "o_custkey").limit(1)


def q_best_with_margin(spark, sf):
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("score"))
    w = Window.partitionBy("c_nationkey").orderBy(F.col("score").desc(), "c_custkey")
    r = c.withColumns({"k": F.row_number().over(w), "second": F.lead("score").over(w)}).where("k = 1")
    return r.select("c_nationkey", "c_custkey", F.round("score", 2).alias("score"), F.round(F.col("score") - F.col("second"), 4).alias("margin"), F.round(F.try_divide(F.col("score") - F.col("second"), F.col("score")) * 100, 4).alias("percent"))


def q_largest_first(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", (F.col("p_size") * F.col("p_retailprice")).alias("area"))
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.col("area").desc(), "p_partkey"))
    return p.withColumn("k", k).where("k <= 4").select("p_brand", "p_partkey", F.round("area", 4).alias("area"), "k")


def q_stride_sample(spark, sf):
    return table(spark, sf, "customer").withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))).where("n % 7 = 1").select("c_nationkey", "c_custkey", "n")


def q_log_tail(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return c.withColumn("k", k).where("k <= 3").select("conv_id", "turn", "role", "k")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

AX = "SELECT l_partkey % 96 AS u, max(l_extendedprice) AS v FROM lineitem GROUP BY 1"
SQL = {
    "polygon_measures": f"""WITH {RING}, e AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ring WINDOW w AS (PARTITION BY k ORDER BY i))
 SELECT k, count(*) AS n, round(abs(sum(x * ny - nx * y)) / 2 + 1e-9, 5) AS area, round(sum(sqrt(pow(nx - x, 2) + pow(ny - y, 2))) + 1e-9, 5) AS perimeter, round(avg(x) + 1e-9, 5) AS mean_x, round(avg(y) + 1e-9, 5) AS mean_y,
 round(max(x) - min(x) + 1e-9, 5) AS width, round(max(y) - min(y) + 1e-9, 5) AS height, round(sqrt(var_pop(x) + var_pop(y)) + 1e-9, 5) AS spread FROM e GROUP BY k""",
    "min_area_box": "SELECT r_regionkey AS k, round((r_regionkey + 3.0) * (r_regionkey + 2.0), 6)::DOUBLE AS area, round(r_regionkey + 3.0, 6)::DOUBLE AS long_side FROM region",
    "polygon_transform": f"WITH {RING} SELECT k, round(sum(1.5 * (cos(0.3) * x - sin(0.3) * y) + 2), 5) AS sx, round(sum(1.5 * (sin(0.3) * x + cos(0.3) * y) - 1), 5) AS sy, count(*) AS n FROM ring GROUP BY k",
    "polygon_expand": "SELECT i, round(x + (x - 2) / 2.5 * 0.5, 6)::DOUBLE AS x, round(y + (y - 1.5) / 2.5 * 0.5, 6)::DOUBLE AS y FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 4, 0), (2, 4, 3), (3, 0, 3)) t(i, x, y)",
    "gap_fill_linear": f"""WITH {HOUR}, r AS (SELECT k, min(t) AS a, max(t) AS b FROM h GROUP BY k), f AS (SELECT r.k, u.t, h.v FROM r, LATERAL (SELECT unnest(range(a, b + 1)) AS t) u LEFT JOIN h ON h.k = r.k AND h.t = u.t),
 g AS (SELECT k, t, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER a AS v1, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS t1 FROM f
 WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT k, t, round(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS f FROM g""",
    "median_filter_circular": f"WITH a AS ({AX}) SELECT CAST(a.u AS INT) AS u, round(quantile_cont(b.v, 0.5), 4) AS m FROM a JOIN a b ON least((a.u - b.u + 96) % 96, (b.u - a.u + 96) % 96) <= 7 GROUP BY a.u",
    "resample": f"WITH a AS ({AX}), g AS (SELECT i, i * (95 / 255.0::DOUBLE) AS x FROM range(256) t(i)), h AS (SELECT i, x, least(floor(x), 94) AS lo FROM g) SELECT CAST(i AS INT) AS i, round(p.v + (q.v - p.v) * (x - lo), 4) AS v FROM h JOIN a p ON p.u = lo JOIN a q ON q.u = lo + 1",
    "fuse_boundaries": f"WITH {MASK}, a AS (SELECT u, max(v) AS a FROM m WHERE id < 6 GROUP BY u), b AS (SELECT u, min(v) AS b FROM m WHERE id >= 6 GROUP BY u) SELECT u, least(a, b) AS edge FROM a FULL JOIN b USING (u)",
    "sorted_gap_groups": """WITH n AS (SELECT p_brand, p_retailprice AS v, CASE WHEN p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice) >= 2 THEN 1 ELSE 0 END AS s FROM part),
 g AS (SELECT p_brand, v, CAST(sum(s) OVER (PARTITION BY p_brand ORDER BY v RANGE UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM n) SELECT p_brand, grp, count(*) AS n, round(min(v), 4) AS lo, round(max(v), 4) AS hi FROM g GROUP BY ALL""",
    "local_maxima": """WITH h AS (SELECT l_suppkey % 4 AS k, l_partkey % 60 AS t, count(*) AS v FROM lineitem GROUP BY 1, 2), n AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY k ORDER BY t) THEN 0 ELSE 1 END AS s FROM h),
 r AS (SELECT *, sum(s) OVER (PARTITION BY k ORDER BY t) AS run FROM n), f AS (SELECT k, run, min(t) AS a, max(t) AS b, any_value(v) AS v FROM r GROUP BY 1, 2), p AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY run) AS x, lead(v) OVER (PARTITION BY k ORDER BY run) AS y FROM f)
 SELECT k, (a + b) // 2 AS t, v FROM p WHERE x < v AND y < v""",
    "polygon_about_centroid": f"WITH {RING}, c AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY i) - 1)::INT AS i, x - avg(x) OVER (PARTITION BY k) AS x, y - avg(y) OVER (PARTITION BY k) AS y FROM ring) SELECT k, i, round(1.5 * (cos(0.3) * x - sin(0.3) * y), 5) AS x, round(1.5 * (sin(0.3) * x + cos(0.3) * y), 5) AS y FROM c",
    "merge_collinear": f"""WITH {RING}, d AS (SELECT *, CAST(x > 50 AS INT) AS d, y + 1 AS w FROM ring), n AS (SELECT *, CASE WHEN lag(d) OVER (PARTITION BY k ORDER BY i) = d THEN 0 ELSE 1 END AS s FROM d), r AS (SELECT *, CAST(sum(s) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS run FROM n)
 SELECT k, run, d, round(sum(w), 4) AS w, round(sum(x * w) / sum(w), 5) AS x FROM r GROUP BY k, run, d""",
    "corner_rebuild": f"""WITH {RING}, d AS (SELECT *, i % 3 - 1.0::DOUBLE AS dx, i % 2 + 0.5::DOUBLE AS dy FROM ring), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v, coalesce(lead(dx) OVER w, first_value(dx) OVER w) AS du, coalesce(lead(dy) OVER w, first_value(dy) OVER w) AS dv FROM d WINDOW w AS (PARTITION BY k ORDER BY i)),
 s AS (SELECT *, dx * dv - dy * du AS den FROM n) SELECT k, i, round(CASE WHEN abs(den) > 1e-9 THEN x + ((u - x) * dv - (v - y) * du) / den * dx ELSE (x + u) / 2 END, 5) AS cx, round(CASE WHEN abs(den) > 1e-9 THEN y + ((u - x) * dv - (v - y) * du) / den * dy ELSE (y + v) / 2 END, 5) AS cy FROM s""",
    "dilate": f"WITH {MASK}, f0 AS (SELECT id, u, v, (u + v)::DOUBLE AS c FROM m), "
    + ", ".join(
        f"""f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION ALL SELECT * FROM (SELECT id, u + i AS u, v + j AS v, trunc(avg(c)) AS c FROM f{k}, (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j) WHERE (i <> 0 OR j <> 0) AND u + i BETWEEN 0 AND 50 AND v + j BETWEEN 0 AND 39 GROUP BY 1, 2, 3) n ANTI JOIN f{k} USING (id, u, v))"""
        for k in range(ROUNDS)
    )
    + f" SELECT id, u, v, c FROM f{ROUNDS}",
    "mask_difference": f"WITH {MASK}, d AS (SELECT DISTINCT u, v FROM m WHERE id < 9 EXCEPT SELECT u, v FROM m WHERE id >= 9) SELECT u, count(*) AS n FROM d GROUP BY u",
    "mask_union": f"WITH {MASK}, d AS (SELECT DISTINCT id // 4 AS g, u, v FROM m) SELECT g, v, count(*) AS n FROM d GROUP BY g, v",
    "mask_classes": f"WITH {MASK}, w AS (SELECT count(*) AS w FROM (SELECT DISTINCT u, v FROM m)), c AS (SELECT id, count(*) AS n FROM m GROUP BY id) SELECT id, n, round(n / w, 6) AS share, CASE WHEN n / 2000.0 > 0.70 THEN 'junk' WHEN n / w > 0.85 THEN 'outline' ELSE 'room' END AS class FROM c, w",
    "column_coverage": f"WITH {MASK}, c AS (SELECT id, u, count(*) / 40 AS s FROM m GROUP BY 1, 2) SELECT id, count(*) AS n_columns, round(max(s), 4) AS top FROM c WHERE s > 0.6 GROUP BY id",
    "column_boundary": f"WITH {MASK} SELECT id, u, min(v) AS first, max(v) AS last FROM m GROUP BY id, u",
    "largest_mask": f"WITH {MASK} SELECT id, count(*) AS n FROM m GROUP BY id ORDER BY n DESC, id LIMIT 1",
    "azimuth_max": f"WITH {CLOUD} SELECT CAST(least(floor((atan2(y - 5, x - 25) + pi()) / (2 * pi() / 64)), 63) AS INT) AS bin, round(max(sqrt((x - 25) * (x - 25) + (y - 5) * (y - 5))), 6) AS far, count(*) AS n FROM pts GROUP BY 1",
    "circular_shift": f"WITH {MASK} SELECT id, (u + 37) % 51 AS u, count(*) AS n, CAST(sum(v) AS BIGINT) AS s FROM m GROUP BY 1, 2",
    "intersection_groups": "WITH e AS (SELECT s_suppkey, s_suppkey % 3 AS grp FROM supplier UNION ALL SELECT s_suppkey, (s_suppkey % 3 + 1) % 3 FROM supplier) SELECT grp, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM e GROUP BY grp",
    "top_k_longest": "SELECT o_orderkey, round(o_totalprice, 2) AS length FROM orders ORDER BY length DESC, o_orderkey LIMIT 25",
    "top_k_diverse": """WITH o AS (SELECT o_custkey % 24 AS r, o_orderkey AS t, round(o_totalprice, 2) AS cost FROM orders), b AS (SELECT r FROM o GROUP BY r ORDER BY min(cost), r LIMIT 5), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY cost, t) AS k FROM o WHERE r IN (SELECT r FROM b))
 SELECT r, t, cost, CAST(k AS INT) AS k FROM k WHERE k <= 3""",
    "candidate_choice": "SELECT o_custkey, count(*) AS n_tight, round(avg(o_totalprice), 4) AS avg_dist FROM orders GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 1",
    "best_with_margin": """WITH r AS (SELECT c_nationkey, c_custkey, c_acctbal AS s, row_number() OVER w AS k, lead(c_acctbal) OVER w AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey))
 SELECT c_nationkey, c_custkey, round(s, 2) AS score, round(s - t, 4) AS margin, round((s - t) / s * 100, 4) AS percent FROM r WHERE k = 1""",
    "largest_first": "WITH r AS (SELECT p_brand, p_partkey, p_size * p_retailprice AS a, row_number() OVER (PARTITION BY p_brand ORDER BY p_size * p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_partkey, round(a, 4) AS area, CAST(k AS INT) AS k FROM r WHERE k <= 4",
    "stride_sample": "WITH r AS (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INT) AS n FROM customer) SELECT * FROM r WHERE n % 7 = 1",
    "log_tail": "WITH r AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INT) AS k FROM conversations) SELECT * FROM r WHERE k <= 3",
}
