"""Floor-layout, placement, label and mesh-table queries over the supplied tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import joins as J
from voxloom.operators import layouts as L
from voxloom.operators import points as P
from voxloom.operators import rings as R
from voxloom.plans.joins import CENTRES, centres
from voxloom.plans.points import CLOUD, PROJ, H, W, cloud, projected
from voxloom.plans.rings import MASK, RING, mask, ring
from voxloom.plans.surfaces import UNIT, units
from voxloom.session import table

BW, BH = 96, 64
#: Floor and ceiling rows of two images' columns, from part prices.
ROWS = "rows_ AS (SELECT p_size % 2 AS img, p_partkey % 96 AS u, max(33 + p_retailprice * 7 % 29) AS f, min(31 - p_retailprice * 3 % 28) AS c FROM part GROUP BY 1, 2)"
#: Rooms: boxes on the floor plan; pieces: smaller boxes about the origin.
ROOMS = "rooms AS (SELECT r_regionkey::BIGINT AS room, (r_regionkey * 7 % 11)::DOUBLE AS x0, (r_regionkey * 5 % 9)::DOUBLE AS y0, (r_regionkey * 7 % 11 + 3 + r_regionkey % 4)::DOUBLE AS x1, (r_regionkey * 5 % 9 + 2 + r_regionkey % 3)::DOUBLE AS y1 FROM region)"
PIECES = "pieces AS (SELECT n_nationkey::BIGINT AS piece, 1 + n_nationkey % 3 * 0.75::DOUBLE AS hw, 0.5 + n_nationkey % 4 * 0.5::DOUBLE AS hh FROM nation)"
QUARTERS = [k * math.pi / 2 for k in range(4)]
STEPS = 9


def boundary_rows(spark, sf):
    p = table(spark, sf, "part")
    return p.groupBy((F.col("p_size") % 2).alias("img"), (F.col("p_partkey") % BW).alias("u")).agg(F.max(33 + F.col("p_retailprice") * 7 % 29).alias("f"), F.min(31 - F.col("p_retailprice") * 3 % 28).alias("c"))


def rooms(spark, sf):
    k = F.col("r_regionkey")
    return table(spark, sf, "region").select(k.cast("long").alias("room"), (k * 7 % 11).cast("double").alias("x0"), (k * 5 % 9).cast("double").alias("y0"), (k * 7 % 11 + 3 + k % 4).cast("double").alias("x1"), (k * 5 % 9 + 2 + k % 3).cast("double").alias("y1"))


def pieces(spark, sf):
    k = F.col("n_nationkey")
    return table(spark, sf, "nation").select(k.cast("long").alias("piece"), (1 + k % 3 * 0.75).alias("hw"), (0.5 + k % 4 * 0.5).alias("hh"))


def room_rings(spark, sf):
    return rooms(spark, sf).select("room", L.box_ring("x0", "y0", "x1", "y1").alias("q"))


def piece_rings(spark, sf):
    return pieces(spark, sf).select("piece", L.box_ring(-F.col("hw"), -F.col("hh"), F.col("hw"), F.col("hh")).alias("p"))


def q_floor_points(spark, sf):
    x, z = L.floor_point(*L.lon_lat("u", "f", BW, BH))
    return boundary_rows(spark, sf).select("img", "u", F.round(x, 5).alias("x"), F.round(z, 5).alias("z"))


def q_floor_pixels(spark, sf):
    x, z = L.floor_point(*L.lon_lat("u", "f", BW, BH))
    b = boundary_rows(spark, sf).select("img", "u", "f", x.alias("x"), z.alias("z"))
    u, v = L.floor_pixel("x", "z", BW, BH)
    return b.select("img", "u", F.round(u, 5).alias("pu"), F.round(v, 5).alias("pv"))


def q_height_ratio(spark, sf):
    ok, ratio = L.height_ratio("f", "c", BH)
    g = boundary_rows(spark, sf).withColumn("ratio", F.when(ok, ratio)).groupBy("img").agg(F.count("ratio").alias("n"), F.percentile("ratio", F.lit(0.5)).alias("m"))
    return g.select("img", "n", F.round(F.when(F.col("n") < 10, 1.0).otherwise(F.col("m")), 6).alias("ratio"))


def q_ceiling_rows(spark, sf):
    return boundary_rows(spark, sf).select("img", "u", F.round(L.ceiling_to_floor("c", BH, F.lit(1.4)), 5).alias("row"))


def q_boundary_fusion(spark, sf):
    """Floor boundary where there is one, else the ceiling's as a floor row; images without a floor are left out."""
    b = boundary_rows(spark, sf)
    floor = b.where("f < 58").select("img", "u", "f")
    ceil = b.select("img", "u", L.ceiling_to_floor("c", BH, F.lit(1.4)).alias("g"))
    both = floor.join(ceil, ["img", "u"], "full_outer").join(floor.select("img").distinct(), "img", "left_semi")
    return both.groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.count("f").alias("n_floor"), F.round(F.sum(F.coalesce("f", "g")), 4).alias("rows"))


def q_boundary_smooth(spark, sf):
    """Running median of 15, kept below the horizon, at 256 even columns."""
    b = boundary_rows(spark, sf)
    m = R.circular_median(b, ["img"], "u", BW, "f", 15, "m")
    kept = m.select("img", "u", F.least(F.greatest("m", F.lit(BH / 2 + 1)), F.lit(BH - 1.0)).alias("v"))
    return R.resample(kept, ["img"], "u", "v", BW - 1, 256).groupBy("img").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 4).alias("rows"))


def q_pixel_boundary(spark, sf):
    e = R.ring_next(rooms(spark, sf).select("room", F.posexplode(L.box_ring("x0", "y0", "x1", "y1")).alias("i", "_p")).select("room", "i", "_p.x", "_p.y"), ["room"], "i", ["x", "y"])
    d = L.densify(e, ["room", "i"], 5, 10)
    u, v = L.floor_pixel(F.col("x") - 4.5, F.col("y") - 3.5, 1024, 512)
    return d.select("room", "i", u.alias("u"), v.alias("v")).groupBy("room", "i").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("u"), 3).alias("u"), F.round(F.sum("v"), 3).alias("v"))


def q_manhattan_snap(spark, sf):
    e = L.snapped(R.ring_next(ring(spark, sf), ["k"], "i", ["x", "y"]), ["k"], math.radians(5))
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("side").cast("long").alias("across"), F.round(F.sum(F.col("ux") * F.col("length")) + 1e-9, 4).alias("ux"), F.round(F.sum(F.col("uy") * F.col("length")) + 1e-9, 4).alias("uy"))


def q_manhattan_rings(spark, sf):
    """Corners of rings after snapping, merging and meeting."""
    m = L.manhattan(ring(spark, sf), ["k"], "i")
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x") + 1e-9, 3).alias("x"), F.round(F.avg("y") + 1e-9, 3).alias("y"))


def q_turning(spark, sf):
    t = L.turning(ring(spark, sf), ["k"], "i")
    return t.select("k", *(F.round(c, 5).alias(c) for c in ("length", "density", "wobble")), ((F.col("length") >= 60) & (F.col("density") <= 0.1) & (F.col("wobble") <= 0.15)).alias("structure"))


def q_depth_cloud(spark, sf):
    p = projected(spark, sf).select("pano", G.cell(F.floor(F.col("u") / (W / 64)), 64).alias("pu"), G.cell(F.floor(F.col("v") / (H / 32)), 32).alias("pv"), "depth")
    d = p.groupBy("pano", "pu", "pv").agg(F.min("depth").alias("depth")).where("depth > 0.1 AND pv >= 3 AND pv < 29")
    theta, phi = (1 - (F.col("pu") + 0.5) / 64) * 2 * G.PI, (F.col("pv") + 0.5) / 32 * G.PI
    xyz = d.select("pano", (F.col("depth") * F.sin(phi) * F.cos(theta)).alias("x"), (F.col("depth") * F.sin(phi) * F.sin(theta)).alias("y"), (F.col("depth") * F.cos(phi)).alias("z"))
    return xyz.groupBy("pano").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 5).alias(c) for c in "xyz"))


def q_padding_mask(spark, sf):
    c = cloud(spark, sf).select((F.col("r") * 255).alias("r"), (F.col("g") * 255).alias("g"), (F.col("b") * 255).alias("b"))
    pad = ((F.col("r") + F.col("b")) / 2 - F.col("g") > 75) | ((F.col("r") == 0) & (F.col("g") == 0) & (F.col("b") == 0))
    return c.groupBy(pad.alias("padding")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("g"), 4).alias("g"))


def q_density_meta(spark, sf):
    e = cloud(spark, sf).agg(*(f(c).alias(n + c) for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    most = F.greatest(F.col("hix") - F.col("lox"), F.col("hiz") - F.col("loz"))
    return e.select(F.round("lox", 6).alias("min_x"), F.round("loz", 6).alias("min_z"), F.round(most, 6).alias("max_dim"), *(F.round((most - (F.col("hi" + c) - F.col("lo" + c))) / 2, 6).alias("offset_" + c) for c in "xz"), *(F.round((F.col("hi" + c) + F.col("lo" + c)) / 2, 6).alias("mid_" + c) for c in "xyz"))


def q_tile_summary(spark, sf):
    pts = cloud(spark, sf)
    e = P.extent(pts, "x", "z")
    m = J.tile_members(pts.select("pid", "x", "z"), "x", "z", e["min_x"], e["min_z"], 6.0, 1.0)
    t = m.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.count_if("owner").alias("own"))
    return t.agg(F.count_if(F.col("n") >= 20).alias("produced"), F.sum(F.when(F.col("n") >= 20, F.col("own")).otherwise(0)).alias("points"), F.count_if(F.col("n") < 20).alias("skipped"))


def q_face_edges(spark, sf):
    f = table(spark, sf, "orders").select((F.col("o_orderkey") % 500).alias("a"), (F.col("o_orderkey") * 3 % 500).alias("b"), (F.col("o_custkey") % 500).alias("c"))
    e = f.select(F.explode(F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    return e.groupBy((F.col("a") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b") - F.col("a")).alias("span"))


def q_paint_order(spark, sf):
    """What painting from far to near leaves on top: the nearest point of every pixel."""
    p = projected(spark, sf).select("pano", G.cell("u", 64).alias("pu"), G.cell("v", 32).alias("pv"), F.round("depth", 9).alias("depth"), "pid")
    return p.groupBy("pano", "pu", "pv").agg(F.min(F.struct("depth", "pid")).alias("m")).select("pano", "pu", "pv", "m.pid")


def q_better_registration(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") % 2).alias("method"), F.round(F.col("o_totalprice") % 1000, 2).alias("fitness"))
    best = F.max(F.struct("fitness", (-F.col("method")).alias("first")))
    return o.groupBy("o_custkey").agg(best.alias("m")).select("o_custkey", (-F.col("m.first")).alias("method"), F.col("m.fitness").alias("fitness"))


def q_unassigned_points(spark, sf):
    """Points that no plane of an earlier group holds, by exact place; of repeated planes the first owns a point."""
    p = cloud(spark, sf).select("x", "y", F.round("z", 6).alias("z"), (F.col("pid") % 5).alias("plane"))
    owned = p.where("plane < 3").groupBy("x", "y", "z").agg(F.min("plane").alias("owner"))
    free = p.where("plane >= 3").join(owned, ["x", "y", "z"], "left_anti").groupBy("plane").agg(F.count(F.lit(1)).alias("n"))
    return free.unionByName(owned.groupBy(F.col("owner").alias("plane")).agg(F.count(F.lit(1)).alias("n")))


def q_plane_adjacency(spark, sf):
    """Adjacent planes: pairs of patches with points at most 0.15 apart, found in grid cells, and how many of their point pairs are at most 0.2 apart."""
    p = units(spark, sf).select("i", "x", "y", "z", (F.col("i") % 6).alias("g"))
    pairs = J.pairs_within(p, "i", ["x", "y", "z"], 0.2)
    near = pairs.join(p.select(F.col("i").alias("a"), F.col("g").alias("ga")), "a").join(p.select(F.col("i").alias("b"), F.col("g").alias("gb")), "b").where("ga <> gb")
    return near.groupBy(F.least("ga", "gb").alias("p"), F.greatest("ga", "gb").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.min("d2")), 6).alias("gap")).where("gap <= 0.15")


def q_room_labels(spark, sf):
    """Points with the last room that holds them, or -1; rooms are few and bounded by the plan."""
    at = cloud(spark, sf).select((F.col("x") / 4).alias("x"), (F.col("y") * 1.2).alias("y")).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    r = rooms(spark, sf)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    held = at.join(F.broadcast(r), inside, "left").groupBy("x", "y", "n").agg(F.coalesce(F.max("room"), F.lit(-1).cast("long")).alias("room"))
    return held.groupBy("room").agg(F.sum("n").alias("n"))


def q_room_under_marker(spark, sf):
    """Room of every marker: the first that holds it, from the source of least rank that has any room; else (unassigned)."""
    m = centres(spark, sf).select("k", (F.col("x") / 4).alias("x"), (F.col("z") / 10).alias("y"))
    src = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    r = rooms(spark, sf).withColumn("src", src).where("room >= src * 2").select("src", "room", *((F.col(c) + F.col("src") * 0.5).alias(c) for c in ("x0", "y0", "x1", "y1")))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    held = m.join(F.broadcast(r), inside, "left").groupBy("k").agg(F.min(F.when(F.col("room").isNotNull(), F.struct("src", "room"))).alias("m"))
    return held.select("k", F.coalesce(F.concat(F.lit("room "), F.col("m.room")), F.lit("(unassigned)")).alias("label"), F.col("m.src").alias("src"))


def q_room_filter(spark, sf):
    """Predicted rooms with a score over 0.5, at least four corners and an area of 100 on a grid of 255, to whole pixels of 512."""
    r = ring(spark, sf).withColumn("score", F.col("k") * 37 % 100 / 100.0).where("score > 0.5")
    m = R.ring_measures(r, ["k"], "i", "x", "y").where("n >= 4 AND area >= 100")
    big = r.join(m.select("k"), "k", "left_semi").select("k", F.floor(F.col("x") * 512 / 255).cast("long").alias("x"), F.floor(F.col("y") * 512 / 255).cast("long").alias("y"))
    return big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


def q_layout_metres(spark, sf):
    c = ring(spark, sf).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("r"))
    m = c.select("k", F.transform("r", lambda p: F.struct((p["x"] * 1.6).alias("x"), (p["y"] * -1.6).alias("z"))).alias("r"))
    return m.select("k", F.size("r").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda a, p: a + p["x"]), 5).alias("x"), F.round(F.aggregate("r", F.lit(0.0), lambda a, p: a + p["z"]), 5).alias("z"))


def q_border_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 640).alias("x1"), (F.col("o_orderkey") % 480).alias("y1"), (F.col("o_custkey") * 3 % 640).alias("x2"), (F.col("o_orderkey") * 7 % 480).alias("y2"))
    side = ((F.col("x1") < 5) & (F.col("x2") < 5)) | ((F.col("x1") > 635) & (F.col("x2") > 635)) | ((F.col("y1") < 5) & (F.col("y2") < 5)) | ((F.col("y1") > 475) & (F.col("y2") > 475))
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return o.where(~side & (length >= 30)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 3).alias("length"))


def diagonals(spark, sf):
    d = lambda a, b: F.sqrt(a * a + b * b)
    a = pieces(spark, sf).select("piece", d(2 * F.col("hw"), 2 * F.col("hh")).alias("dp"))
    return a.crossJoin(F.broadcast(rooms(spark, sf).select("room", d(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("dr")))).withColumn("ratio", F.col("dr") / F.col("dp"))


def q_scale_vote(spark, sf):
    """Middle of the fullest of 60 bins of diagonal ratios, over their own range."""
    d = diagonals(spark, sf)
    e = d.agg(F.min("ratio").alias("lo"), F.max("ratio").alias("hi"))
    b = d.crossJoin(F.broadcast(e)).select("lo", "hi", F.least(F.floor((F.col("ratio") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 60) + 1e-9).cast("int"), F.lit(59)).alias("bin"))
    g = b.groupBy("lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("n").desc(), "bin").limit(1).select("bin", "n", F.round(F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / 60, 6).alias("scale"))


def q_greedy_rooms(spark, sf):
    """Each piece with the room whose diagonal ratio is nearest to 1.6, within 15 %; rooms may repeat."""
    d = diagonals(spark, sf).withColumn("off", F.round(F.abs(F.col("ratio") - 1.6) / 1.6, 9)).where("off <= 0.15")
    return d.groupBy("piece").agg(F.min(F.struct("off", "room")).alias("m")).select("piece", "m.room", F.round("m.off", 6).alias("off"))


def q_scale_hypotheses(spark, sf):
    """Every distinct ratio (four decimals) as a scale: pieces with a room within 10 %, and the sum of their least deviations; the best five."""
    d = diagonals(spark, sf)
    s = d.select(F.round("ratio", 4).alias("s")).distinct()
    # hypotheses and pairs meet by bins of 10 %, so that only near ones are held against each other
    b = F.floor(F.log("s") / math.log(1.12)).cast("int")
    near = s.withColumn("b", b).withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    j = near.join(d.withColumn("b", F.floor(F.log("ratio") / math.log(1.12)).cast("int")), "b").withColumn("off", F.abs(F.col("ratio") - F.col("s")) / F.col("s")).where("off <= 0.1")
    best = j.groupBy("s", "piece").agg(F.min("off").alias("off")).groupBy("s").agg(F.count(F.lit(1)).alias("valid"), F.round(F.sum("off"), 6).alias("error"))
    return best.orderBy(F.col("valid").desc(), "error", "s").limit(5)


def q_cloud_sanity(spark, sf):
    c = cloud(spark, sf).agg(*(F.avg(k).alias(k) for k in "xyz"), F.max(F.greatest("r", "g", "b")).alias("top"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("x").isNull() | F.isnan("x")).alias("bad"))
    return c.select("n", "bad", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 5).alias("centre"), F.when(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) > 10, "far").otherwise("ok").alias("position"), F.when(F.col("top") > 1.1, "0..255").otherwise("0..1").alias("colours"))


def q_centred_labels(spark, sf):
    """Voxels of 4 about the XY mean with their most frequent class, classes kept to 0..3, and the class's colour."""
    pts = cloud(spark, sf).withColumn("label", F.least(F.greatest(F.floor(F.col("r") * 6).cast("int") - 1, F.lit(0)), F.lit(3)))
    mean = pts.agg(F.avg("x").alias("mx"), F.avg("z").alias("mz"))
    v = pts.crossJoin(F.broadcast(mean)).select(F.floor((F.col("x") - F.col("mx")) / 4 + 1e-9).cast("int").alias("vx"), F.floor((F.col("z") - F.col("mz")) / 4 + 1e-9).cast("int").alias("vz"), "label")
    n = v.groupBy("vx", "vz", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("vx", "vz").agg((-F.max(F.struct("n", (-F.col("label")).alias("k")))["k"]).alias("label"), F.sum("n").alias("n"))
    palette = spark.sql("SELECT * FROM VALUES (0, 'floor'), (1, 'wall'), (2, 'ceiling'), (3, 'other') AS t(label, name)")
    return n.join(F.broadcast(palette), "label").groupBy("name").agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("n"))


def q_overlay_counts(spark, sf):
    """Matched pairs per group, and those of which both ends are in view; pairs are joined by line id."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).alias("grp"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 25).alias("b")).distinct()
    left = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") % 4 != 0).alias("see_a"))
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("b"), (F.col("n_nationkey") % 5 != 1).alias("see_b"))
    return li.join(left, "a").join(F.broadcast(right), "b").groupBy("grp").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("see_a") & F.col("see_b")).alias("drawn"))


def q_last_option(spark, sf):
    """Of repeated options the last value wins."""
    e = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("value"))
    return e.groupBy("conv_id", F.col("role").alias("option")).agg(F.max(F.struct("turn", "value")).alias("m")).select("conv_id", "option", "m.value")


def q_measurement_labels(spark, sf):
    s = centres(spark, sf).withColumns({"x2": F.col("z") / 2, "z2": F.col("x") * 1.5})
    d = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("z2") - F.col("z"), 2))
    return s.select("k", F.format_string("%.3f m", F.round(d, 3)).alias("label"), F.round((F.col("x") + F.col("x2")) / 2, 6).alias("mx"), F.round((F.col("z") + F.col("z2")) / 2, 6).alias("mz"))


def q_pano_positions(spark, sf):
    """Raw positions of matched panoramas from pixels, quantised cells undone; panoramas without a match are left out."""
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 256).alias("u"), (F.col("c_nationkey") * 10).alias("v"))
    ok = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return c.join(ok, "c_custkey", "left_semi").select("c_custkey", F.round((F.col("u") / 255.0) * 40 - 3, 6).alias("x"), F.round((F.col("v") / 255.0) * 40 + 7, 6).alias("y"))


def q_pano_rooms(spark, sf):
    """Each panorama's room polygon, grown by 0.5 from its middle."""
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("long").alias("room"))
    r = n.join(F.broadcast(room_rings(spark, sf)), "room").select("n_nationkey", F.posexplode(R.expand_ring(F.col("q"), 0.5)).alias("i", "p"))
    return r.select("n_nationkey", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def q_scene_views(spark, sf):
    """Six faces of every panorama whose pose is known, numbered through in order of name."""
    p = table(spark, sf, "nation").select(F.col("n_name").alias("pano"), "n_regionkey").join(table(spark, sf, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey", "left_semi")
    before = F.row_number().over(Window.orderBy("pano"))  # one row a panorama
    return p.withColumn("_n", before - 1).withColumn("face", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("pano", "face", (F.col("_n") * 6 + F.col("face")).alias("view"), F.format_string("view_%04d.png", (F.col("_n") * 6 + F.col("face")).cast("int")).alias("file"))


def q_visibility_labels(spark, sf):
    """Faces seen by cameras: before the camera, in its image, at the depth drawn there, under 75 degrees; with the best camera's label per face."""
    p = table(spark, sf, "part")
    faces = p.select(F.col("p_partkey").alias("face"), (F.col("p_size") - 25.0).alias("x"), (F.col("p_partkey") % 37 - 18.0).alias("y"), (F.col("p_retailprice") / 100).alias("z"), (F.col("p_partkey") % 3 / 4.0).alias("nx"), F.lit(0.25).alias("ny"))
    faces = faces.withColumn("nz", F.sqrt(1 - F.col("nx") * F.col("nx") - F.col("ny") * F.col("ny")))
    cams = spark.sql("SELECT * FROM VALUES (0, 0.0D, 0.0D, 2.0D), (1, 10.0D, 5.0D, 5.0D), (2, -12.0D, 3.0D, 1.0D) AS t(cam, tx, ty, tz)")
    at = faces.crossJoin(F.broadcast(cams)).withColumns({"cx": F.col("x") - F.col("tx"), "cy": F.col("y") - F.col("ty"), "cz": F.col("z") - F.col("tz")}).where("cz > 0.1")
    at = at.withColumns({"u": 32 * F.col("cx") / F.col("cz") + 32, "v": 32 * F.col("cy") / F.col("cz") + 24}).where("u >= 0 AND u < 64 AND v >= 0 AND v < 48")
    at = at.withColumns({"pu": F.floor("u").cast("int"), "pv": F.floor("v").cast("int"), "dist": F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))})
    drawn = at.groupBy("cam", "pu", "pv").agg(F.min("cz").alias("drawn"))
    cos = F.abs(F.col("nx") * F.col("cx") + F.col("ny") * F.col("cy") + F.col("nz") * F.col("cz")) / F.col("dist")
    seen = at.join(drawn, ["cam", "pu", "pv"]).withColumn("cos", cos).where((F.abs(F.col("cz") - F.col("drawn")) < 0.05) & (F.col("cos") > math.cos(math.radians(75))))
    best = seen.groupBy("face").agg(F.max(F.struct(F.round(F.col("cos") / (F.col("dist") * F.col("dist")), 12).alias("q"), (-F.col("cam")).alias("c"))).alias("m")).select("face", (-F.col("m.c")).alias("cam"))
    every = seen.groupBy("cam").agg(F.count(F.lit(1)).alias("visible"))
    return every.join(best.groupBy("cam").agg(F.count(F.lit(1)).alias("assigned"), F.sum("face").alias("faces")), "cam", "left").select("cam", "visible", F.coalesce("assigned", F.lit(0)).alias("assigned"), "faces")


def q_mask_classification(spark, sf):
    """Outline, rooms and junk by area; without an outline the footprint is the union of the rooms."""
    m = mask(spark, sf)
    whole = m.select("u", "v").distinct().agg(F.count(F.lit(1)).alias("w"))
    c = m.groupBy("id").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(whole)).select("id", F.when(F.col("n") / 2600.0 > 0.70, "junk").when(F.col("n") / F.col("w") > 0.95, "outline").otherwise("room").alias("class"))
    kept = m.join(F.broadcast(c), "id").groupBy("class").agg(F.count_distinct("u", "v").alias("n"), F.count_distinct("id").alias("masks"))
    order = F.when(F.col("class") == "outline", 0).otherwise(1)
    print_ = kept.where("class <> 'junk'").agg(F.min(F.struct(order.alias("o"), "class", "n")).alias("m")).select(F.lit("footprint").alias("class"), F.col("m.n").alias("n"), F.lit(0).cast("long").alias("masks"))
    return kept.unionByName(print_)


def q_prepared_cloud(spark, sf):
    """The band between floor and ceiling in voxels of 2: the scan as it goes into a registration."""
    pts = cloud(spark, sf).where("z > 5.3 AND z < 90.0")
    voxels = pts.groupBy(*(F.floor(F.col(c) / 2).cast("int").alias("v" + c) for c in "xyz")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"))
    return voxels.groupBy("vy").agg(F.count(F.lit(1)).alias("voxels"), F.sum("n").alias("n"), F.round(F.sum("x"), 4).alias("x"))


def q_dense_clusters(spark, sf):
    """Density clusters: core points have 3 neighbours within 0.12; cores within reach share a cluster, others join the least near core."""
    p = units(spark, sf).select("i", "x", "y", "z")
    near = J.stored(J.pairs_within(p, "i", ["x", "y", "z"], 0.12).select("a", "b"), "pairs")
    both = near.union(near.select("b", "a"))
    core = J.stored(both.groupBy(F.col("a").alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("i"), "cores")
    links = near.join(core.withColumnRenamed("i", "a"), "a", "left_semi").join(core.withColumnRenamed("i", "b"), "b", "left_semi")
    comp = core.join(J.components(links), core["i"] == F.col("node"), "left").select("i", F.coalesce("component", "i").alias("cluster"))
    edge = both.join(core.withColumnRenamed("i", "a"), "a", "left_anti").join(comp.withColumnRenamed("i", "b"), "b").groupBy(F.col("a").alias("i")).agg(F.min("cluster").alias("cluster"))
    return comp.unionByName(edge).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def q_plane_visibility(spark, sf):
    """Share of every patch's samples that its view draws: nearest of their pixel within 0.05; patches under 5 % are unseen."""
    at = projected(spark, sf).select("pano", G.cell("u", W).alias("pu"), G.cell("v", H).alias("pv"), "depth", (F.col("pid") % 12).alias("patch"))
    near = at.groupBy("pano", "pu", "pv").agg(F.min("depth").alias("m"))
    g = at.join(near, ["pano", "pu", "pv"]).groupBy("pano", "patch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("depth") <= F.col("m") + 0.05).alias("seen"))
    return g.select("pano", "patch", "n", "seen", (F.col("seen") / F.col("n") >= 0.05).alias("visible"))


def q_texel_padding(spark, sf):
    """Empty texels of every atlas take the nearest filled texel, ties to the smaller (v, u)."""
    m = mask(spark, sf).where("v % 2 = 0 OR u < 10").select("u", "v").distinct()
    texels = spark.range(0, 51 * 40).select((F.col("id") % 51).cast("int").alias("u"), F.floor(F.col("id") / 51).cast("int").alias("v"))
    empty = texels.join(m, ["u", "v"], "left_anti").select((F.col("v") * 64 + F.col("u")).alias("t"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    filled = m.select((F.col("v") * 64 + F.col("u")).alias("f"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v"))
    return J.nearest(empty, "t", filled, "f", ["u", "v"], 2.0).select("t", F.col("near").alias("f"), F.col("d2").cast("long").alias("d2"))


def q_room_placement(spark, sf):
    """Every piece's best room, quarter turn and place on a 9 x 9 grid, by IoU."""
    p = piece_rings(spark, sf).crossJoin(F.broadcast(room_rings(spark, sf).select("room")))
    s = L.placements(p, room_rings(spark, sf), QUARTERS, STEPS)
    return L.best_placement(s, ["piece"], F.col("iou")).select("piece", "room", "a", "i", "j", F.round("score", 6).alias("score"))


def q_vertex_snap(spark, sf):
    """The quarter turn and vertices that lay a piece on its room best; boxes of the room's shape fit exactly."""
    p = pieces(spark, sf).where("piece < 8").select(F.col("piece").alias("id"), L.box_ring(-F.col("hw"), -F.col("hh"), F.col("hw"), F.col("hh")).alias("p"), L.box_ring(5 - F.col("hh"), 3 - F.col("hw"), 5 + F.col("hh"), 3 + F.col("hw")).alias("q"))
    return L.snap_vertices(p).select("id", F.round("error", 6).alias("error"))


def q_refined_placements(spark, sf):
    """Pieces placed in their regions' rooms, largest first, away from each other; angles every 15 degrees and near the long axes."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("piece"), F.col("n_regionkey").cast("long").alias("room")).where("piece % 2 = 0 OR piece < 5")
    angles = [math.radians(d) for d in (*range(0, 360, 30), -8, -4, 4, 8)]
    small = piece_rings(spark, sf).join(n, "piece")
    return L.refine_placements(small, room_rings(spark, sf), angles, 6)


def q_optimized_assignments(spark, sf):
    """Shared scale and places of pieces for every assignment of two pieces to rooms, by differential evolution."""
    p, q = piece_rings(spark, sf), room_rings(spark, sf)
    two = spark.sql("SELECT * FROM VALUES (0L, 1L, 0L), (0L, 2L, 1L), (1L, 1L, 1L), (1L, 2L, 0L), (2L, 1L, 2L), (2L, 2L, 2L) AS t(assignment, piece, room)")
    return L.optimize_assignments(two.join(p, "piece").join(q, "room").select("assignment", "piece", "p", "q"))


def q_mask_outlines(spark, sf):
    """Simplified outlines of the largest part of every mask."""
    return L.mask_rings(mask(spark, sf), "id")


def q_boundary_rings(spark, sf):
    """Simplified floor rings of the boundaries."""
    return L.boundary_ring(boundary_rows(spark, sf).withColumnRenamed("f", "v"), ["img"], BW, BH)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

LONLAT = "((u + 0.5::DOUBLE) / 96 - 0.5) * 2 * pi() AS lon, ((f + 0.5::DOUBLE) / 64 - 0.5) * pi() AS lat"
NEXT = "coalesce(lead({c}) OVER w, first({c}) OVER w) AS n{c}"
EDGES = f"{RING}, edges AS (SELECT *, nx - x AS dx, ny - y AS dy, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS len, CASE WHEN atan2(ny - y, nx - x) < 0 THEN atan2(ny - y, nx - x) + pi() WHEN atan2(ny - y, nx - x) >= pi() THEN atan2(ny - y, nx - x) - pi() ELSE atan2(ny - y, nx - x) END AS am FROM (SELECT *, coalesce(lead(x) OVER (PARTITION BY k ORDER BY i), first(x) OVER (PARTITION BY k ORDER BY i)) AS nx, coalesce(lead(y) OVER (PARTITION BY k ORDER BY i), first(y) OVER (PARTITION BY k ORDER BY i)) AS ny FROM ring))"
STEP = repr(math.radians(5)) + "::DOUBLE"
SNAP = f"""{EDGES}, hist AS (SELECT k, CAST(floor(am / {STEP}) AS INT) % {int(math.pi / math.radians(5))} AS b, round(sum(len), 6) AS l FROM edges WHERE len >= 1e-6 GROUP BY 1, 2), best AS (SELECT k, (b + 0.5) * {STEP} AS a FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l DESC, b) AS n FROM hist) WHERE n = 1),
 sides AS (SELECT edges.*, a, CASE WHEN a + pi() / 2 >= pi() THEN a - pi() / 2 ELSE a + pi() / 2 END AS c FROM edges JOIN best USING (k)),
 snap0 AS (SELECT *, CASE WHEN len >= 1e-6 AND least(abs(am - c), pi() - abs(am - c)) < least(abs(am - a), pi() - abs(am - a)) THEN 1 ELSE 0 END AS side FROM sides),
 snap AS (SELECT k, i, x, y, len, side, (x + nx) / 2 AS mx, (y + ny) / 2 AS my, s * cos(t) AS ux, s * sin(t) AS uy FROM (SELECT *, CASE WHEN dx * cos(t) + dy * sin(t) < 0 THEN -1.0 ELSE 1.0 END AS s FROM (SELECT *, CASE WHEN side = 1 THEN c ELSE a END AS t FROM snap0)))"""
DIAG = f"{PIECES}, {ROOMS}, dia AS (SELECT piece, room, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / sqrt(4 * hw * hw + 4 * hh * hh) AS ratio FROM pieces, rooms)"

SQL = {
    "floor_points": f"WITH {ROWS}, l AS (SELECT img, u, {LONLAT} FROM rows_) SELECT img, u, round(cos(lat) * sin(lon) / sin(lat), 5) AS x, round(-cos(lat) * cos(lon) / sin(lat), 5) AS z FROM l",
    "floor_pixels": f"WITH {ROWS} SELECT img, u, round(u::DOUBLE, 5) AS pu, round(f::DOUBLE, 5) AS pv FROM rows_",
    "height_ratio": f"WITH {ROWS}, a AS (SELECT img, (f / 64 - 0.5) * pi() AS f, (0.5 - c / 64) * pi() AS c FROM rows_), r AS (SELECT img, tan(c) / tan(f) AS r FROM a WHERE f > 0.01 AND c > 0.01) SELECT img, count(*) AS n, round(CASE WHEN count(*) < 10 THEN 1.0 ELSE quantile_cont(r, 0.5) END, 6) AS ratio FROM r GROUP BY img",
    "ceiling_rows": f"WITH {ROWS} SELECT img, u, round(64 * (0.5 + atan(tan((0.5 - c / 64) * pi()) / 1.4) / pi()), 5) AS row FROM rows_",
    "boundary_fusion": f"WITH {ROWS}, b AS (SELECT img, CASE WHEN f < 58 THEN f END AS f, 64 * (0.5 + atan(tan((0.5 - c / 64) * pi()) / 1.4) / pi()) AS g FROM rows_) SELECT img, count(*) AS n, count(f) AS n_floor, round(sum(coalesce(f, g)), 4) AS rows FROM b GROUP BY img HAVING count(f) > 0",
    "boundary_smooth": f"""WITH {ROWS}, n AS (SELECT a.img, a.u, quantile_cont(b.f, 0.5) AS m FROM rows_ a JOIN rows_ b ON a.img = b.img AND (abs(a.u - b.u) <= 7 OR abs(a.u - b.u) >= 89) GROUP BY 1, 2), k AS (SELECT img, u, least(greatest(m, 33.0), 63.0) AS v FROM n),
 g AS (SELECT img, i, i * (95.0::DOUBLE / 255) AS x, least(CAST(floor(i * (95.0::DOUBLE / 255)) AS INT), 94) AS lo FROM range(256) t(i), (SELECT DISTINCT img FROM rows_)) SELECT g.img, count(*) AS n, round(sum(a.v + (b.v - a.v) * (x - lo)), 4) AS rows FROM g JOIN k a ON a.img = g.img AND a.u = lo JOIN k b ON b.img = g.img AND b.u = lo + 1 GROUP BY g.img""",
    "pixel_boundary": f"""WITH {ROOMS}, e AS (SELECT room, 0 AS i, x0 AS x, y0 AS y, x1 AS nx, y0 AS ny FROM rooms UNION ALL SELECT room, 1, x1, y0, x1, y1 FROM rooms UNION ALL SELECT room, 2, x1, y1, x0, y1 FROM rooms UNION ALL SELECT room, 3, x0, y1, x0, y0 FROM rooms), n AS (SELECT *, greatest(CAST(floor(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) * 5) AS INT), 10) AS n FROM e),
 d AS (SELECT room, i, x + (nx - x) * j / n - 4.5 AS x, -(y + (ny - y) * j / n - 3.5) AS z FROM n, range(1000) t(j) WHERE j < n), p AS (SELECT *, sqrt(x * x + 1 + z * z) AS r FROM d) SELECT room, i::INT AS i, count(*) AS n, round(sum((atan2(x / r, z / r) / (2 * pi()) + 0.5) * 1024 - 0.5), 3) AS u, round(sum((asin(1 / r) / pi() + 0.5) * 512 - 0.5), 3) AS v FROM p GROUP BY 1, 2""",
    "manhattan_snap": f"WITH {SNAP} SELECT k, count(*) AS n, sum(side)::BIGINT AS across, round(sum(ux * len) + 1e-9, 4) AS ux, round(sum(uy * len) + 1e-9, 4) AS uy FROM snap GROUP BY k",
    "manhattan_rings": f"""WITH {SNAP}, r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY k ORDER BY i) = side THEN 0 ELSE 1 END AS new FROM snap)),
 l AS (SELECT k, run, sum(mx * greatest(len, 1e-12)) / sum(greatest(len, 1e-12)) AS mx, sum(my * greatest(len, 1e-12)) / sum(greatest(len, 1e-12)) AS my, arg_min(ux, i) AS ux, arg_min(uy, i) AS uy FROM r GROUP BY 1, 2),
 n AS (SELECT *, coalesce(lead(mx) OVER w, first(mx) OVER w) AS nmx, coalesce(lead(my) OVER w, first(my) OVER w) AS nmy, coalesce(lead(ux) OVER w, first(ux) OVER w) AS nux, coalesce(lead(uy) OVER w, first(uy) OVER w) AS nuy, count(*) OVER (PARTITION BY k) AS c FROM l WINDOW w AS (PARTITION BY k ORDER BY run)),
 m AS (SELECT k, mx, my, ux, nmx, nmy, uy, ux * nuy - uy * nux AS den, (nmx - mx) * nuy - (nmy - my) * nux AS num FROM n WHERE c >= 3), p AS (SELECT k, CASE WHEN abs(den) > 1e-10 THEN mx + num / den * ux ELSE (mx + nmx) / 2 END AS x, CASE WHEN abs(den) > 1e-10 THEN my + num / den * uy ELSE (my + nmy) / 2 END AS y FROM m UNION ALL SELECT k, x, y FROM ring WHERE k IN (SELECT k FROM n WHERE c < 3))
 SELECT k, count(*) AS n, round(avg(x) + 1e-9, 3) AS x, round(avg(y) + 1e-9, 3) AS y FROM p GROUP BY k""",
    "turning": f"""WITH {RING}, v AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ring WINDOW w AS (PARTITION BY k ORDER BY i)), l AS (SELECT *, sqrt(dx * dx + dy * dy) AS len FROM v), h AS (SELECT *, dx / (len + 1e-6::DOUBLE) AS hx, dy / (len + 1e-6::DOUBLE) AS hy FROM l), t AS (SELECT *, acos(least(greatest(hx * lead(hx) OVER w + hy * lead(hy) OVER w, -1.0), 1.0)) AS turn FROM h WINDOW w AS (PARTITION BY k ORDER BY i)),
 g AS (SELECT k, sum(len) AS length, count(*) AS n, coalesce(sum(turn), 0) AS t FROM t GROUP BY k HAVING sum(len) > 0) SELECT k, round(length, 5) AS length, round(n / length, 5) AS density, round(t / length, 5) AS wobble, length >= 60 AND n / length <= 0.1 AND t / length <= 0.15 AS structure FROM g""",
    "depth_cloud": "WITH " + PROJ + """, img AS (SELECT pano, least(greatest(CAST(floor(u / 256 * 64) AS INT), 0), 63) AS pu, least(greatest(CAST(floor(v / 128 * 32) AS INT), 0), 31) AS pv, min(depth) AS d FROM proj GROUP BY 1, 2, 3), a AS (SELECT pano, d, (1 - (pu + 0.5::DOUBLE) / 64) * 2 * pi() AS t, (pv + 0.5::DOUBLE) / 32 * pi() AS p FROM img WHERE d > 0.1 AND pv >= 3 AND pv < 29)
 SELECT pano, count(*) AS n, round(avg(d * sin(p) * cos(t)), 5) AS x, round(avg(d * sin(p) * sin(t)), 5) AS y, round(avg(d * cos(p)), 5) AS z FROM a GROUP BY pano""",
    "padding_mask": f"WITH {CLOUD}, c AS (SELECT r * 255 AS r, g * 255 AS g, b * 255 AS b FROM pts) SELECT (r + b) / 2 - g > 75 OR (r = 0 AND g = 0 AND b = 0) AS padding, count(*) AS n, round(avg(g), 4) AS g FROM c GROUP BY 1",
    "density_meta": f"WITH {CLOUD}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM pts), m AS (SELECT *, greatest(x1 - x0, z1 - z0) AS m FROM e) SELECT round(x0, 6) AS min_x, round(z0, 6) AS min_z, round(m, 6) AS max_dim, round((m - (x1 - x0)) / 2, 6) AS offset_x, round((m - (z1 - z0)) / 2, 6) AS offset_z, round((x1 + x0) / 2, 6) AS mid_x, round((y1 + y0) / 2, 6) AS mid_y, round((z1 + z0) / 2, 6) AS mid_z FROM m",
    "tile_summary": f"""WITH {CLOUD}, e AS (SELECT min(x) AS x0, min(z) AS y0 FROM pts), t AS (SELECT i AS tx, j AS ty FROM range(40) a(i), range(60) b(j)), n AS (SELECT tx, ty, count(*) AS n, count(*) FILTER (floor((x - x0) / 6.0) = tx AND floor((z - y0) / 6.0) = ty) AS own FROM pts, e, t WHERE x BETWEEN x0 + tx * 6.0 - 1 AND x0 + (tx + 1) * 6.0 + 1 AND z BETWEEN y0 + ty * 6.0 - 1 AND y0 + (ty + 1) * 6.0 + 1 GROUP BY tx, ty)
 SELECT count(*) FILTER (n >= 20) AS produced, coalesce(sum(own) FILTER (n >= 20), 0)::BIGINT AS points, count(*) FILTER (n < 20) AS skipped FROM n""",
    "face_edges": "WITH f AS (SELECT o_orderkey % 500 AS a, o_orderkey * 3 % 500 AS b, o_custkey % 500 AS c FROM orders), e AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM (SELECT a AS p, b AS q FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f) WHERE p <> q) SELECT a % 10 AS k, count(*) AS n, sum(b - a)::BIGINT AS span FROM e GROUP BY 1",
    "paint_order": "WITH " + PROJ + ", r AS (SELECT pano, least(greatest(CAST(trunc(u) AS INT), 0), 63) AS pu, least(greatest(CAST(trunc(v) AS INT), 0), 31) AS pv, pid, round(depth, 9) AS d FROM proj) SELECT pano, pu, pv, pid FROM (SELECT *, row_number() OVER (PARTITION BY pano, pu, pv ORDER BY d, pid) AS n FROM r) WHERE n = 1",
    "better_registration": "WITH o AS (SELECT o_custkey, o_orderkey % 2 AS method, round(o_totalprice % 1000, 2) AS fitness FROM orders) SELECT o_custkey, method, fitness FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY fitness DESC, method) AS n FROM o) WHERE n = 1",
    "unassigned_points": f"WITH {CLOUD}, p AS (SELECT x, y, round(z, 6) AS z, pid % 5 AS plane FROM pts), o AS (SELECT x, y, z, min(plane) AS owner FROM p WHERE plane < 3 GROUP BY 1, 2, 3) SELECT plane, count(*) AS n FROM p WHERE plane >= 3 AND NOT EXISTS (SELECT 1 FROM o WHERE o.x = p.x AND o.y = p.y AND o.z = p.z) GROUP BY plane UNION ALL SELECT owner, count(*) FROM o GROUP BY owner",
    "plane_adjacency": f"WITH {UNIT}, d AS (SELECT a.i % 6 AS ga, b.i % 6 AS gb, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM un a JOIN un b ON a.i < b.i) SELECT least(ga, gb) AS p, greatest(ga, gb) AS q, count(*) AS n, round(sqrt(min(d2)), 6) AS gap FROM d WHERE ga <> gb AND d2 <= 0.2 * 0.2::DOUBLE GROUP BY 1, 2 HAVING round(sqrt(min(d2)), 6) <= 0.15",
    "room_labels": f"WITH {CLOUD}, {ROOMS}, p AS (SELECT x / 4 AS x, y * 1.2 AS y, count(*) AS n FROM pts GROUP BY 1, 2), h AS (SELECT p.x, p.y, p.n, coalesce(max(room), -1) AS room FROM p LEFT JOIN rooms ON p.x >= x0 AND p.x < x1 AND p.y >= y0 AND p.y < y1 GROUP BY 1, 2, 3) SELECT room, sum(n)::BIGINT AS n FROM h GROUP BY room",
    "room_under_marker": f"WITH {CENTRES}, {ROOMS}, m AS (SELECT k, x / 4 AS x, z / 10 AS y FROM cen), r AS (SELECT s AS src, room, x0 + s * 0.5 AS x0, y0 + s * 0.5 AS y0, x1 + s * 0.5 AS x1, y1 + s * 0.5 AS y1 FROM rooms, (VALUES (0), (1), (2)) t(s) WHERE room >= s * 2), h AS (SELECT k, src, room, row_number() OVER (PARTITION BY k ORDER BY src, room) AS n FROM m LEFT JOIN r ON x >= x0 AND x < x1 AND y >= y0 AND y < y1) SELECT k, CASE WHEN room IS NULL THEN '(unassigned)' ELSE 'room ' || room END AS label, src FROM h WHERE n = 1",
    "room_filter": f"WITH {EDGES}, s AS (SELECT * FROM edges WHERE k * 37 % 100 / 100.0 > 0.5), m AS (SELECT k FROM s GROUP BY k HAVING count(*) >= 4 AND abs(sum(x * ny - nx * y)) / 2 >= 100) SELECT k, count(*) AS n, sum(CAST(floor(x * 512 / 255) AS BIGINT))::BIGINT AS x, sum(CAST(floor(y * 512 / 255) AS BIGINT))::BIGINT AS y FROM s WHERE k IN (SELECT k FROM m) GROUP BY k",
    "layout_metres": f"WITH {RING} SELECT k, count(*)::INT AS n, round(sum(x * 1.6), 5) AS x, round(sum(y * -1.6), 5) AS z FROM ring GROUP BY k",
    "border_filter": "WITH o AS (SELECT o_custkey % 640 AS x1, o_orderkey % 480 AS y1, o_custkey * 3 % 640 AS x2, o_orderkey * 7 % 480 AS y2 FROM orders), l AS (SELECT sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) AS length FROM o WHERE NOT ((x1 < 5 AND x2 < 5) OR (x1 > 635 AND x2 > 635) OR (y1 < 5 AND y2 < 5) OR (y1 > 475 AND y2 > 475))) SELECT count(*) AS n, round(sum(length), 3) AS length FROM l WHERE length >= 30",
    "scale_vote": f"WITH {DIAG}, e AS (SELECT min(ratio) AS lo, max(ratio) AS hi FROM dia), b AS (SELECT lo, hi, least(CAST(floor((ratio - lo) / ((hi - lo) / 60) + 1e-9) AS INT), 59) AS bin FROM dia, e) SELECT bin, count(*) AS n, round(lo + (bin + 0.5) * (hi - lo) / 60, 6) AS scale FROM b GROUP BY bin, lo, hi ORDER BY n DESC, bin LIMIT 1",
    "greedy_rooms": f"WITH {DIAG}, o AS (SELECT piece, room, round(abs(ratio - 1.6) / 1.6, 9) AS off FROM dia) SELECT piece, room, round(off, 6) AS off FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY off, room) AS n FROM o WHERE off <= 0.15) WHERE n = 1",
    "scale_hypotheses": f"WITH {DIAG}, s AS (SELECT DISTINCT round(ratio, 4) AS s FROM dia), j AS (SELECT s, piece, min(abs(ratio - s) / s) AS off FROM s, dia WHERE abs(ratio - s) / s <= 0.1 GROUP BY 1, 2) SELECT s, count(*) AS valid, round(sum(off), 6) AS error FROM j GROUP BY s ORDER BY valid DESC, error, s LIMIT 5",
    "cloud_sanity": f"WITH {CLOUD}, a AS (SELECT count(*) AS n, count(*) FILTER (x IS NULL OR isnan(x)) AS bad, sqrt(pow(avg(x), 2) + pow(avg(y), 2) + pow(avg(z), 2)) AS c, max(greatest(r, g, b)) AS top FROM pts) SELECT n, bad, round(c, 5) AS centre, CASE WHEN c > 10 THEN 'far' ELSE 'ok' END AS position, CASE WHEN top > 1.1 THEN '0..255' ELSE '0..1' END AS colours FROM a",
    "centred_labels": f"WITH {CLOUD}, m AS (SELECT avg(x) AS mx, avg(z) AS mz FROM pts), v AS (SELECT CAST(floor((x - mx) / 4 + 1e-9) AS INT) AS vx, CAST(floor((z - mz) / 4 + 1e-9) AS INT) AS vz, least(greatest(CAST(floor(r * 6) AS INT) - 1, 0), 3) AS label FROM pts, m), n AS (SELECT vx, vz, label, count(*) AS n FROM v GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY vx, vz ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY vx, vz) AS s FROM n) SELECT CASE label WHEN 0 THEN 'floor' WHEN 1 THEN 'wall' WHEN 2 THEN 'ceiling' ELSE 'other' END AS name, count(*) AS voxels, sum(s)::BIGINT AS n FROM b WHERE k = 1 GROUP BY 1",
    "overlay_counts": "WITH p AS (SELECT DISTINCT l_suppkey % 3 AS grp, l_suppkey AS a, l_partkey % 25 AS b FROM lineitem) SELECT grp, count(*) AS pairs, count(*) FILTER (s_suppkey % 4 <> 0 AND n_nationkey % 5 <> 1) AS drawn FROM p JOIN supplier ON s_suppkey = a JOIN nation ON n_nationkey = b GROUP BY grp",
    "last_option": "SELECT conv_id, role AS option, length(text)::INT AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC) AS n FROM conversations) WHERE n = 1",
    "measurement_labels": f"WITH {CENTRES}, s AS (SELECT k, x, z, z / 2 AS x2, x * 1.5 AS z2 FROM cen) SELECT k, printf('%.3f m', round(sqrt(pow(x2 - x, 2) + pow(z2 - z, 2)), 3)) AS label, round((x + x2) / 2, 6) AS mx, round((z + z2) / 2, 6) AS mz FROM s",
    "pano_positions": "SELECT c_custkey, round((c_custkey % 256) / 255.0::DOUBLE * 40 - 3, 6) AS x, round((c_nationkey * 10) / 255.0::DOUBLE * 40 + 7, 6) AS y FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "pano_rooms": f"WITH {ROOMS}, c AS (SELECT n_nationkey, i, CASE WHEN i IN (0, 3) THEN x0 ELSE x1 END AS x, CASE WHEN i < 2 THEN y0 ELSE y1 END AS y, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM nation JOIN rooms ON room = n_regionkey, range(4) t(i)), d AS (SELECT *, 0.5 / sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS k FROM c) SELECT n_nationkey, i::INT AS i, round(x + (x - mx) * k, 6) AS x, round(y + (y - my) * k, 6) AS y FROM d",
    "scene_views": "WITH p AS (SELECT n_name AS pano, row_number() OVER (ORDER BY n_name) - 1 AS n FROM nation WHERE n_regionkey <> 2 AND n_regionkey IN (SELECT r_regionkey FROM region)) SELECT pano, f::INT AS face, (n * 6 + f)::INT AS view, printf('view_%04d.png', (n * 6 + f)::INT) AS file FROM p, range(6) t(f)",
    "visibility_labels": f"""WITH f AS (SELECT p_partkey AS face, p_size - 25.0::DOUBLE AS x, p_partkey % 37 - 18.0::DOUBLE AS y, p_retailprice / 100 AS z, p_partkey % 3 / 4.0::DOUBLE AS nx, 0.25::DOUBLE AS ny FROM part), c AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE), (1, 10, 5, 5), (2, -12, 3, 1)) t(cam, tx, ty, tz)),
 a AS (SELECT face, cam, x - tx AS cx, y - ty AS cy, z - tz AS cz, nx, ny, sqrt(1 - nx * nx - ny * ny) AS nz FROM f, c WHERE z - tz > 0.1), b AS (SELECT *, 32 * cx / cz + 32 AS u, 32 * cy / cz + 24 AS v, sqrt(cx * cx + cy * cy + cz * cz) AS dist FROM a), d AS (SELECT *, abs(nx * cx + ny * cy + nz * cz) / dist AS cs, min(cz) OVER (PARTITION BY cam, CAST(floor(u) AS INT), CAST(floor(v) AS INT)) AS drawn FROM b WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 48),
 s AS (SELECT *, row_number() OVER (PARTITION BY face ORDER BY round(cs / (dist * dist), 12) DESC, cam) AS k FROM d WHERE abs(cz - drawn) < 0.05 AND cs > {math.cos(math.radians(75))!r}) SELECT cam, count(*) AS visible, count(*) FILTER (k = 1) AS assigned, sum(face) FILTER (k = 1)::BIGINT AS faces FROM s GROUP BY cam""",
    "mask_classification": f"WITH {MASK}, w AS (SELECT count(*) AS w FROM (SELECT DISTINCT u, v FROM m)), c AS (SELECT id, CASE WHEN count(*) / 2600.0 > 0.70 THEN 'junk' WHEN count(*) / any_value(w)::DOUBLE > 0.95 THEN 'outline' ELSE 'room' END AS class FROM m, w GROUP BY id), k AS (SELECT class, count(DISTINCT (u, v)) AS n, count(DISTINCT id) AS masks FROM m JOIN c USING (id) GROUP BY class) SELECT * FROM k UNION ALL SELECT 'footprint', (SELECT n FROM k WHERE class <> 'junk' ORDER BY CASE WHEN class = 'outline' THEN 0 ELSE 1 END LIMIT 1), 0",
    "prepared_cloud": f"WITH {CLOUD}, v AS (SELECT floor(x / 2) AS vx, CAST(floor(y / 2) AS INT) AS vy, floor(z / 2) AS vz, count(*) AS n, avg(x) AS x FROM pts WHERE z > 5.3 AND z < 90 GROUP BY 1, 2, 3) SELECT vy, count(*) AS voxels, sum(n)::BIGINT AS n, round(sum(x), 4) AS x FROM v GROUP BY vy",
    "dense_clusters": f"""WITH RECURSIVE {UNIT}, e AS (SELECT a.i AS a, b.i AS b FROM un a JOIN un b ON a.i <> b.i WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.12 * 0.12::DOUBLE), core AS (SELECT a AS i FROM e GROUP BY a HAVING count(*) >= 3), ce AS (SELECT a, b FROM e WHERE a IN (SELECT i FROM core) AND b IN (SELECT i FROM core)),
 reach AS (SELECT i AS n, i AS m FROM core UNION SELECT reach.n, ce.b FROM reach JOIN ce ON reach.m = ce.a), comp AS (SELECT n AS i, min(m) AS cluster FROM reach GROUP BY n), edge AS (SELECT a AS i, min(cluster) AS cluster FROM e JOIN comp ON comp.i = e.b WHERE a NOT IN (SELECT i FROM core) GROUP BY a) SELECT cluster, count(*) AS n FROM (SELECT * FROM comp UNION ALL SELECT * FROM edge) GROUP BY cluster""",
    "plane_visibility": "WITH " + PROJ + ", s AS (SELECT cell.pano, pid % 12 AS patch, count(*) AS n, count(*) FILTER (depth <= m + 0.05) AS seen FROM cell JOIN near USING (pano, bu, bv) GROUP BY 1, 2) SELECT pano, patch, n, seen, seen / n >= 0.05 AS visible FROM s",
    "texel_padding": f"WITH {MASK}, f AS (SELECT DISTINCT u, v FROM m WHERE v % 2 = 0 OR u < 10), t AS (SELECT i::INT AS u, j::INT AS v FROM range(51) a(i), range(40) b(j)), d AS (SELECT t.v * 64 + t.u AS t, f.v * 64 + f.u AS f, (t.u - f.u) * (t.u - f.u) + (t.v - f.v) * (t.v - f.v) AS d2 FROM t, f WHERE (t.u, t.v) NOT IN (SELECT (u, v) FROM f)) SELECT t, f, d2::BIGINT AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d2, f) AS n FROM d) WHERE n = 1",
    "room_placement": f"""WITH {ROOMS}, {PIECES}, c AS (SELECT piece, room, a::INT AS a, i::INT AS i, j::INT AS j, x0, y0, x1, y1, CASE WHEN a % 2 = 0 THEN hw ELSE hh END AS hw, CASE WHEN a % 2 = 0 THEN hh ELSE hw END AS hh, x0 + (x1 - x0) * i / 8 AS tx, y0 + (y1 - y0) * j / 8 AS ty FROM rooms, pieces, range(4) q(a), range(9) r(i), range(9) s(j)),
 o AS (SELECT *, greatest(least(tx + hw, x1) - greatest(tx - hw, x0), 0) * greatest(least(ty + hh, y1) - greatest(ty - hh, y0), 0) AS o FROM c), s AS (SELECT *, round(o / (4 * hw * hh + (x1 - x0) * (y1 - y0) - o), 9) AS score FROM o) SELECT piece, room, a, i, j, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY score DESC, room, a, i, j) AS n FROM s) WHERE n = 1""",
    "vertex_snap": f"WITH {PIECES} SELECT piece AS id, 0.0::DOUBLE AS error FROM pieces WHERE piece < 8",
}
