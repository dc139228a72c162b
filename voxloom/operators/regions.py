"""Unions and repairs of polygons as an arrangement of edges: split at crossings, keep the outline, walk the rings.

Edges of one group meet in grid cells. A piece of an edge is on the outline when exactly one of its sides is
inside, and is turned so that the inside lies on its left; pieces that coincide count once. At every corner a
piece goes on to the outgoing piece that turns most to the left, so that parts that touch in a corner stay apart.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators.joins import components
from voxloom.session import stored

#: Decimals to which corners are one, and the step off an edge that finds its sides.
DIGITS, STEP = 9, 1e-6
E = ("ax", "ay", "bx", "by")


def edges_of(rings: DataFrame) -> DataFrame:
    """(grp, ring, e, ax, ay, bx, by) of closed rings given as corners (grp, ring, seq, x, y); edges without length go."""
    w = Window.partitionBy("grp", "ring").orderBy("seq")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = rings.where("x IS NOT NULL AND y IS NOT NULL").withColumns({c: F.round(c, DIGITS) for c in "xy"})
    to = r.select("grp", "ring", F.col("seq").alias("e"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), first("x")).alias("bx"), F.coalesce(F.lead("y").over(w), first("y")).alias("by"))
    return to.where("ax <> bx OR ay <> by")


def _cells(df: DataFrame, size: float) -> DataFrame:
    """Each edge in the cells of its box, a little widened."""
    span = lambda c: F.explode(F.sequence(F.floor((F.least("a" + c, "b" + c) - STEP) / size), F.floor((F.greatest("a" + c, "b" + c) + STEP) / size)))
    return df.withColumn("_cx", span("x")).withColumn("_cy", span("y"))


def pieces(edges: DataFrame, size: float) -> DataFrame:
    """(grp, ax, ay, bx, by) of all edges, split where they cross, touch or overlap others of their group."""
    o = _cells(edges, size).select("grp", F.col("ring").alias("o_ring"), F.col("e").alias("o_e"), *(F.col(c).alias("o_" + c) for c in E), "_cx", "_cy")
    met = _cells(edges, size).join(o, ["grp", "_cx", "_cy"]).where("ring <> o_ring OR e <> o_e").drop("_cx", "_cy").distinct()
    dx, dy, ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("o_bx") - F.col("o_ax"), F.col("o_by") - F.col("o_ay")
    sx, sy = F.col("o_ax") - F.col("ax"), F.col("o_ay") - F.col("ay")
    den = dx * ey - dy * ex
    length = dx * dx + dy * dy
    flat = F.abs(den) < 1e-12
    t, u = F.try_divide(sx * ey - sy * ex, den), F.try_divide(sx * dy - sy * dx, den)
    hit = F.when(~flat & t.between(-1e-9, 1 + 1e-9) & u.between(-1e-9, 1 + 1e-9), t)
    # on one line: the other's ends
    same = flat & (F.abs(sx * dy - sy * dx) < 1e-9)
    end = lambda x, y: F.when(same, ((F.col(x) - F.col("ax")) * dx + (F.col(y) - F.col("ay")) * dy) / length)
    at = met.select("grp", "ring", "e", F.explode(F.array(hit, end("o_ax", "o_ay"), end("o_bx", "o_by"))).alias("t")).where("t > 1e-9 AND t < 1 - 1e-9")
    cuts = at.groupBy("grp", "ring", "e").agg(F.collect_set(F.round("t", 12)).alias("ts"))
    own = edges.join(cuts, ["grp", "ring", "e"], "left").withColumn("ts", F.array_sort(F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0)))))
    part = own.select("grp", *E, F.col("ts"), F.explode(F.sequence(F.lit(0), F.size("ts") - 2)).alias("i"))
    place = lambda c, k: F.round(F.when(F.get("ts", k) == 1, F.col("b" + c)).otherwise(F.col("a" + c) + F.get("ts", k) * (F.col("b" + c) - F.col("a" + c))), DIGITS) + 0.0
    cut = part.select("grp", place("x", F.col("i")).alias("ax"), place("y", F.col("i")).alias("ay"), place("x", F.col("i") + 1).alias("bx"), place("y", F.col("i") + 1).alias("by"))
    back = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    one = cut.select("grp", *(F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(E, ("bx", "by", "ax", "ay"), strict=True)))
    return one.where("ax <> bx OR ay <> by").distinct()


def outline(rings: DataFrame, size: float) -> DataFrame:
    """(grp, ax, ay, bx, by): the outline of the union of each group's rings, inside on the left. Inside a ring is what a ray leaves an odd number of times."""
    edges = stored(edges_of(rings), "edges")
    cut = stored(pieces(edges, size).withColumn("p", F.monotonically_increasing_id()), "pieces")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    norm = F.sqrt(dx * dx + dy * dy)
    side = F.explode(F.array(F.lit(1), F.lit(-1)))
    tests = cut.withColumn("s", side).select("grp", "p", "s", ((F.col("ax") + F.col("bx")) / 2 - F.col("s") * STEP * dy / norm).alias("px"), ((F.col("ay") + F.col("by")) / 2 + F.col("s") * STEP * dx / norm).alias("py"))
    # a point meets the edges of its group in its row of cells
    rows = edges.withColumn("_cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size), F.floor(F.greatest("ay", "by") / size))))
    o = rows.select("grp", "ring", "_cy", *(F.col(c).alias("o_" + c) for c in E))
    crossing = G.edge_crossing("px", "py", "o_ax", "o_ay", "o_bx", "o_by")
    odd = tests.withColumn("_cy", F.floor(F.col("py") / size)).join(o, ["grp", "_cy"]).groupBy("p", "s", "ring").agg((F.count_if(crossing) % 2 == 1).alias("in"))
    sides = odd.where("in").groupBy("p").agg(F.max(F.col("s") == 1).alias("left"), F.max(F.col("s") == -1).alias("right"))
    kept = cut.join(sides, "p").where("left <> right")
    turn = F.col("right")
    return kept.select("grp", *(F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(E, ("bx", "by", "ax", "ay"), strict=True)))


def walked(lines: DataFrame) -> DataFrame:
    """(grp, ring, ax, ay, bx, by) of outline pieces: each piece with its ring, named by one of its pieces."""
    named = stored(lines.withColumn("p", F.monotonically_increasing_id()), "outline")
    back = F.atan2(F.col("ay") - F.col("by"), F.col("ax") - F.col("bx"))
    out = named.select("grp", F.col("p").alias("q"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")).alias("to"))
    met = named.withColumn("back", back).join(out, ["grp", "bx", "by"])
    # counter-clockwise from the way back: the largest is the leftmost turn, and the way back itself comes last
    angle = F.pmod(F.col("to") - F.col("back"), F.lit(2 * math.pi))
    turn = F.round(F.when(angle > 2 * math.pi - 1e-9, 0.0).otherwise(angle), 9)
    nxt = met.groupBy("p").agg(F.max(F.struct(turn.alias("t"), "q"))["q"].alias("q")).select(F.col("p").alias("a"), F.col("q").alias("b"))
    ring = components(nxt)
    return named.join(ring, F.col("p") == F.col("node")).select("grp", F.col("component").alias("ring"), *E)


def alike(rings: DataFrame) -> DataFrame:
    """(grp, once): the smallest of the groups whose rings are the same. A ring is told by the SHA-256 of its corners, a group by the number of its rings and the sums of theirs."""
    known = rings.where("grp IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    at = known.groupBy("grp", "ring").agg(F.array_sort(F.collect_list(F.struct("seq", *(F.round(c, DIGITS).alias(c) for c in "xy")))).alias("c"))
    digest = F.sha2(F.array_join(F.transform("c", lambda s: F.concat_ws(",", s["x"], s["y"])), ";"), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"h{k}") for k in range(4)]
    named = stored(at.select("grp", digest.alias("h")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *parts), "alike")
    same = ["n", *(f"h{k}" for k in range(4))]
    return named.join(named.groupBy(*same).agg(F.min("grp").alias("once")), same).select("grp", "once")


def shells(rings: DataFrame, size: float) -> DataFrame:
    """(grp, ring, ax, ay, bx, by, area) of the rings around the union of each group; holes have a negative area.

    For one ring that crosses itself this is its repair: a bow-tie gives two rings. Groups of the same
    rings share one union; ``ring`` is a name within its group.
    """
    groups = stored(alike(rings), "groups")
    first = rings.join(groups.where("grp = once").select("grp"), "grp", "left_semi")
    lines = stored(walked(outline(first, size)), "rings")
    area = lines.groupBy("grp", "ring").agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))
    found = stored(lines.join(area, ["grp", "ring"]), "areas")
    return groups.join(found.withColumnRenamed("grp", "once"), "once").select("grp", "ring", *E, "area")


def corners(found: DataFrame) -> DataFrame:
    """(grp, ring, x, y, area): corners of the rings; where the outline goes straight on is none.

    The map shell's vertices are the distinct (x, y) of rings with a positive area.
    """
    # a corner where one piece ends and one of the same direction begins is none
    unit = lambda a, b, c: F.round((F.col(b + c) - F.col(a + c)) / F.sqrt(F.pow(F.col("bx") - F.col("ax"), F.lit(2)) + F.pow(F.col("by") - F.col("ay"), F.lit(2))), 7) + 0.0
    d = found.select("grp", "ring", "area", *E, unit("a", "b", "x").alias("dx"), unit("a", "b", "y").alias("dy"))
    came = d.select("grp", "ring", F.col("bx").alias("ax"), F.col("by").alias("ay"), "dx", "dy")
    return d.join(came, ["grp", "ring", "ax", "ay", "dx", "dy"], "left_anti").select("grp", "ring", F.col("ax").alias("x"), F.col("ay").alias("y"), "area")
