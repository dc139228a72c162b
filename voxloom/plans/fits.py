"""Queries that fit rings to rings, and the vote with suppressed neighbours; SQL where it can say the same."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxloom.operators import arcs as A
from voxloom.operators import directions as D
from voxloom.operators import fits as X
from voxloom.plans.joins import ARCS, VEC, arcs, vectors
from voxloom.session import stored, table

#: Scales of the first sweep, the step of its angles in degrees, and the pieces of a plan.
LOW, HIGH, COUNT, TURN, PIECES = 0.3, 2.0, 50, 5, 4


def ring(*points):
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def angle_shape(w, h, cut, turn=None, by=1.0, x=0.0, y=0.0):
    """An L of w x h without its upper right part, turned by radians, scaled and moved."""
    at = [(F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h * (1 - cut)), (w * (1 - cut), h * (1 - cut)), (w * (1 - cut), h), (F.lit(0.0), h)]
    c, s = (F.lit(1.0), F.lit(0.0)) if turn is None else (F.cos(turn), F.sin(turn))
    return ring(*((by * (c * a - s * b) + x, by * (s * a + c * b) + y) for a, b in at))


def plan_scales(pieces):
    n = pieces.select("plan").distinct().select("plan", F.explode(F.sequence(F.lit(0), F.lit(COUNT - 1))).alias("no"))
    return n.withColumn("scale", LOW + (HIGH - LOW) * F.col("no") / (COUNT - 1))


def angled(spark, sf):
    """A piece and its room of every supplier, four a plan; pieces are smaller, turned, and of other proportions."""
    k = F.col("s_suppkey")
    wide, high = k % 4 + 2.0, k % 3 + 2.0
    piece = angle_shape(wide + k % 5 / 10.0, high, 0.3 + k % 3 / 10.0, F.radians(k * 37 % 360), 0.8)
    room = angle_shape(wide, high, F.lit(0.4), None, 1.0, k % 7, k % 5)
    return stored(table(spark, sf, "supplier").select(F.floor(k / PIECES).alias("plan"), k.alias("piece"), piece.alias("ring"), room.alias("room")), "shapes")


def told(found):
    return found.select("plan", "piece", *(F.round(c, 6).alias(c) for c in ("scale", "total", "iou", "angle", "tx", "ty")))


def q_scale_sweep(spark, sf):
    """Coarse sweep of every plan over 50 scales and 72 angles, then 60 scales and 41 angles around its best."""
    pieces = angled(spark, sf)
    turns = pieces.withColumn("angles", F.transform(F.sequence(F.lit(0), F.lit(359), F.lit(TURN)), lambda a: a.cast("double")))
    coarse = stored(X.scale_sweep(turns, plan_scales(pieces)), "coarse")
    return told(X.scale_sweep(*X.fine_input(pieces, coarse)))


def q_scale_sweep_boxes(spark, sf):
    """The same sweep over boxes and quarter turns."""
    k = F.col("s_suppkey")
    box = lambda w, h, x, y: ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    zero = F.lit(0.0)
    s = table(spark, sf, "supplier").select(F.floor(k / PIECES).alias("plan"), k.alias("piece"), box((k % 5 + 2) / 2.0, (k % 3 + 1) / 1.5, zero, zero).alias("ring"), box(k % 4 + 2.0, k % 3 + 2.0, k % 7 + 0.0, k % 5 + 0.0).alias("room"))
    s = s.withColumn("angles", F.array(*(F.lit(90.0 * i) for i in range(4))))
    return told(X.scale_sweep(s, plan_scales(s)))


def q_aligned_rings(spark, sf):
    """Every supplier's ring with a spike, turned by a quarter and shrunk, put back on the ring without it."""
    k = F.col("s_suppkey")
    quarter = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    c, s = (F.element_at(F.array(*(F.lit(float(q[i])) for q in quarter)), (k % 4 + 1).cast("int")) for i in range(2))
    wide, high = k % 4 + 3.0, k % 3 + 2.0
    target = angle_shape(wide, high, F.lit(0.4), None, 1.0, k % 7, k % 5)
    spiked = F.concat(target, ring((F.lit(0.0) + k % 7, high / 2 + k % 5), (k % 7 - 0.1 * (k % 6), high / 2 + k % 5 - 0.2)))
    source = F.transform(spiked, lambda p: F.struct((0.5 * (c * p["x"] - s * p["y"])).alias("x"), (0.5 * (s * p["x"] + c * p["y"])).alias("y")))
    found = X.align_rings(table(spark, sf, "supplier").select(k.alias("id"), target.alias("target"), source.alias("source")), 2.0)
    return found.select("id", "angle", *(F.round(c, 3).alias(c) for c in ("scale", "x", "y", "error")))


def q_suppressed_votes(spark, sf):
    """Three winners of the arcs' circles (form 2) and of the vectors' directions (form 3)."""
    v = vectors(spark, sf)
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    flat = D.suppressed_votes(arcs(spark, sf).select(*(F.col("n" + c).alias(c) for c in "xyz")), True)
    solid = D.suppressed_votes(v.where(n > 1e-9).select(*((F.col(c) / n).alias(c) for c in "xyz")), False)
    return flat.withColumn("form", F.lit(2)).unionByName(solid.withColumn("form", F.lit(3)))


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

_SILENT = repr(math.cos(math.radians(D.SILENT)))
_ROUNDS = ", ".join(
    f"w{f}{k} AS (SELECT * FROM v{f}{k} ORDER BY votes DESC, q LIMIT 1), v{f}{k + 1} AS (SELECT a.* FROM v{f}{k} a, w{f}{k} b WHERE abs(a.x * b.x + a.y * b.y + a.z * b.z) <= {_SILENT})" for f in (2, 3) for k in range(3)
)

SQL = {
    "suppressed_votes": f"""WITH {ARCS}, {VEC}, {A.sphere_sql(5)}, u AS (SELECT x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM v) WHERE n > 1e-9),
 v20 AS MATERIALIZED (SELECT s.q, s.x, s.y, s.z, count(*) FILTER (abs(s.x * nx + s.y * ny + s.z * nz) < {D.ON_CIRCLE})::DOUBLE AS votes FROM sphere s, arcs GROUP BY ALL), v30 AS MATERIALIZED (SELECT s.q, s.x, s.y, s.z, round(max(abs(s.x * u.x + s.y * u.y + s.z * u.z)), 9) AS votes FROM sphere s, u GROUP BY ALL), {_ROUNDS}
 """
    + " UNION ALL ".join(f"SELECT CAST({k} AS INT) AS round, CAST(q AS INT) AS q, votes, CAST({f} AS INT) AS form FROM w{f}{k}" for f in (2, 3) for k in range(3)),
    "scale_sweep_boxes": f"""WITH s AS (SELECT s_suppkey // {PIECES} AS plan, s_suppkey AS piece, (s_suppkey % 5 + 2) / 2.0::DOUBLE AS w, (s_suppkey % 3 + 1) / 1.5::DOUBLE AS h, CAST(s_suppkey % 4 + 2 AS INT) AS rw, CAST(s_suppkey % 3 + 2 AS INT) AS rh, (s_suppkey % 7)::DOUBLE AS ox, (s_suppkey % 5)::DOUBLE AS oy FROM supplier),
 n AS (SELECT CAST(i AS INT) AS no, {LOW}::DOUBLE + ({HIGH}::DOUBLE - {LOW}::DOUBLE) * i / {COUNT - 1} AS scale FROM range({COUNT}) t(i)),
 spots AS (SELECT *, 0 AS place, ox + rw / 2.0::DOUBLE AS tx, oy + rh / 2.0::DOUBLE AS ty FROM s UNION ALL SELECT s.*, 1 + (i - 1) * (rh - 1) + j - 1, ox + i, oy + j FROM s, range(1, 10) a(i), range(1, 10) b(j) WHERE i < rw AND j < rh),
 p AS (SELECT *, scale * CASE turn WHEN 0 THEN w ELSE h END / 2 AS hw, scale * CASE turn WHEN 0 THEN h ELSE w END / 2 AS hh FROM spots, n, (VALUES (0), (1)) q(turn)),
 c AS (SELECT *, greatest(least(tx + hw, ox + rw) - greatest(tx - hw, ox), 0) * greatest(least(ty + hh, oy + rh) - greatest(ty - hh, oy), 0) AS o FROM p),
 b AS (SELECT plan, piece, no, scale, turn, tx, ty, round(o / (4 * hw * hh + rw * rh - o), 9) AS iou, row_number() OVER (PARTITION BY piece, no ORDER BY round(o / (4 * hw * hh + rw * rh - o), 9) DESC, turn, place) AS k FROM c),
 t AS (SELECT plan, no, round(sum(iou), 8) AS total, row_number() OVER (PARTITION BY plan ORDER BY round(sum(iou), 8) DESC, no) AS k FROM b WHERE k = 1 GROUP BY plan, no)
 SELECT plan, piece, round(scale, 6) AS scale, round(total, 6) AS total, round(iou, 6) AS iou, turn * 90.0::DOUBLE AS angle, round(tx, 6) AS tx, round(ty, 6) AS ty FROM b JOIN t USING (plan, no) WHERE b.k = 1 AND t.k = 1""",
}
