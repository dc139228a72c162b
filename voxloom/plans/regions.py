"""Queries over masks as images, unions of polygons, output lines, staged runs and samples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import morphology as M
from voxloom.operators import points as P
from voxloom.operators import regions as R
from voxloom.operators import stages as S
from voxloom.plans.points import CLOUD, cloud
from voxloom.plans.rings import MASK, mask
from voxloom.session import table

#: Image of a mask, and the radius of the closing disk.
WIDTH, HEIGHT, DISK = 52, 40, 2
SAMPLE, SEED = 50_000, 42
#: Stages of a run; the second is done by hand.
STAGES, MANUAL = 4, (1,)
KINDS = {"view": "run", "purchase": "ok", "error": "fail", "click": "confirm", "signup": "retry"}


def q_mask_closed(spark, sf):
    return M.closed(mask(spark, sf), DISK, WIDTH, HEIGHT).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"))


def q_mask_filled(spark, sf):
    return M.filled(mask(spark, sf), WIDTH, HEIGHT).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"))


def q_mask_cleaned(spark, sf):
    """Closed, filled, and the largest part: the upper boundary of each mask, one row a column."""
    return M.cleaned(mask(spark, sf), DISK, WIDTH, HEIGHT).groupBy("id", "u").agg(F.min("v").alias("top"), F.count(F.lit(1)).alias("n"))


def boxes(spark, sf):
    """Corners of boxes, eight to a plan."""
    k = F.col("p_partkey")
    b = table(spark, sf, "part").select(F.floor(k / 8).alias("grp"), k.alias("ring"), (k * 7 % 10 / 1.0).alias("x0"), (k * 5 % 8 / 1.0).alias("y0"), (k % 4 + 1.0).alias("w"), (k % 3 + 1.0).alias("h"))
    at = F.array(*(F.struct((F.col("x0") + i * F.col("w")).alias("x"), (F.col("y0") + j * F.col("h")).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))))
    return b.select("grp", "ring", F.posexplode(at).alias("seq", "c")).select("grp", "ring", "seq", "c.x", "c.y")


def q_union_shells(spark, sf):
    """Each plan's union of boxes: area, length of outline and corners, holes included."""
    found = R.shells(boxes(spark, sf), 4.0)
    length = F.sqrt(F.pow(F.col("bx") - F.col("ax"), F.lit(2)) + F.pow(F.col("by") - F.col("ay"), F.lit(2)))
    sums = found.groupBy("grp").agg(F.round(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2, 6).alias("area"), F.round(F.sum(length), 6).alias("length"))
    return sums.join(R.corners(found).groupBy("grp").agg(F.count(F.lit(1)).alias("corners")), "grp")


def q_ring_repairs(spark, sf):
    """Bow-ties become two rings, boxes stay one: number of rings and area."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("grp"), (k % 7 + 1.0).alias("w"), (k % 5 + 1.0).alias("h"), (k % 3 == 0).alias("whole"), (k % 11 * 3.0).alias("x0"))
    x = lambda i: F.col("x0") + i * F.col("w")
    at = [(x(0), F.lit(0.0)), (x(1), F.when(F.col("whole"), 0.0).otherwise(F.col("h"))), (x(1), F.when(F.col("whole"), F.col("h")).otherwise(0.0)), (x(0), F.col("h"))]
    ring = s.select("grp", F.lit(0).alias("ring"), F.posexplode(F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in at))).alias("seq", "c")).select("grp", "ring", "seq", "c.x", "c.y")
    return R.shells(ring, 4.0).select("grp", "ring", "area").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("rings"), F.round(F.sum("area"), 6).alias("area"))


def chunks(spark, sf):
    """Output of one process a user, cut anywhere."""
    e = F.col("event_id")
    end = F.when(e % 3 == 0, "").otherwise("\n")
    return table(spark, sf, "events").select("user_id", "event_id", F.concat(F.lit("step "), e.cast("string"), end, F.when(e % 4 == 0, " tail").otherwise(""), F.when(e % 5 == 0, "\n \n").otherwise("")).alias("chunk"))


def q_output_lines(spark, sf):
    return S.lines_of(chunks(spark, sf), "user_id", "event_id", "chunk")


def run_events(events):
    """Events of a user's run."""
    kind = F.lit(None).cast("string")
    for a, b in KINDS.items():
        kind = F.when(F.col("event_type") == a, b).otherwise(kind)
    return events.withColumn("event", kind)


def q_run_states(spark, sf):
    return S.run_states(run_events(table(spark, sf, "events")), "user_id", ["ts", "event_id"], "event", STAGES, MANUAL)


def q_exact_sample(spark, sf):
    """Fifty thousand points of the cloud, or all."""
    return P.exact_sample(cloud(spark, sf).select("pid", "x"), SAMPLE, SEED)


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

DISK_SQL = "st AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in M.disk(DISK)) + ") t(du, dv))"


def closed_sql(src: str, out: str) -> str:
    """SQL of the closing of ``src`` as the table ``out``."""
    return f"""all_px AS (SELECT id, u::INT AS u, v::INT AS v FROM (SELECT DISTINCT id FROM {src}), range({WIDTH}) a(u), range({HEIGHT}) b(v)),
 wide AS (SELECT DISTINCT id, u + du AS u, v + dv AS v FROM {src}, st WHERE u + du BETWEEN 0 AND {WIDTH - 1} AND v + dv BETWEEN 0 AND {HEIGHT - 1}),
 gone AS (SELECT DISTINCT id, u + du AS u, v + dv AS v FROM (SELECT * FROM all_px ANTI JOIN wide USING (id, u, v)), st), {out} AS (SELECT * FROM wide ANTI JOIN gone USING (id, u, v))"""


def filled_sql(src: str, out: str) -> str:
    """SQL of the filling of ``src``: what the border reaches through blank pixels stays blank."""
    return f"""px AS (SELECT id, u::INT AS u, v::INT AS v FROM (SELECT DISTINCT id FROM {src}), range({WIDTH}) a(u), range({HEIGHT}) b(v)), bare AS (SELECT * FROM px ANTI JOIN {src} USING (id, u, v)),
 outer_px AS (SELECT id, u, v FROM bare WHERE u IN (0, {WIDTH - 1}) OR v IN (0, {HEIGHT - 1}) UNION SELECT b.id, b.u, b.v FROM outer_px o JOIN bare b ON o.id = b.id AND abs(o.u - b.u) + abs(o.v - b.v) = 1), {out} AS (SELECT * FROM px ANTI JOIN outer_px USING (id, u, v))"""


SQL = {
    "mask_closed": f"WITH {MASK}, {DISK_SQL}, {closed_sql('m', 'c')} SELECT id, count(*) AS n, sum(u)::BIGINT AS u, sum(v)::BIGINT AS v FROM c GROUP BY id",
    "mask_filled": f"WITH RECURSIVE {MASK}, {filled_sql('m', 'f')} SELECT id, count(*) AS n, sum(u)::BIGINT AS u, sum(v)::BIGINT AS v FROM f GROUP BY id",
    "mask_cleaned": f"""WITH RECURSIVE {MASK}, {DISK_SQL}, {closed_sql('m', 'c')}, {filled_sql('c', 'f')}, r AS (SELECT id, v, min(u) AS lo, max(u) AS hi, count(*) AS n, v * 1000 + min(u) AS k FROM (SELECT *, u - row_number() OVER (PARTITION BY id, v ORDER BY u) AS g FROM f) GROUP BY id, v, g),
 e AS (SELECT a.id, a.k AS a, b.k AS b FROM r a JOIN r b ON a.id = b.id AND abs(a.v - b.v) = 1 AND a.lo <= b.hi AND b.lo <= a.hi), reach AS (SELECT id, k AS n, k AS o FROM r UNION SELECT reach.id, reach.n, e.b FROM reach JOIN e ON reach.id = e.id AND reach.o = e.a),
 c2 AS (SELECT id, n AS k, min(o) AS part FROM reach GROUP BY id, n), s AS (SELECT id, part, sum(n) AS size FROM c2 JOIN r USING (id, k) GROUP BY id, part QUALIFY row_number() OVER (PARTITION BY id ORDER BY sum(n) DESC, part) = 1)
 SELECT id, u::INT AS u, min(v)::INT AS top, count(*) AS n FROM s JOIN c2 USING (id, part) JOIN r USING (id, k), unnest(range(lo, hi + 1)) t(u) GROUP BY 1, 2""",
    "union_shells": """WITH b AS (SELECT p_partkey // 8 AS grp, p_partkey * 7 % 10 AS x0, p_partkey * 5 % 8 AS y0, p_partkey % 4 + 1 AS w, p_partkey % 3 + 1 AS h FROM part), c AS (SELECT DISTINCT grp, x, y FROM b, unnest(range(x0, x0 + w)) s(x), unnest(range(y0, y0 + h)) t(y)),
 l AS (SELECT grp, count(*) FILTER (o.x IS NULL) AS n FROM (SELECT c.grp, c.x + dx AS nx, c.y + dy AS ny FROM c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) t(dx, dy)) q LEFT JOIN c o ON o.grp = q.grp AND o.x = q.nx AND o.y = q.ny GROUP BY q.grp),
 v AS (SELECT grp, vx, vy, sum(CASE WHEN dx = 0 AND dy = 0 THEN 1 WHEN dx = 1 AND dy = 0 THEN 2 WHEN dx = 0 THEN 4 ELSE 8 END) AS k FROM (SELECT grp, x + dx AS vx, y + dy AS vy, dx, dy FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy)) GROUP BY ALL),
 k AS (SELECT grp, sum(CASE WHEN k IN (1, 2, 4, 8, 7, 11, 13, 14) THEN 1 WHEN k IN (6, 9) THEN 2 ELSE 0 END) AS corners FROM v GROUP BY grp)
 SELECT grp, area, n::DOUBLE AS length, corners::BIGINT AS corners FROM (SELECT grp, count(*)::DOUBLE AS area FROM c GROUP BY grp) JOIN l USING (grp) JOIN k USING (grp)""".replace("SELECT grp, count(*) FILTER (o.x IS NULL)", "SELECT q.grp, count(*) FILTER (o.x IS NULL)"),
    "ring_repairs": "SELECT s_suppkey AS grp, CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS rings, round((s_suppkey % 7 + 1) * (s_suppkey % 5 + 1) / CASE WHEN s_suppkey % 3 = 0 THEN 1.0::DOUBLE ELSE 2 END, 6) AS area FROM supplier",
    "output_lines": """WITH c AS (SELECT user_id, event_id, 'step ' || event_id || CASE WHEN event_id % 3 = 0 THEN '' ELSE chr(10) END || CASE WHEN event_id % 4 = 0 THEN ' tail' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN chr(10) || ' ' || chr(10) ELSE '' END AS t FROM events),
 s AS (SELECT user_id, string_split(string_agg(t, '' ORDER BY event_id), chr(10)) AS l FROM c GROUP BY user_id) SELECT user_id, (i - 1)::BIGINT AS n, l[i] AS line FROM s, unnest(generate_series(1, len(l) - 1)) t(i) WHERE trim(l[i]) <> ''""",
    "run_states": f"""WITH RECURSIVE e AS (SELECT user_id, CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())} END AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 f AS (SELECT user_id, 0::BIGINT AS k, 0 AS cur, false AS busy, '{'p' * STAGES}' AS st FROM (SELECT DISTINCT user_id FROM events) UNION ALL
  SELECT f.user_id, e.k, CASE WHEN (event = 'ok' AND busy) OR event = 'confirm' THEN least(cur + 1, {STAGES - 1}) ELSE cur END, CASE WHEN event = 'run' AND NOT busy AND cur <> {MANUAL[0]} THEN true WHEN event IN ('ok', 'fail') THEN false ELSE busy END,
   CASE WHEN event = 'run' AND NOT busy AND cur <> {MANUAL[0]} THEN substr(st, 1, cur) || 'a' || substr(st, cur + 2) WHEN (event = 'ok' AND busy) OR event = 'confirm' THEN substr(st, 1, cur) || 'c' || substr(st, cur + 2)
    WHEN event = 'fail' AND busy THEN substr(st, 1, cur) || 'e' || substr(st, cur + 2) WHEN event = 'retry' THEN substr(st, 1, cur) || 'p' || substr(st, cur + 2) ELSE st END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
 SELECT user_id, cur::INT AS current, busy AS running, st AS stages, k AS seen FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""",
    "exact_sample": f"WITH {CLOUD}, h AS (SELECT pid, x, (pid % 2147483648 * 2654435761 + {SEED * 40503}) % 4294967296 AS h FROM pts) SELECT pid, x FROM h QUALIFY row_number() OVER (ORDER BY h, pid) <= {SAMPLE}",
}
