"""Queries over logs, records and text formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.operators import text as T
from voxloom.session import table

LINES = """ln AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN '   ' WHEN event_type = 'click' THEN ' [PROGRESS] ' || (event_id % 9) || ' 9 step ' || user_id || ' ' WHEN event_type = 'view' THEN '[PROGRESS] x 9 bad' ELSE 'log ' || user_id END AS line FROM events)"""


def lines(spark, sf):
    e = table(spark, sf, "events")
    line = F.when(F.col("event_type") == "error", "   ").when(F.col("event_type") == "click", F.concat(F.lit(" [PROGRESS] "), (F.col("event_id") % 9).cast("string"), F.lit(" 9 step "), F.col("user_id").cast("string"), F.lit(" ")))
    return e.select("event_id", "event_type", line.when(F.col("event_type") == "view", "[PROGRESS] x 9 bad").otherwise(F.concat(F.lit("log "), F.col("user_id").cast("string"))).alias("line"))


def obj_text(spark, sf):
    s = table(spark, sf, "supplier").where("s_suppkey > 0").select((F.col("s_suppkey") % 5).alias("obj"), "s_suppkey")
    c = F.col("s_suppkey")
    rec = F.array(F.concat(F.lit("usemtl m"), (c % 3).cast("string")), F.format_string("v %d %d 1", c.cast("int"), (c % 7).cast("int")), F.format_string("v %d %d 2.5", (c + 1).cast("int"), (c % 7).cast("int")))
    body = s.select("obj", c, F.posexplode(rec).alias("i", "line")).select("obj", (c * 10 + F.col("i")).alias("n"), "line")
    k = F.row_number().over(Window.partitionBy("obj").orderBy("s_suppkey"))
    seg = s.select("obj", (c * 10 + 5).alias("n"), F.format_string("l %d %d", (k * 2 - 1).cast("int"), (k * 2).cast("int")).alias("line"))
    return body.union(seg)


def q_parse_progress(spark, sf):
    return lines(spark, sf).select("event_id", T.parse_progress(F.col("line")).alias("p")).where("p is not null").select("event_id", "p.*")


def q_route_lines(spark, sf):
    return T.route_lines(lines(spark, sf), "line").groupBy("sink").agg(F.count(F.lit(1)).alias("n"))


def q_obj_segments(spark, sf):
    return T.obj_segments(obj_text(spark, sf)).select("obj", "seg", "material", *(a + c for a in "se" for c in "xyz"))


def q_obj_round_trip(spark, sf):
    seg = T.obj_segments(obj_text(spark, sf))
    again = T.obj_segments(T.obj_lines(seg))
    return again.groupBy("material").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sx"), 4).alias("sx"), F.round(F.sum("ez"), 4).alias("ez"))


def q_ply_to_xyz(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") / 3.0).alias("z")).select("p_partkey", T.xyz_line("x", "y", "z").alias("line"))


def q_cam_files(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), *((F.col("n_nationkey") * (i + 1) / 7.0).alias(f"t{i}") for i in range(3)), *(F.lit(1.0 if i % 4 == 0 else 0.0).alias(f"r{i}") for i in range(9)))
    text = n.select("k", T.cam_text(["t0", "t1", "t2"], [f"r{i}" for i in range(9)], 0.5, 0.5, 0.5).alias("text"))
    v = text.select("k", T.parse_cam(F.col("text")).alias("v"), F.length("text").alias("len"))
    return v.select("k", "len", F.round(F.element_at("v", 1), 9).alias("t0"), F.round(F.element_at("v", 3), 9).alias("t2"), F.size("v").alias("n"))


def q_file_listing(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    name = F.regexp_extract("url", r"/([0-9]+)(?:[?#].*)?$", 1)
    return p.select("page_id", name.try_cast("int").alias("idx"), F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host")).where("idx is not null")


def q_json_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").alias("k"))


def q_json_sink(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("doc"))


def q_json_translation(spark, sf):
    r = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit('{"a": 1, "translation": ['), F.col("n_nationkey").cast("string"), F.lit(".5, -2e1, "), F.when(F.col("n_nationkey") % 4 == 0, "null").otherwise("7"), F.lit("]}")).alias("t"))
    return r.select("n_nationkey", T.json_translation(F.col("t")).alias("v")).where("v is not null").select("n_nationkey", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"), F.element_at("v", 3).alias("z"))


def q_data_uri(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.data_uri(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".PNG").otherwise(".jpg")), F.col("n_name").cast("binary")).alias("uri"))


def q_artifact_resolver(spark, sf):
    p = table(spark, sf, "part")
    listing = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit("d/"), F.col("p_partkey").cast("string")).alias("path"))
    cand = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stage"), F.posexplode(F.array(*(F.concat(F.lit("d/"), (F.col("s_suppkey") * 3 + k * k).cast("string")) for k in range(3)))).alias("rank", "path"))
    return T.first_existing(cand, listing, ["stage"])


def q_missing_paths(spark, sf):
    p = table(spark, sf, "part")
    listing = p.select(F.concat(F.lit("d/"), F.col("p_partkey").cast("string")).alias("path"))
    rec = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("d/"), (F.col("c_custkey") * 2).cast("string")).alias("path"))
    return T.missing_paths(rec, listing).select("c_custkey", "path")


def q_project_merge(spark, sf):
    base = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("new").alias("status"), F.round("s_acctbal", 2).alias("size"))
    patch = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "done").alias("status"), F.lit(1.0).alias("size"))
    return T.merge_patch(base, patch, "id")


def q_stage_latest_state(spark, sf):
    e = table(spark, sf, "events")
    return T.latest_state(e, "user_id", "ts", "event_id", "event_type").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def q_stage_fanout(spark, sf):
    stages = spark.sql("SELECT * FROM VALUES (3, true), (4, false), (7, true) AS t(stage, per_pano)")
    panos = table(spark, sf, "region").select(F.col("r_name").alias("pano"))
    each = stages.where("per_pano").crossJoin(F.broadcast(panos)).select("stage", "pano")
    return each.union(stages.where("not per_pano").select("stage", F.lit(None).cast("string")))


def q_elapsed(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("event_type").agg((F.max(us) - F.min(us)).alias("us"))


def q_tumbling_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return w.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "v")


def q_session_counts(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.session_window("ts", "8 hours"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

OBJ = """s AS (SELECT s_suppkey % 5 AS obj, s_suppkey AS c, CAST(row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) AS INT) AS seg FROM supplier WHERE s_suppkey > 0)"""
SQL = {
    "parse_progress": rf"WITH {LINES}, m AS (SELECT event_id, regexp_extract(trim(line), '^\[PROGRESS\] (\d+) (\d+) (.*)$', ['c', 't', 'm']) AS p FROM ln WHERE regexp_matches(trim(line), '^\[PROGRESS\] (\d+) (\d+) (.*)$')) SELECT event_id, p.c::INT AS current, p.t::INT AS total, p.m AS message FROM m",
    "route_lines": rf"WITH {LINES} SELECT CASE WHEN regexp_matches(trim(line), '^\[PROGRESS\] (\d+) (\d+) (.*)$') THEN 'progress' WHEN trim(line) <> '' THEN 'log' END AS sink, count(*) AS n FROM ln GROUP BY 1",
    "obj_segments": f"WITH {OBJ} SELECT obj, seg, 'm' || (c % 3) AS material, c::DOUBLE AS sx, (c % 7)::DOUBLE AS sy, 1.0::DOUBLE AS sz, (c + 1)::DOUBLE AS ex, (c % 7)::DOUBLE AS ey, 2.5::DOUBLE AS ez FROM s",
    "obj_round_trip": f"WITH {OBJ} SELECT 'm' || (c % 3) AS material, count(*) AS n, round(sum(c::DOUBLE), 4) AS sx, round(sum(2.5::DOUBLE), 4) AS ez FROM s GROUP BY 1",
    "ply_to_xyz": "SELECT p_partkey, printf('%.6f %.6f %.6f', p_size::DOUBLE, p_retailprice, p_partkey / 3.0::DOUBLE) AS line FROM part",
    "cam_files": "SELECT n_nationkey AS k, CAST(length(concat_ws(' ', printf('%.12f', n_nationkey / 7.0::DOUBLE), printf('%.12f', n_nationkey * 2 / 7.0::DOUBLE), printf('%.12f', n_nationkey * 3 / 7.0::DOUBLE))) + 9 * 15 + 1 + 14 + 6 + 1 + 14 + 1 + 14 AS INT) AS len, round(n_nationkey / 7.0::DOUBLE, 9) AS t0, round(n_nationkey * 3 / 7.0::DOUBLE, 9) AS t2, 12 AS n FROM nation",
    "file_listing": r"SELECT page_id, regexp_extract(url, '/([0-9]+)(?:[?#].*)?$', 1)::INT AS idx, regexp_extract(url, '^https?://([^/]+)/', 1) AS host FROM pages WHERE regexp_matches(url, '/([0-9]+)(?:[?#].*)?$')",
    "json_props": "SELECT event_type, count(CAST(props->>'k' AS INT)) AS n, CAST(sum(CAST(props->>'k' AS INT)) AS BIGINT) AS k FROM events GROUP BY 1",
    "json_sink": """SELECT n_nationkey, '{"name":"' || n_name || '","region":' || n_regionkey || '}' AS doc FROM nation""",
    "json_translation": "SELECT n_nationkey, n_nationkey + 0.5::DOUBLE AS x, -20.0::DOUBLE AS y, 7.0::DOUBLE AS z FROM nation WHERE n_nationkey % 4 <> 0",
    "data_uri": "SELECT n_nationkey, 'data:' || CASE WHEN n_nationkey % 2 = 0 THEN 'image/png' ELSE 'image/jpeg' END || ';base64,' || base64(encode(n_name)) AS uri FROM nation",
    "artifact_resolver": "WITH c AS (SELECT s_suppkey AS stage, k AS rank, s_suppkey * 3 + k * k AS p FROM supplier, range(3) t(k)), f AS (SELECT stage, rank, p FROM c WHERE p IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)) SELECT stage, 'd/' || min_by(p, rank) AS path FROM f GROUP BY stage",
    "missing_paths": "SELECT c_custkey, 'd/' || (c_custkey * 2) AS path FROM customer WHERE c_custkey * 2 NOT IN (SELECT p_partkey FROM part)",
    "project_merge": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN 'done' ELSE 'new' END AS status, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE round(s_acctbal, 2) END AS size FROM supplier",
    "stage_latest_state": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_type, epoch_us(ts) AS us FROM r WHERE k = 1",
    "stage_fanout": "SELECT s AS stage, r_name AS pano FROM region, (VALUES (3), (7)) t(s) UNION ALL SELECT 4, NULL",
    "elapsed": "SELECT event_type, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1",
    "tumbling_counts": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    "session_counts": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, k""",
}
