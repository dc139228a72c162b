"""Queries that write files and read them back, with SQL of what they must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.plans.points import CLOUD, cloud
from voxloom.sources import codecs
from voxloom.sources import sinks as S
from voxloom.session import shared_folder, table


def written(spark, files, kind):
    """The folder into which the files were written."""
    folder = shared_folder(spark, kind)
    S.write_files(files, folder)
    if not S.is_whole(spark, folder):
        raise OSError(f"{folder} is not whole")
    return folder


def mesh(spark, sf):
    """Strips of triangles over the parts of each brand."""
    p = table(spark, sf, "part").select(F.concat("p_brand", F.lit(".ply")).alias("name"), F.col("p_partkey").alias("vid"), (F.col("p_size") * 1.0).alias("x"), (F.col("p_retailprice") / 100).alias("y"), (F.col("p_partkey") % 7 * 0.5).alias("z"))
    n = p.groupBy("name").agg(F.sort_array(F.collect_list("vid")).alias("v")).where(F.size("v") >= 3)
    faces = n.select("name", F.posexplode(F.transform(F.slice("v", 1, F.size("v") - 2), lambda k, i: F.struct(k.alias("v0"), F.element_at("v", i + 2).alias("v1"), F.element_at("v", i + 3).alias("v2")))).alias("fid", "t")).select("name", F.col("fid").cast("long").alias("fid"), "t.*")
    return p, faces


def q_ply_round_trip(spark, sf):
    pts = cloud(spark, sf).where("r <= 1").select(F.format_string("cloud_%02d.ply", (F.col("pid") % 7).cast("int")).alias("name"), "pid", *"xyz", *"rgb")
    back = codecs.read_ply(spark, written(spark, S.ply_files(pts), "ply"))
    return back.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("n"), *(F.round(F.sum(c), 4).alias(c) for c in "xyz"), F.round(F.sum(F.col("r") * 255), 2).alias("r"))


def q_mesh_round_trip(spark, sf):
    v, f = S.read_mesh(spark, written(spark, S.mesh_files(*mesh(spark, sf)), "mesh"))
    at = f.join(v.select("name", F.col("vid").alias("v0"), "x", "y"), ["name", "v0"])
    return at.groupBy("name").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("y"), 4).alias("y"))


def q_label_files(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_brand", F.lit(".vec")).alias("name"), F.col("p_partkey").alias("fid"), (F.col("p_size") % 5).cast("long").alias("label"))
    folder = written(spark, S.label_files(p), "labels")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.select("name", (F.length("content") / 8).cast("long").alias("n"), F.sha2(F.lower(F.hex("content")), 256).alias("digest"))


def q_npy_round_trip(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.format_string("d%d.npy", (F.col("l_suppkey") % 3).cast("int")).alias("name"), (F.col("l_partkey") % 40).cast("int").alias("v"), F.col("l_quantity").cast("int").alias("u")).agg(F.min("l_extendedprice").alias("d"))
    back = S.read_npy(spark, written(spark, S.npy_files(d), "npy"))
    return back.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("u").alias("u"), F.max("v").alias("v"), F.round(F.sum("d"), 2).alias("d"))


def q_png_round_trip(spark, sf):
    c = cloud(spark, sf).where("r <= 1 AND g <= 1")
    px = c.groupBy(F.format_string("i%d.png", (F.col("pid") % 3).cast("int")).alias("name"), F.col("x").cast("int").alias("u"), F.floor("y").cast("int").alias("v")).agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("b").alias("b"))
    back = codecs.read_pixels(spark, written(spark, S.png_files(px), "png"))
    return back.groupBy(F.element_at(F.split("img", "/"), -1).alias("name")).agg(F.max("u").alias("u"), F.max("v").alias("v"), F.count_if(F.col("b") > 0).alias("n"), F.round(F.sum(F.col("b") * 255)).cast("long").alias("b"))


def q_glb_export(spark, sf):
    v, f = mesh(spark, sf)
    named = [t.withColumn("name", F.regexp_replace("name", r"\.ply$", ".glb")) for t in (v, f)]
    folder = written(spark, S.glb_files(*named, extras={"unit": "meter", "scale": 1.0}), "glb")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return S.glb_facts(files)


def q_layout_files(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.format_string("p%d.json", F.floor(F.col("o_custkey") / 10).cast("int")).alias("name")).agg(F.sort_array(F.collect_list(F.struct((F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 31).cast("double").alias("y")))).alias("corners"))
    folder = written(spark, S.layout_files(c.withColumn("source", F.lit("floor"))), "layouts")
    back = spark.read.schema("layout_corners array<array<double>>, source string").option("wholetext", True).json(folder).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"))
    return back.select("name", "source", F.size("layout_corners").alias("n"), F.round(F.aggregate("layout_corners", F.lit(0.0), lambda a, p: a + p[0]), 4).alias("x"))


def q_mtl_files(spark, sf):
    n = table(spark, sf, "nation").select(F.format_string("r%d.mtl", F.col("n_regionkey").cast("int")).alias("name"), F.format_string("m%02d", F.col("n_nationkey").cast("int")).alias("material"), *((F.col("n_nationkey") * k % 10 / 10.0).alias(c) for k, c in ((1, "r"), (3, "g"), (7, "b"))))
    folder = written(spark, S.mtl_files(n), "mtl")
    lines = spark.read.text(folder).where("value LIKE 'Kd %'").select(F.split("value", " ").alias("p"))
    return lines.select(F.element_at("p", 2).try_cast("double").alias("r"), F.element_at("p", 4).try_cast("double").alias("b")).groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("b"), 6).alias("b"))


def q_listed_files(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.lit("mask_"), F.col("n_nationkey"), F.when(F.col("n_regionkey") == 1, ".txt").otherwise(".png")).alias("name"), F.col("n_name").cast("binary").alias("content"))
    found = S.list_files(spark, written(spark, n, "masks"), "*.png")
    return found.select("name", F.regexp_extract("name", r"_(\d+)\.", 1).try_cast("int").alias("idx"), "length")


QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}

MESH = "p AS (SELECT p_brand, p_partkey AS vid, p_size * 1.0::DOUBLE AS x, p_retailprice / 100 AS y, lead(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS v2 FROM part)"
SQL = {
    "ply_round_trip": f"WITH {CLOUD} SELECT printf('cloud_%02d.ply', (pid % 7)::INT) AS name, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z, round(sum(round_even(r * 255, 0)), 2) AS r FROM pts WHERE r <= 1 GROUP BY 1",
    "mesh_round_trip": f"WITH {MESH} SELECT p_brand || '.ply' AS name, count(*) AS faces, round(sum(x), 4) AS x, round(sum(y), 4) AS y FROM p WHERE v2 IS NOT NULL GROUP BY 1",
    "label_files": "SELECT p_brand || '.vec' AS name, count(*) AS n, sha256(string_agg('0' || p_size % 5 || '00000000000000', '' ORDER BY p_partkey)) AS digest FROM part GROUP BY 1",
    "npy_round_trip": "WITH d AS (SELECT printf('d%d.npy', (l_suppkey % 3)::INT) AS name, (l_partkey % 40)::INT AS v, l_quantity::INT AS u, min(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2, 3) SELECT name, count(*) AS n, max(u) AS u, max(v) AS v, round(sum(d), 2) AS d FROM d GROUP BY 1",
    "png_round_trip": f"WITH {CLOUD}, p AS (SELECT printf('i%d.png', (pid % 3)::INT) AS name, x::INT AS u, floor(y)::INT AS v, max(b) AS b FROM pts WHERE r <= 1 AND g <= 1 GROUP BY 1, 2, 3) SELECT name, max(u) AS u, max(v) AS v, count(*) FILTER (b > 0) AS n, sum(round_even(b * 255, 0))::BIGINT AS b FROM p GROUP BY 1",
    "glb_export": f"WITH {MESH} SELECT p_brand || '.glb' AS name, count(*) AS vertices, count(v2) AS triangles, 'meter' AS unit FROM p GROUP BY 1",
    "layout_files": "SELECT printf('p%d.json', (o_custkey // 10)::INT) AS name, 'floor' AS source, count(*)::INT AS n, round(sum((o_orderkey % 97)::DOUBLE), 4) AS x FROM orders GROUP BY 1",
    "mtl_files": "SELECT n_nationkey % 10 / 10.0::DOUBLE AS r, count(*) AS n, round(sum(n_nationkey * 7 % 10 / 10.0::DOUBLE), 6) AS b FROM nation GROUP BY 1",
    "listed_files": "SELECT 'mask_' || n_nationkey || '.png' AS name, n_nationkey::INT AS idx, length(n_name)::BIGINT AS length FROM nation WHERE n_regionkey <> 1",
}
