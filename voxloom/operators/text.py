"""Line protocols, project records and text geometry formats as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a progress line.
PROGRESS = r"^\[PROGRESS\] (\d+) (\d+) (.*)$"


def parse_progress(line: Column) -> Column:
    """struct(current, total, message), or null where the trimmed line is no progress line; a number over 32 bits is null."""
    t = F.trim(line)
    part = lambda i: F.regexp_extract(t, PROGRESS, i)
    made = F.struct(part(1).try_cast("int").alias("current"), part(2).try_cast("int").alias("total"), part(3).alias("message"))
    return F.when(t.rlike(PROGRESS), made)


def route_lines(lines: DataFrame, line: str) -> DataFrame:
    """Adds progress (struct or null) and sink: 'progress', 'log', or null for blank lines."""
    p = lines.withColumn("progress", parse_progress(F.col(line)))
    return p.withColumn("sink", F.when(F.col("progress").isNotNull(), "progress").when(F.trim(line) != "", "log"))


def obj_vertices(lines: DataFrame) -> DataFrame:
    """(obj, vid from 1, x, y, z) of the ``v`` records of (obj, n, line) text."""
    v = lines.where(F.col("line").rlike(r"^v\s")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    at = lambda i: F.get("p", F.lit(i - 1)).try_cast("double")
    return v.select("obj", F.row_number().over(Window.partitionBy("obj").orderBy("n")).alias("vid"), at(2).alias("x"), at(3).alias("y"), at(4).alias("z"))


def obj_segments(lines: DataFrame) -> DataFrame:
    """Segments of ``l`` records with their end points and the material in force: two joins by 1-based index.

    An end whose vertex is missing or no number is null.
    """
    w = Window.partitionBy("obj").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("material", F.last(F.when(F.col("line").startswith("usemtl "), F.expr("substring(line, 8)")), ignorenulls=True).over(w))
    rec = named.where(F.col("line").rlike(r"^l\s")).withColumn("p", F.split(F.trim("line"), r"\s+"))
    rec = rec.select("obj", F.row_number().over(Window.partitionBy("obj").orderBy("n")).alias("seg"), F.coalesce("material", F.lit("default")).alias("material"), F.get("p", F.lit(1)).try_cast("int").alias("a"), F.get("p", F.lit(2)).try_cast("int").alias("b"))
    v = obj_vertices(lines)
    end = lambda k, s: v.select("obj", F.col("vid").alias(k), *(F.col(c).alias(s + c) for c in "xyz"))
    return rec.join(end("a", "s"), ["obj", "a"], "left").join(end("b", "e"), ["obj", "b"], "left").drop("a", "b")


def obj_lines(segments: DataFrame) -> DataFrame:
    """Text of (obj, seg, material, s*, e*): material, two vertices and a line record each, in order of seg."""
    fmt = lambda p: F.format_string("v %.6f %.6f %.6f", *(F.col(p + c) for c in "xyz"))
    rec = F.array(F.concat(F.lit("usemtl "), F.col("material")), fmt("s"), fmt("e"), F.format_string("l %d %d", (F.col("seg") * 2 - 1).cast("int"), (F.col("seg") * 2).cast("int")))
    return segments.select("obj", "seg", F.posexplode(rec).alias("i", "line")).select("obj", (F.col("seg") * 4 + F.col("i")).alias("n"), "line")


def xyz_line(x, y, z) -> Column:
    return F.format_string("%.6f %.6f %.6f", F.col(x), F.col(y), F.col(z))


def cam_text(t: list, rot: list, focal: float, px: float, py: float) -> Column:
    """Two lines: position and rotation with 12 decimals; focal length, distortion, aspect and centre."""
    # a null number makes the whole text null: left out, it would shift the numbers after it
    nums = [x for c in [*t, *rot] for x in (F.lit(" "), F.when(F.col(c).isNotNull(), F.format_string("%.12f", F.col(c))))]
    return F.concat(*nums[1:], F.lit(f"\n{focal:.12f} 0 0 1 {px:.12f} {py:.12f}"))


def parse_cam(text: Column) -> Column:
    """array<double> of the numbers of the first line."""
    return F.transform(F.split(F.element_at(F.split(text, "\n"), 1), " "), lambda s: s.try_cast("double"))


def json_translation(text: Column) -> Column:
    """Three numbers of a "translation" list, without parsing the whole document; null if any is missing."""
    num = r"\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*"
    pattern = r'"translation"\s*:\s*\[' + num + "," + num + "," + num + r"\]"
    out = F.array(*(F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2, 3)))
    return F.when(~F.exists(out, lambda v: v.isNull()), out)


def data_uri(name: Column, content: Column) -> Column:
    """data: URI with the type by suffix."""
    kind = F.when(F.lower(name).endswith(".png"), "image/png").when(F.lower(name).rlike(r"\.jpe?g$"), "image/jpeg").otherwise("application/octet-stream")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


def first_existing(candidates: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Of ranked candidate paths, the first that exists per key."""
    found = candidates.join(listing.select("path").distinct(), "path", "left_semi")
    return found.groupBy(*keys).agg(F.min(F.struct("rank", "path")).alias("_m")).select(*keys, "_m.path")


def missing_paths(records: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of records that no listing has."""
    return records.where("path is not null").join(listing.select("path").distinct(), "path", "left_anti")


def merge_patch(projects: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Projects with the non-null fields of a patch laid over; ids without a project are ignored."""
    names = [c for c in projects.columns if c != key]
    p = patches.select(key, *(F.col(c).alias(f"_p_{c}") for c in names if c in patches.columns))
    joined = projects.join(p, key, "left")
    return joined.select(key, *(F.coalesce(f"_p_{c}", c).alias(c) if c in patches.columns else F.col(c) for c in names))


def latest_state(events: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """Last value per key by time, ties to the larger ``tie``."""
    return events.groupBy(key).agg(F.max(F.struct(at, tie, value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value), F.col(f"_m.{at}").alias(at))
