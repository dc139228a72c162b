"""Morphology of pixel masks kept as rows (id, u, v): closing with a disk, filling of holes, the largest part.

Every step is a join on pixel keys. What grows is the pixels of all masks; one mask is an image of width x height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.joins import components
from voxloom.session import stored

KEY = ["id", "u", "v"]
CROSS = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def disk(radius: int) -> list[tuple[int, int]]:
    """Steps to the pixels of a disk around one."""
    r = range(-radius, radius + 1)
    return [(a, b) for a in r for b in r if a * a + b * b <= radius * radius]


def moved(pixels: DataFrame, steps: list[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Distinct pixels of the image that a step leads to."""
    to = F.explode(F.array(*(F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in steps)))
    return pixels.select("id", to.alias("_p")).select("id", "_p.u", "_p.v").where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)).distinct()


def blank(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels of the image that a mask doesn't hold."""
    line = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    every = pixels.select("id").distinct().withColumn("u", line(width)).withColumn("v", line(height))
    return every.join(pixels.select(*KEY), KEY, "left_anti")


def closed(pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Dilation by a disk, then erosion; what lies outside the image erodes nothing."""
    wide = stored(moved(pixels, disk(radius), width, height), "wide")
    return wide.join(moved(blank(wide, width, height), disk(radius), width, height), KEY, "left_anti")


def parts(pixels: DataFrame) -> DataFrame:
    """(id, u, v, part): parts connected by sides; a part is named by the id, row and column of its first pixel."""
    # 20 bits each for row and column
    named = stored(pixels.select(*KEY, (F.col("id").cast("long") * (1 << 40) + F.col("v").cast("long") * (1 << 20) + F.col("u")).alias("n")).distinct(), "pixels")
    right = named.select("id", (F.col("u") - 1).alias("u"), "v", F.col("n").alias("b")).unionByName(named.select("id", "u", (F.col("v") - 1).alias("v"), F.col("n").alias("b")))
    edges = named.join(right, KEY).select(F.col("n").alias("a"), "b")
    return named.join(components(edges), F.col("n") == F.col("node"), "left").select(*KEY, F.coalesce("component", "n").alias("part"))


def filled(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The mask with its holes: blank parts that do not touch the image's border."""
    empty = parts(blank(pixels, width, height))
    rim = (F.col("u") == 0) | (F.col("v") == 0) | (F.col("u") == width - 1) | (F.col("v") == height - 1)
    holes = empty.join(empty.where(rim).select("part").distinct(), "part", "left_anti")
    return pixels.select(*KEY).distinct().unionByName(holes.select(*KEY))


def largest(pixels: DataFrame) -> DataFrame:
    """The pixels of each mask's largest part; of equal ones that whose first pixel comes first by rows."""
    every = stored(parts(pixels), "parts")
    size = every.groupBy("id", "part").agg(F.count(F.lit(1)).alias("n"))
    best = size.groupBy("id").agg(F.max(F.struct("n", (-F.col("part")).alias("p"))).alias("m")).select("id", (-F.col("m.p")).alias("part"))
    return every.join(best, ["id", "part"]).select(*KEY)


def cleaned(pixels: DataFrame, radius: int, width: int, height: int) -> DataFrame:
    """Closed, filled, and only the largest part."""
    near = stored(closed(pixels, radius, width, height), "closed")
    return largest(stored(filled(near, width, height), "filled"))
