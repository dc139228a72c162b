"""Dominant directions: average-link clusters of patch normals, and vanishing points of image lines."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import arcs as A
from voxloom.operators.kernels import icosphere
from voxloom.session import stored

N = ("nx", "ny", "nz")


def one_sided(n: tuple) -> tuple[Column, Column, Column]:
    """A normal turned to one side: z up for steep ones (abs(z) > 0.5), else the larger of x and y positive."""
    x, y, z = (G.col(c) for c in n)
    lead = F.when(F.abs(z) > 0.5, z).otherwise(F.when(F.abs(x) >= F.abs(y), x).otherwise(y))
    return tuple(F.when(lead < 0, -c).otherwise(c) for c in (x, y, z))


def average_link(patches: DataFrame, scene: str, degrees: float) -> DataFrame:
    """(scene, pid, label): average-link clusters of patch normals by their angle without sign, cut at ``degrees``; the label is the least pid.

    Merging goes in rounds: all clusters of all scenes that are each other's nearest (ties to the smaller label) and
    near enough become one at once, which gives the clusters of one-by-one merging because a merged cluster
    is never nearer to a third than its nearer part was. A row is a pair of clusters of one scene with summed angles
    and their number; patches are the planes of one scan, a bounded number.
    """
    p = patches.select(scene, "pid", *(v.alias(c) for v, c in zip(one_sided(N), N, strict=True)))
    o = p.select(scene, F.col("pid").alias("b"), *(F.col(c).alias("o" + c) for c in N))
    angle = F.acos(G.clamp(F.abs(G.dot(N, tuple("o" + c for c in N))), 0.0, 1.0))
    pairs = stored(p.withColumnRenamed("pid", "a").join(o, scene).where("a <> b").select(scene, "a", "b", angle.alias("s"), F.lit(1).cast("long").alias("m")), "pairs")
    label = stored(p.select(scene, "pid", F.col("pid").alias("label")), "labels")
    while True:
        mean = F.round(F.col("s") / F.col("m"), 12)
        near = pairs.groupBy(scene, "a").agg(F.min(F.struct(mean.alias("d"), "b")).alias("e")).select(scene, "a", "e.b", "e.d")
        near = stored(near.where(F.col("d") <= math.radians(degrees)), "nearest")
        other = near.select(scene, F.col("a").alias("b"), F.col("b").alias("a"))
        merged = stored(near.join(other, [scene, "a", "b"]).where("a < b").select(scene, F.col("b").alias("old"), F.col("a").alias("new")), "merged")
        if merged.isEmpty():
            return label
        to = lambda d, c: d.join(merged.select(scene, F.col("old").alias(c), F.col("new").alias("_" + c)), [scene, c], "left").withColumn(c, F.coalesce("_" + c, c)).drop("_" + c)  # noqa: B023, E731
        label = stored(to(label, "label"), "labels")
        pairs = stored(to(to(pairs, "a"), "b").where("a <> b").groupBy(scene, "a", "b").agg(F.sum("s").alias("s"), F.sum("m").alias("m")), "pairs")


def dominant_directions(patches: DataFrame, scene: str = "scene", degrees: float = 10.0, snap: float = 15.0) -> DataFrame:
    """(scene, label, n, weight, x, y, z, snapped): weighted mean normal of each cluster, set to the nearest axis when within ``snap`` degrees.

    ``patches``: (scene, pid, nx, ny, nz, weight). A cluster of no weight, or whose normals cancel out, keeps a zero direction.
    """
    label = average_link(patches, scene, degrees)
    p = patches.select(scene, "pid", "weight", *(v.alias(c) for v, c in zip(one_sided(N), N, strict=True)))
    both = p.join(label, [scene, "pid"]).groupBy(scene, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"), *(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col(c)), F.sum("weight")), F.lit(0.0)).alias(c) for c in N))
    size = G.norm(N) + 1e-8
    mean = both.withColumns({c: F.col(c) / size for c in N})
    part = [F.abs(c) for c in N]
    best = F.greatest(*part)
    near = F.acos(G.clamp(best, 0.0, 1.0)) < math.radians(snap)
    # the first axis of those equally near
    axis = F.when(part[0] == best, 0).when(part[1] == best, 1).otherwise(2)
    one = lambda k: F.when(axis == k, F.when(F.col(N[k]) < 0, -1.0).otherwise(1.0)).otherwise(0.0)
    return mean.select(scene, "label", "n", "weight", *(F.when(near, one(k)).otherwise(F.col(c)).alias(a) for k, (c, a) in enumerate(zip(N, "xyz", strict=True))), near.alias("snapped"))


#: A line votes for the points within this cosine of its circle; rounds at most.
ON_CIRCLE, ROUNDS = 0.05, 20


def vote_rounds(lines: DataFrame, level: int = 5, rounds: int = ROUNDS) -> list[tuple[int, int, tuple[float, float, float]]]:
    """(point, votes, direction) of each round: the point of the half sphere that lies on most circles wins, and its lines leave.

    ``lines``: (id, nx, ny, nz), unit normals. Ties go to the first point. The points are a
    fixed number; a round takes the votes of the lines that leave off the tally, so that
    every line meets the sphere twice in all.
    """
    spark: SparkSession = lines.sparkSession
    half = A.sphere(spark, level)
    half = half.where(F.col("q") < (10 * 4**level + 2) // 2)
    on = F.abs(G.dot(N, ("x", "y", "z"))) < ON_CIRCLE
    # a fixed number of points
    votes = lambda d: d.crossJoin(F.broadcast(half)).where(on).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    left = stored(lines.select("id", *N), "lines")
    tally = stored(half.join(votes(left), "q", "left").select("q", *"xyz", F.coalesce("n", F.lit(0)).alias("n")), "tally")
    out = []
    for _ in range(rounds):
        if left.isEmpty():
            break
        win = tally.orderBy(F.col("n").desc(), "q").first()
        out.append((win["q"], win["n"], (win["x"], win["y"], win["z"])))
        far = F.abs(G.dot(N, tuple(F.lit(win[c]) for c in "xyz"))) > ON_CIRCLE
        gone = left.where(~far)
        tally = stored(tally.join(votes(gone).withColumnRenamed("n", "_n"), "q", "left").select("q", *"xyz", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n")), "tally")
        left = stored(left.where(far), "lines")
    return out


def vanishing_points(found: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Three directions out of those of the rounds (twenty at most), right-handed.

    The first triple whose pairwise |cos| are under 0.1; else the first pair under 0.15 of any triple
    and its cross product; else the first two and theirs. None for under two directions.
    """
    dot = lambda a, b: abs(sum(x * y for x, y in zip(a, b, strict=True)))
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    if len(found) < 2:
        return []
    rings = [(t, [(t[i], t[(i + 1) % 3]) for i in range(3)]) for t in combinations(found, 3)]
    whole = next((t for t, sides in rings if all(dot(*s) < 0.1 for s in sides)), None)
    if whole is None:
        a, b = next((s for _, sides in rings for s in sides if dot(*s) < 0.15), found[:2])
        whole = (a, b, cross(a, b))
    a, b, c = whole
    if sum(x * y for x, y in zip(cross(a, b), c, strict=True)) < 0:
        c = tuple(-v for v in c)
    return [a, b, c]


#: Angle in degrees within which a winner silences its neighbours, and lines held against the sphere at once.
SILENT, LINES = 30.0, 256


def suppressed_votes(lines: DataFrame, circles: bool, level: int = 5, rounds: int = 3) -> DataFrame:
    """(round, q, votes): winners among the points of a sphere, each silencing the points within SILENT degrees of its axis.

    ``lines``: unit vectors (x, y, z). With ``circles`` they are normals of great circles and a
    point's votes are the circles within ON_CIRCLE of it; else they are directions, and its votes
    are the largest absolute cosine to one of them. The smaller q wins a tie; lines with
    a null take no part, and without lines nobody wins. The sphere's size is fixed, so tasks
    hand on one row a point.
    """
    spark = lines.sparkSession
    # the points as the table of the sphere has them
    points = icosphere(level).round(12)
    known = lines.select(*"xyz").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")

    def vote(frames):
        total = None
        for f in frames:
            d = f[list("xyz")].to_numpy()
            for at in range(0, len(d), LINES):
                cosine = np.abs(points @ d[at : at + LINES].T)
                new = (cosine < ON_CIRCLE).sum(axis=1) if circles else cosine.max(axis=1)
                total = new if total is None else total + new if circles else np.maximum(total, new)
        if total is not None:
            yield pd.DataFrame({"q": np.arange(len(points)), "votes": np.round(total.astype(float), 9)})

    votes = known.mapInPandas(vote, "q int, votes double").groupBy("q").agg((F.sum if circles else F.max)("votes").alias("votes"))
    left = stored(votes.join(A.sphere(spark, level), "q"), "votes")
    found = []
    for k in range(rounds):
        win = left.orderBy(F.col("votes").desc(), "q").first()
        if win is None:
            break
        found.append((k, win["q"], win["votes"]))
        left = left.where(F.abs(G.dot(tuple("xyz"), tuple(F.lit(win[c]) for c in "xyz"))) <= math.cos(math.radians(SILENT)))
    return spark.createDataFrame(found, "round int, q int, votes double")
