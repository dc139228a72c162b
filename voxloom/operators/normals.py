"""Normals of point clouds: nearest neighbours within a radius, least-variance directions, consistent signs.

Points meet in cells of the radius, so the work is bounded by the density of the cloud: thin it to
voxels first. Signs spread along a minimum spanning forest of the neighbour graph, built in
rounds: every part takes its lightest edge to another part, and parts that are
linked become one with the sign of the edge. Parts at least halve in a round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import joins as J
from voxloom.session import stored

N = ("nx", "ny", "nz")


def neighbours(points: DataFrame, k: int, radius: float) -> DataFrame:
    """(pid, o, d2, ox, oy, oz): the ``k`` nearest points within the radius, the point itself among them; ties to the smaller id."""
    dims = list("xyz")
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("pid", *dims)
    right = known.select(F.col("pid").alias("o"), *(F.col(c).alias("o" + c) for c in dims), *(c.alias(f"_k{i}") for i, c in enumerate(J.cells(dims, radius))))
    met = J.spread(known, dims, radius).join(right, ["_k0", "_k1", "_k2"])
    d2 = F.round(J.squared([F.col(c) for c in dims], [F.col("o" + c) for c in dims]), 12)
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("d2", "o"))
    return met.withColumn("d2", d2).where(F.col("d2") <= radius * radius).withColumn("_n", rank).where(F.col("_n") <= k).select("pid", "o", "d2", "ox", "oy", "oz")


def least_variance(near: DataFrame) -> DataFrame:
    """(pid, n, nx, ny, nz): the direction in which a point's neighbours vary least, its largest part positive; +z where there are under three."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = near.groupBy("pid").agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop("o" + a, "o" + b).alias("v" + a + b) for a, b in names))

    def run(frames):
        for f in frames:
            v = {k: f["v" + k].to_numpy() for k in names}
            m = np.stack([np.stack([v["xx"], v["xy"], v["xz"]], 1), np.stack([v["xy"], v["yy"], v["yz"]], 1), np.stack([v["xz"], v["yz"], v["zz"]], 1)], 1)
            e = np.linalg.eigh(m)[1][:, :, 0] if len(f) else np.zeros((0, 3))
            top = np.take_along_axis(e, np.abs(e).round(9).argmax(axis=1)[:, None], axis=1) if len(f) else np.zeros((0, 1))
            e = np.where(top < 0, -e, e)
            e[f["n"].to_numpy() < 3] = (0.0, 0.0, 1.0)
            yield pd.DataFrame({"pid": f["pid"], "n": f["n"], "nx": e[:, 0], "ny": e[:, 1], "nz": e[:, 2]})

    return sums.mapInPandas(run, "pid long, n long, nx double, ny double, nz double")


def forest_signs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, part, sign): each node's part of the graph and its sign against the part's root, along a minimum spanning forest.

    ``edges``: (a, b, w, same) with a < b once each; ``same`` is 1 or -1. Equal weights go by (a, b), so
    links between parts close no ring but that of two parts that chose the same edge.
    """
    label = stored(nodes.select("pid", F.col("pid").alias("part"), F.lit(1).alias("sign")), "parts")
    open_ = edges
    while True:
        at = lambda p: label.select(F.col("pid").alias(p), F.col("part").alias("p" + p), F.col("sign").alias("s" + p))  # noqa: B023, E731
        open_ = stored(open_.select("a", "b", "w", "same").join(at("a"), "a").join(at("b"), "b").where("pa <> pb"), "links")
        if open_.isEmpty():
            return label
        rel = F.col("same") * F.col("sa") * F.col("sb")
        side = lambda p, q: open_.select(F.col("p" + p).alias("part"), F.struct("w", "a", "b", F.col("p" + q).alias("up"), rel.alias("rel")).alias("e"))  # noqa: B023, E731
        best = stored(side("a", "b").unionByName(side("b", "a")).groupBy("part").agg(F.min("e").alias("e")).select("part", "e.up", "e.rel"), "chosen")
        back = best.select(F.col("part").alias("up"), F.col("up").alias("_up"))
        # of two parts that chose each other the smaller one is the root
        root = (F.col("_up") == F.col("part")) & (F.col("part") < F.col("up"))
        tree = stored(best.join(back, "up", "left").select("part", F.when(root, F.col("part")).otherwise(F.col("up")).alias("up"), F.when(root, 1).otherwise(F.col("rel")).alias("rel")), "tree")
        while True:
            higher = tree.select(F.col("part").alias("up"), F.col("up").alias("_up"), F.col("rel").alias("_rel"))
            nxt = stored(tree.join(higher, "up").select("part", F.col("_up").alias("up"), (F.col("rel") * F.when(F.col("up") == F.col("_up"), 1).otherwise(F.col("_rel"))).alias("rel"), (F.col("up") != F.col("_up")).alias("rose")), "tree")
            tree = nxt.drop("rose")
            if nxt.where("rose").isEmpty():
                break
        step = label.join(tree, "part", "left")
        label = stored(step.select("pid", F.coalesce("up", "part").alias("part"), (F.col("sign") * F.coalesce("rel", F.lit(1))).alias("sign")), "parts")


def oriented_normals(points: DataFrame, k: int = 30, radius: float = 0.1) -> DataFrame:
    """(pid, part, n, nx, ny, nz): unit normals with consistent signs; in each part the highest point's looks up.

    ``points``: (pid, x, y, z), pid unique; a null coordinate leaves a point out. n is the number of neighbours used.
    """
    near = stored(neighbours(points, k, radius), "neighbours")
    flat = stored(least_variance(near), "normals")
    pairs = near.where("pid <> o").select(F.least("pid", "o").alias("a"), F.greatest("pid", "o").alias("b")).distinct()
    end = lambda p: flat.select(F.col("pid").alias(p), *(F.col(c).alias(p + c) for c in N))
    dot = G.dot(tuple("a" + c for c in N), tuple("b" + c for c in N))
    edges = stored(pairs.join(end("a"), "a").join(end("b"), "b").select("a", "b", F.round(1 - F.abs(dot), 12).alias("w"), F.when(dot < 0, -1).otherwise(1).alias("same")), "edges")
    signs = forest_signs(edges, flat)
    every = stored(flat.join(signs, "pid").join(points.select("pid", "z"), "pid"), "signed")
    up = every.groupBy("part").agg(F.max_by(F.col("sign") * F.col("nz"), F.struct("z", -F.col("pid"))).alias("_up"))
    turn = F.col("sign") * F.when(F.col("_up") < 0, -1).otherwise(1)
    return every.join(up, "part").select("pid", "part", "n", *((turn * F.col(c)).alias(c) for c in N))
