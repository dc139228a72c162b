"""Spatial and relational joins: trees of cells, grid buckets, range joins, components."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.session import bounded, stored


#: Levels of the tree of cells at most; candidates of a cell that is not cut further, and most in one list.
MAX_DEPTH, FEW, MANY = 24, 24, 1024


def squared(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda s, t: s + t, [(x - y) * (x - y) for x, y in zip(a, b, strict=True)])


def within(df: DataFrame, dims: list[str], centres: DataFrame, centre: str, radius: float) -> DataFrame:
    """Rows with each centre within the radius: the columns of ``df`` and ``centre``."""
    grid = [f"_k{i}" for i in range(len(dims))]
    right = spread(centres.select(F.col(centre).alias("centre"), *dims), dims, radius).withColumnsRenamed({d: f"_b{d}" for d in dims})
    met = df.withColumns(dict(zip(grid, cells(dims, radius), strict=True))).join(right, grid)
    return met.where(squared([F.col(d) for d in dims], [F.col(f"_b{d}") for d in dims]) <= radius * radius).select(*df.columns, "centre")


def near(df: DataFrame, key: list[str], dims: list[str], centres: DataFrame, centre: str, radius: float, size: float) -> DataFrame:
    """(key, centre, nearest): each row with the nearest centre and with all within the radius. ``key`` names one position."""
    own = nearest(df, key, centres, centre, dims, size).where("near IS NOT NULL").select(*key, F.col("near").alias("centre"), F.lit(True).alias("nearest"))
    at = df.select(*key, *(d for d in dims if d not in key)).distinct()
    both = own.unionByName(within(at, dims, centres, centre, radius).select(*key, "centre", F.lit(False).alias("nearest")))
    return both.groupBy(*key, "centre").agg(F.max("nearest").alias("nearest"))


def cells(dims: list[str], size: float) -> list[Column]:
    return [F.floor(F.col(d) / size) for d in dims]


def spread(df: DataFrame, dims: list[str], size: float) -> DataFrame:
    """Each row in its cell and all neighbours (3 ** dims copies): columns _k0, _k1, ..."""
    own = cells(dims, size)
    around = F.array(*(F.struct(*((c + o).alias(f"_k{i}") for i, (c, o) in enumerate(zip(own, offs, strict=True)))) for offs in product((-1, 0, 1), repeat=len(dims))))
    return df.withColumn("_s", F.explode(around)).select(*df.columns, *(F.col(f"_s._k{i}") for i in range(len(dims))))


def pairs_within(df: DataFrame, key: str, dims: list[str], radius: float) -> DataFrame:
    """(a, b, d2) of all pairs a < b within the radius, by an equi-join on grid cells."""
    right = df.select(F.col(key).alias("b"), *(F.col(d).alias(f"_b{d}") for d in dims), *(c.alias(f"_k{i}") for i, c in enumerate(cells(dims, radius))))
    left = spread(df.select(F.col(key).alias("a"), *dims), dims, radius)
    joined = left.join(right, [f"_k{i}" for i in range(len(dims))]).where("a < b")
    return joined.withColumn("d2", squared([F.col(d) for d in dims], [F.col(f"_b{d}") for d in dims])).where(F.col("d2") <= radius * radius).select("a", "b", "d2")


def beyond_radius(df: DataFrame, others: DataFrame, dims: list[str], radius: float) -> DataFrame:
    """Rows with no other point within the radius (anti join on cells and distance)."""
    right = others.select(*(F.col(d).alias(f"_b{d}") for d in dims), *(c.alias(f"_k{i}") for i, c in enumerate(cells(dims, radius))))
    hit = spread(df, dims, radius).join(right, [f"_k{i}" for i in range(len(dims))]).where(squared([F.col(d) for d in dims], [F.col(f"_b{d}") for d in dims]) <= radius * radius)
    return df.join(hit.select(*df.columns).distinct(), df.columns, "left_anti")


def nearest(df: DataFrame, key: str | list[str], refs: DataFrame, ref_key: str, dims: list[str], size: float = 1.0) -> DataFrame:
    """(key, near, d2): exact nearest reference of each row, ties to the smaller key; both null without one.

    Branch and bound down a tree of cells, for all rows of a cell at once: a reference stays a
    candidate of a cell if it is no further from its box than some reference surely is
    from all of it. Cells that hold rows are cut until few candidates are left, however dense
    or far the references lie; then each row meets the candidates of its cell. References at one
    place count once. ``size`` is not needed and does not change the result. Rows with a
    coordinate that is null or NaN have no nearest; equal keys are taken as one row.
    """
    key = [key] if isinstance(key, str) else key
    known = reduce(lambda a, c: a & c, [F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double")) for d in dims])
    none = [F.lit(None).cast(refs.schema[ref_key].dataType).alias("near"), F.lit(None).cast("double").alias("d2")]
    at, grid, up, to = ([f"{p}{i}" for i in range(len(dims))] for p in ("_b", "_k", "_u", "_a"))
    places = stored(refs.where(known).groupBy(*(F.col(d).cast("double").alias(c) for d, c in zip(dims, at, strict=True))).agg(F.min(ref_key).alias("near")), "places")
    n = places.count()
    if n == 0:
        return df.select(*key, *none)
    rows = stored(df.where(known).dropDuplicates(key).select(*key, *(F.col(d).cast("double").alias(c) for d, c in zip(dims, to, strict=True))), "rows")
    ends = lambda t, names: t.agg(*(f(c) for c in names for f in (F.min, F.max))).first()
    both = [[v for v in pair if v is not None] for pair in zip(ends(places, at), ends(rows, to), strict=True)]
    low = [min(v) for v in both[::2]]
    width = max(max(h) - l for h, l in zip(both[1::2], low, strict=True)) or 1.0
    # few references need no small cells; boxes are wider by what rounding may move a row
    depth = MAX_DEPTH if n > 1000 else min(MAX_DEPTH, n.bit_length() + 4)
    pad = 1e-13 * (width + max(abs(v) for pair in both for v in pair))
    deep = [F.least(F.floor((F.col(c) - l) / (width / 2**depth)), F.lit(2**depth - 1)).cast("long") for c, l in zip(to, low, strict=True)]
    held = stored(rows.groupBy(*(c.alias(k) for k, c in zip(grid, deep, strict=True))).agg(F.count(F.lit(1)).alias("_n")), "cells")
    cand = places.select(*(F.lit(0).cast("long").alias(k) for k in grid), *at, "near")
    cut, level, leaves = held.select(*(F.lit(0).cast("long").alias(k) for k in grid)).limit(1), 0, []
    while True:
        step = min(max(1, 4 // len(dims)), depth - level) if n > FEW else 0
        level += step
        here = held.select(*(F.shiftright(k, depth - level).alias(k) for k in grid), "_n").groupBy(*grid).agg(F.sum("_n").alias("_n"))
        kids = stored(here.withColumns({u: F.shiftright(k, step) for u, k in zip(up, grid, strict=True)}).join(cut.withColumnsRenamed(dict(zip(grid, up, strict=True))), up, "left_semi"), "kids")
        met = cand.withColumnsRenamed(dict(zip(grid, up, strict=True))).join(kids, up)
        side = width / 2**level
        edges = [(l + F.col(k) * side - pad, l + (F.col(k) + 1) * side + pad) for l, k in zip(low, grid, strict=True)]
        least = reduce(lambda a, b: a + b, [o * o for o in (F.greatest(a - F.col(c), F.col(c) - b, F.lit(0.0)) for c, (a, b) in zip(at, edges, strict=True))])
        most = reduce(lambda a, b: a + b, [o * o for o in (F.greatest(F.col(c) - a, b - F.col(c)) for c, (a, b) in zip(at, edges, strict=True))])
        bound = stored(met.groupBy(*grid).agg(F.min(most).alias("_most")), "bounds")
        kept = stored(met.join(bound, grid).where(least <= F.col("_most") * (1 + 1e-9)).select(*grid, *at, "near", "_n"), "candidates")
        sizes = kept.groupBy(*grid).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
        # cutting a cell of no more rows than parts costs more than to let them meet its candidates
        sizes = stored(sizes.withColumn("_done", (F.col("_c") <= FEW) | (F.col("_c") <= MANY) & (F.col("_n") <= 16) | F.lit(level == depth)), "sizes")
        leaves.append((level, kept.join(sizes.where("_done").select(*grid, (F.col("_c") > MANY).alias("_many")), grid)))
        cut = sizes.where("NOT _done").select(*grid)
        if cut.isEmpty():
            break
        cand = kept.drop("_n").join(cut, grid, "left_semi")
    near = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_level", F.lit(v)) for v, t in leaves])
    lists = stored(near.where("NOT _many").groupBy("_level", *grid).agg(F.collect_list(F.struct(*at, "near")).alias("_l")), "lists")
    inside = F.explode(F.array(*(F.struct(F.lit(v).alias("_level"), *(F.shiftright(c, depth - v).alias(k) for k, c in zip(grid, deep, strict=True))) for v, _ in leaves)))
    placed = rows.withColumn("_at", inside).select(*rows.columns, "_at.*")
    d2 = lambda c: reduce(lambda a, b: a + b, [(F.col(t) - c(b)) * (F.col(t) - c(b)) for t, b in zip(to, at, strict=True)])
    one = placed.join(lists, ["_level", *grid]).select(*key, F.array_min(F.transform("_l", lambda p: F.struct(d2(lambda b: p[b]).alias("d2"), p["near"].alias("near")))).alias("_m"))
    found = one.select(*key, "_m.near", "_m.d2").unionByName(df.where(~known).select(*key, *none))
    crowd = near.where("_many")
    if crowd.isEmpty():
        return found
    best = placed.join(crowd.drop("_n", "_many"), ["_level", *grid]).groupBy(*key).agg(F.min(F.struct(d2(F.col).alias("d2"), "near")).alias("_m"))
    return found.unionByName(best.select(*key, "_m.near", "_m.d2"))


def tile_grid(df: DataFrame, x: str, y: str, size: float, overlap: float) -> DataFrame:
    """(tx, ty, core and extended bounds) over the box of the points; cores are clipped to the box, extents grow by the overlap."""
    e = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    steps = lambda lo, hi: F.sequence(F.lit(0), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / size).cast("int") - 1, F.lit(0)))
    grid = e.withColumn("tx", F.explode(steps("x0", "x1"))).withColumn("ty", F.explode(steps("y0", "y1")))
    core = grid.select("tx", "ty", (F.col("x0") + F.col("tx") * size).alias("cx0"), F.least(F.col("x0") + (F.col("tx") + 1) * size, F.col("x1")).alias("cx1"), (F.col("y0") + F.col("ty") * size).alias("cy0"), F.least(F.col("y0") + (F.col("ty") + 1) * size, F.col("y1")).alias("cy1"), "x0", "x1", "y0", "y1")
    return core.select("tx", "ty", "cx0", "cx1", "cy0", "cy1", (F.col("cx0") - overlap).alias("ex0"), F.least(F.col("cx1") + overlap, F.col("x1")).alias("ex1"), (F.col("cy0") - overlap).alias("ey0"), F.least(F.col("cy1") + overlap, F.col("y1")).alias("ey1"))


def tile_members(df: DataFrame, x: str, y: str, x0: float, y0: float, size: float, overlap: float) -> DataFrame:
    """Each point once per tile whose extended box holds it; owner marks its half-open core."""
    span = lambda c, o: F.sequence(F.greatest(F.ceil((F.col(c) - o - overlap) / size).cast("int") - 1, F.lit(0)), F.floor((F.col(c) - o + overlap) / size).cast("int"))
    both = df.withColumn("tx", F.explode(span(x, x0))).withColumn("ty", F.explode(span(y, y0)))
    inside = lambda c, o, t: F.col(c).between(F.lit(o) + F.col(t) * size - overlap, F.lit(o) + (F.col(t) + 1) * size + overlap)
    own = lambda c, o, t: F.floor((F.col(c) - o) / size) == F.col(t)
    return both.where(inside(x, x0, "tx") & inside(y, y0, "ty")).withColumn("owner", own(x, x0, "tx") & own(y, y0, "ty"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node is linked with, by rounds of stars.

    A round ties the larger neighbours of every node to its least neighbour, then the smaller ones; paths
    shrink by halves. The edges of a round are stored once, and a count and checksum taken as they
    are written tell when a round has changed nothing. Then every edge leads to its component's least node.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    every = stored(pairs.distinct(), "edges")
    links, before = every.where("u <> v"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        seen = Observation()
        links = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "stars")
        now = (seen.get["n"], seen.get["x"])
        if now == before:
            break
        before = now
    nodes = every.select(F.col("u").alias("node")).union(every.select("v")).distinct()
    return nodes.join(links.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def closest_approach(p: list[str], d: list[str], q: list[str], e: list[str]) -> dict[str, Column]:
    """s, t and gap of the nearest points p + s d and q + t e of two lines; null when parallel."""
    p, d, q, e = ([F.col(c) for c in v] for v in (p, d, q, e))
    w = G.sub(p, q)
    a, b, c, f, g = G.dot(d, d), G.dot(d, e), G.dot(e, e), G.dot(d, w), G.dot(e, w)
    den = a * c - b * b
    s, t = F.try_divide(b * g - c * f, den), F.try_divide(a * g - b * f, den)
    gap = G.norm(tuple(w[i] + s * d[i] - t * e[i] for i in range(3)))
    return {"s": s, "t": t, "gap": gap}


#: Vectors of a block at most, and rows of one that meet another at once.
SIDE, STEP = 1024, 64


def in_blocks(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(ids, values) of blocks of up to SIDE rows (key, ``_`` + key: array of numbers), stored; null and missing numbers are NaN."""

    def values(column: pa.ListArray) -> np.ndarray:
        flat = np.append(column.values.to_numpy(zero_copy_only=False).astype(float), np.nan)
        first, past = column.offsets.to_numpy()[:-1, None], column.offsets.to_numpy()[1:, None]
        past = np.where(column.is_null().to_numpy(zero_copy_only=False)[:, None], first, past)
        at = first + np.arange(width)
        return flat[np.where(at < past, at, len(flat) - 1)]

    def out(ids, held):
        return pa.RecordBatch.from_pydict({"ids": pa.array([pa.concat_arrays(ids)], pa.list_(pa.int64())), "values": [np.concatenate(held).tobytes()]})

    def cut(batches):
        ids, held, n = [], [], 0
        for batch in batches:
            own, of = batch.column(key), values(batch.column("_" + key))
            at = 0
            while at < len(own):
                more = min(SIDE - n, len(own) - at)
                ids.append(own[at : at + more])
                held.append(of[at : at + more])
                n, at = n + more, at + more
                if n == SIDE:
                    yield out(ids, held)
                    ids, held, n = [], [], 0
        if n:
            yield out(ids, held)

    kept = stored(rows, "vectors").select(F.col(key).cast("long").alias(key), F.col("_" + key).cast("array<double>").alias("_" + key))
    return stored(kept.repartition(kept.count() // (SIDE * 15 // 16) + 1).mapInArrow(cut, "ids array<long>, values binary"), "blocks")


def agreements(left: DataFrame, a: str, right: DataFrame, b: str, width: int, limit: float) -> DataFrame:
    """(a, b, n) of all pairs: places of the vectors ``_a`` and ``_b`` that differ by less than the limit; a null or missing number agrees with none.

    Both sides lie in stored blocks, and each pair of blocks is one array program, bounded in memory. Tasks read the
    blocks again and do not shuffle them: copies for every block of the other side would grow with the square.
    """

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, o_ids = (batch.column(c)[r].values for c in ("ids", "o_ids"))
                p, q = (np.frombuffer(batch.column(c)[r].as_py()).reshape(-1, width) for c in ("values", "o_values"))
                q = np.ascontiguousarray(q.T)
                for at in range(0, len(p), STEP):
                    part = p[at : at + STEP]
                    n, d = np.zeros((len(part), q.shape[1]), dtype=np.int32), np.empty((len(part), q.shape[1]))
                    for k in range(width):
                        np.subtract(part[:, k, None], q[k], out=d)
                        n += np.abs(d, out=d) < limit
                    own = np.repeat(np.arange(at, at + len(part)), len(o_ids))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.concat_arrays([o_ids] * len(part)), pa.array(n.ravel().astype(np.int64))], names=[a, b, "n"])

    x, y = in_blocks(left, a, width), in_blocks(right, b, width)
    both = x.join(y.select(F.col("ids").alias("o_ids"), F.col("values").alias("o_values")).hint("shuffle_replicate_nl"))
    return bounded(both).mapInArrow(run, f"{a} long, {b} long, n long")


def mutual_nearest(pairs: DataFrame, a: str, b: str, distance: str) -> DataFrame:
    """Pairs that are each other's nearest; ties to the smaller partner."""
    near_b = pairs.groupBy(a).agg(F.min(F.struct(distance, b)).alias("_m")).select(a, F.col(f"_m.{b}").alias(b), F.col(f"_m.{distance}").alias(distance))
    near_a = pairs.groupBy(b).agg(F.min(F.struct(distance, a)).alias("_m")).select(b, F.col(f"_m.{a}").alias(a))
    return near_b.join(near_a, [a, b])
