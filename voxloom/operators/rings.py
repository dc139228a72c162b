"""Rings (polygons), sequences and rasters: windows over ordered rows, and pixel-set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.session import stored


def ring_next(df: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """Adds next_<name>: the value of the following vertex, the last vertex followed by the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"next_{n}": F.coalesce(F.lead(n).over(w), F.first(n).over(whole)) for n in names})


def ring_measures(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Per ring: vertices, shoelace area, perimeter, vertex mean, box and RMS spread about the mean."""
    e = ring_next(df, keys, order, [x, y])
    nx, ny = F.col(f"next_{x}"), F.col(f"next_{y}")
    g = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.sum(F.col(x) * ny - nx * F.col(y))) / 2).alias("area"),
        F.sum(F.sqrt((nx - F.col(x)) * (nx - F.col(x)) + (ny - F.col(y)) * (ny - F.col(y)))).alias("perimeter"),
        F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.max(x) - F.min(x)).alias("width"), (F.max(y) - F.min(y)).alias("height"),
        (F.var_pop(x) + F.var_pop(y)).alias("_v"),
    )
    return g.withColumn("spread", F.sqrt("_v")).drop("_v")


def transform_ring(ring: Column, scale, angle, tx, ty) -> Column:
    """array<struct<x,y>> scaled, rotated and shifted."""
    c, s = F.cos(F.lit(angle)), F.sin(F.lit(angle))
    return F.transform(ring, lambda p: F.struct((scale * (c * p["x"] - s * p["y"]) + tx).alias("x"), (scale * (s * p["x"] + c * p["y"]) + ty).alias("y")))


def transform_about_mean(ring: Column, scale: float, angle: float) -> Column:
    """array<struct<x,y>> scaled and rotated about the mean of its vertices, which goes to the origin."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)
    centred = F.transform(ring, lambda p: F.struct((p["x"] - mean("x")).alias("x"), (p["y"] - mean("y")).alias("y")))
    return transform_ring(centred, scale, angle, 0.0, 0.0)


def expand_ring(ring: Column, margin: float) -> Column:
    """Each vertex pushed away from the vertex mean by ``margin``."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.size(ring)

    def push(p):
        dx, dy = p["x"] - mean("x"), p["y"] - mean("y")
        d = F.sqrt(dx * dx + dy * dy)
        k = F.when(d > 1e-9, F.lit(margin) / d).otherwise(0.0)
        return F.struct((p["x"] + dx * k).alias("x"), (p["y"] + dy * k).alias("y"))

    return F.transform(ring, push)


def fill_gaps(df: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """Linear interpolation of null values over ``at``; the ends are held."""
    back = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(at).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(at))
    df = df.withColumns({"_v0": F.last(value, ignorenulls=True).over(back), "_v1": F.first(value, ignorenulls=True).over(ahead), "_t0": F.last(known, ignorenulls=True).over(back), "_t1": F.first(known, ignorenulls=True).over(ahead)})
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.coalesce(F.try_divide((F.col(at) - F.col("_t0")).cast("double"), (F.col("_t1") - F.col("_t0")).cast("double")), F.lit(0.0))
    return df.withColumn(out, F.coalesce(line, "_v0", "_v1")).drop("_v0", "_v1", "_t0", "_t1")


def circular_median(df: DataFrame, keys: list[str], at: str, n: int, value: str, width: int, out: str) -> DataFrame:
    """Exact running median over ``width`` places of a circle of ``n`` places (0..n-1)."""
    half = width // 2
    shifts = F.array(F.lit(0), F.lit(-n), F.lit(n))
    wide = df.withColumn("_s", F.explode(shifts)).withColumn("_p", F.col(at) + F.col("_s")).where(F.col("_p").between(-half, n - 1 + half))
    w = Window.partitionBy(*keys).orderBy("_p").rangeBetween(-half, half)
    return wide.withColumn(out, F.percentile(value, F.lit(0.5)).over(w)).where("_s = 0").drop("_s", "_p")


def resample(df: DataFrame, keys: list[str], at: str, value: str, last: int, n: int) -> DataFrame:
    """Linear interpolation at ``n`` even places from 0 to ``last``: (keys, i, value)."""
    grid = df.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_x", F.col("i") * (last / (n - 1)))
    grid = grid.withColumn("_lo", F.least(F.floor("_x"), F.lit(last - 1)).cast("int"))
    side = lambda name: df.select(*keys, F.col(at).cast("int").alias("_k"), F.col(value).alias(name))
    lo = grid.join(side("_a").withColumnRenamed("_k", "_lo"), [*keys, "_lo"]).withColumn("_hi", F.col("_lo") + 1)
    both = lo.join(side("_b").withColumnRenamed("_k", "_hi"), [*keys, "_hi"])
    return both.select(*keys, "i", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("_lo"))).alias(value))


def gap_groups(df: DataFrame, keys: list[str], value: str, gap: float, out: str = "grp") -> DataFrame:
    """Numbers the runs of sorted values that no step of ``gap`` or more divides."""
    w = Window.partitionBy(*keys).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) >= gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def local_maxima(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Strict peaks; a plateau counts once, at its middle."""
    w = Window.partitionBy(*keys).orderBy(at)
    run = df.withColumn("_new", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    flat = run.groupBy(*keys, "_run").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.first(value).alias(value))
    v = Window.partitionBy(*keys).orderBy("_run")
    peak = (F.lag(value).over(v) < F.col(value)) & (F.lead(value).over(v) < F.col(value))
    return flat.withColumn("_peak", peak).where("_peak").select(*keys, F.floor((F.col("_first") + F.col("_last")) / 2).alias(at), value)


def merge_runs(df: DataFrame, keys: list[str], order: str, label: str, weight: str, values: list[str]) -> DataFrame:
    """Consecutive rows of one label become one: weighted means of ``values``. Runs do not wrap round, so no row counts twice."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = df.withColumn("_new", F.when(F.lag(label).over(w) == F.col(label), 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return run.groupBy(*keys, "run", label).agg(F.sum(weight).alias(weight), *((F.sum(F.col(v) * F.col(weight)) / F.sum(weight)).alias(v) for v in values))


def line_meet(a: tuple, b: tuple, flat: float = 1e-9) -> tuple[Column, Column]:
    """Where two lines (x, y, dx, dy) cross; the midpoint of their points when parallel."""
    (x, y, dx, dy), (u, v, du, dv) = [[F.col(c) for c in t] for t in (a, b)]
    den = dx * dv - dy * du
    s = F.try_divide((u - x) * dv - (v - y) * du, den)
    ok = F.abs(den) > flat
    return F.when(ok, x + s * dx).otherwise((x + u) / 2), F.when(ok, y + s * dy).otherwise((y + v) / 2)


def dilate(filled: DataFrame, keys: list[str], values: list[str], width: int, height: int, rounds: int, whole: bool = False) -> DataFrame:
    """Empty neighbours of filled texels take the mean of their filled neighbours, round by round; ``whole`` cuts it to whole numbers.

    Only the texels of the last round can have empty neighbours that were not reached, but their
    means take all filled ones; a round is stored, so that plans stay short.
    """
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j))
    filled = filled.select(*keys, "u", "v", *values)
    for k in range(rounds):
        near = filled.withColumn("_o", F.explode(around)).withColumns({"_u": F.col("u") + F.col("_o.i"), "_v": F.col("v") + F.col("_o.j")})
        near = near.where(F.col("_u").between(0, width - 1) & F.col("_v").between(0, height - 1))
        mean = lambda c: F.floor(F.avg(c)).cast("double") if whole else F.avg(c)
        ring = near.groupBy(*keys, F.col("_u").alias("u"), F.col("_v").alias("v")).agg(*(mean(c).alias(c) for c in values))
        filled = filled.unionByName(ring.join(filled, [*keys, "u", "v"], "left_anti"))
        if k + 1 < rounds:
            filled = stored(filled, "texels")
    return filled


def column_edge(pixels: DataFrame, keys: list[str], top: bool) -> DataFrame:
    """First or last set row of every column of a mask."""
    return pixels.groupBy(*keys, "u").agg((F.min("v") if top else F.max("v")).alias("edge"))


def min_area_box(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Smallest box over the directions of a convex ring's edges: (angle, width, height, area)."""
    e = ring_next(df, keys, order, [x, y])
    d = e.select(*keys, F.atan2(F.col(f"next_{y}") - F.col(y), F.col(f"next_{x}") - F.col(x)).alias("angle"))
    pts = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    r = d.join(pts, keys).withColumns({"_p": F.cos("angle") * F.col("_x") + F.sin("angle") * F.col("_y"), "_q": F.cos("angle") * F.col("_y") - F.sin("angle") * F.col("_x")})
    box = r.groupBy(*keys, "angle").agg((F.max("_p") - F.min("_p")).alias("width"), (F.max("_q") - F.min("_q")).alias("height"))
    return box.groupBy(*keys).agg(F.min(F.struct((F.col("width") * F.col("height")).alias("area"), "angle", "width", "height")).alias("_m")).select(*keys, "_m.*")
