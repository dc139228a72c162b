"""Point-table operators: projection, occlusion, blending, grids, voxels, error statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.session import stored

#: Table contracts of the spatial engine.
POINTS = "pid long, x double, y double, z double, r double, g double, b double"
POSES = "pano string, rot array<array<double>>, t array<double>"


def poses(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(pano, yaw in radians about +z, position x, y, z) to a flat pose table."""
    named = ", ".join(f"('{p}', {yaw!r}D, {x!r}D, {y!r}D, {z!r}D)" for p, yaw, x, y, z in rows)
    df = spark.sql(f"SELECT * FROM VALUES {named} AS t(pano, yaw, tx, ty, tz)")
    c, s = F.cos("yaw"), F.sin("yaw")
    return df.select("pano", "tx", "ty", "tz", c.alias("c"), s.alias("s"))


def project(points: DataFrame, cams: DataFrame, width: int, height: int, min_depth: float = 0.1) -> DataFrame:
    """Every point into every panorama: adds pano, u, v, depth; points nearer than min_depth go.

    Cameras are a handful of rows by nature, so they travel to the points.
    """
    both = points.crossJoin(F.broadcast(cams))
    dx, dy, dz = F.col("x") - F.col("tx"), F.col("y") - F.col("ty"), F.col("z") - F.col("tz")
    cam = both.select(*points.columns, "pano", (F.col("c") * dx + F.col("s") * dy).alias("cx"), (F.col("c") * dy - F.col("s") * dx).alias("cy"), dz.alias("cz"))
    deep = cam.withColumn("depth", G.norm(("cx", "cy", "cz"))).where(F.col("depth") > min_depth)
    u, v, _ = G.equirect(("cx", "cy", "cz"), width, height)
    return deep.withColumn("u", u).withColumn("v", v).drop("cx", "cy", "cz")


def visible(projected: DataFrame, width: int, height: int, margin: float = 0.05) -> DataFrame:
    """Rows within ``margin`` of the least depth of their (pano, cell).

    The least depths are a partial aggregate and so cheap for crowded cells; the join back
    is one that adaptive execution can split when a cell is hot.
    """
    celled = projected.withColumn("bu", G.cell("u", width)).withColumn("bv", G.cell("v", height))
    near = celled.groupBy("pano", "bu", "bv").agg(F.min("depth").alias("near"))
    return celled.join(near, ["pano", "bu", "bv"]).where(F.col("depth") <= F.col("near") + margin).drop("near")


def blend_idw(points: DataFrame, seen: DataFrame, power: int = 2, floor: float = 1e-6) -> DataFrame:
    """Colours of ``points`` from their sightings, weighed by depth ** -power; unseen points are black."""
    w = F.lit(1.0) / F.greatest(F.pow("depth", F.lit(float(power))), F.lit(floor))
    total = lambda c: (F.sum(F.col(c) * w) / F.sum(w)).alias(f"_{c}")
    agg = seen.groupBy("pid").agg(total("r"), total("g"), total("b"), F.count(F.lit(1)).alias("n_views"))
    joined = points.select("pid").join(agg, "pid", "left")
    return joined.select("pid", *(F.coalesce(f"_{c}", F.lit(0.0)).alias(c) for c in "rgb"), F.coalesce("n_views", F.lit(0)).alias("n_views"))


def extent(points: DataFrame, *names: str) -> dict[str, float]:
    """Least and greatest of each column: one row to the driver."""
    return points.agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("min", F.min), ("max", F.max)))).first().asDict()


def density(points: DataFrame, size: int = 256, pad: float = 0.1) -> DataFrame:
    """Counts per density pixel and their share of the greatest; uniform scale with padding on all sides."""
    e = extent(points, "x", "y")
    if e["min_x"] is None:
        return points.select(F.lit(0).alias("px"), F.lit(0).alias("py"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share")).limit(0)
    side = max(e["max_x"] - e["min_x"], e["max_y"] - e["min_y"])
    full = side * (1 + 2 * pad) or 1.0
    at = lambda c: F.least(F.greatest(F.bround((F.col(c) - e[f"min_{c}"] + side * pad) / full * (size - 1)).cast("int"), F.lit(0)), F.lit(size - 1))
    cells = points.select(at("x").alias("px"), at("y").alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    # one row: the greatest count
    top = cells.agg(F.max("n").alias("top"))
    return cells.crossJoin(F.broadcast(top)).select("px", "py", "n", (F.col("n") / F.col("top")).alias("share"))


def quantized(points: DataFrame, xy: float, z: float) -> DataFrame:
    """Distinct points on a grid, halves to even."""
    return points.select(G.half_even("x", xy).alias("x"), G.half_even("y", xy).alias("y"), G.half_even("z", z).alias("z")).distinct()


def histogram_peak(df: DataFrame, value: Column, low: float, high: float, n: int, weight: Column | None = None) -> DataFrame:
    """(bin, centre, mass) of the fullest bin, the first of equals; one row, none for no input."""
    mass = F.count(F.lit(1)).cast("double") if weight is None else F.sum(weight)
    bins = df.select(G.histogram_bin(value, low, high, n).alias("bin"), *([] if weight is None else [weight.alias("_w")])).where("bin is not null")
    bins = bins.groupBy("bin").agg((mass if weight is None else F.sum("_w")).alias("mass"))
    best = bins.orderBy(F.col("mass").desc(), "bin").limit(1)
    return best.select("bin", (F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / n)).alias("centre"), "mass")


def voxels(points: DataFrame, size: float, values: tuple[str, ...]) -> DataFrame:
    """One row per occupied voxel: its count and the means of ``values``; the grid starts half a voxel below the minimum."""
    e = extent(points, "x", "y", "z")
    at = [F.floor((F.col(c) - (e[f"min_{c}"] or 0.0)) / size + 0.5).alias(f"v{c}") for c in "xyz"]
    return points.select(*at, *values).groupBy("vx", "vy", "vz").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in values))


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: tuple[float, ...]) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of each key, interpolated between ranks; nulls and NaN don't count.

    Values are counted, range partitioned and written once; a value's rank is the number of
    its key's rows in earlier ranges and before it in its own, so no task holds a whole key.
    """
    v = df.select(*keys, value.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    v = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    part = stored(v.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "sorted")
    n = part.groupBy(*keys, "_part").agg(F.sum("_c").alias("_n"))
    # one row per key and range
    w = Window.partitionBy(*keys)
    base = n.withColumns({"_base": F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_total": F.sum("_n").over(w)}).drop("_n")
    base = base.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_of"), "_base", "_total")
    same = [F.col("_part") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys))]
    placed = part.join(base, reduce(lambda a, b: a & b, same)).drop("_of", *(f"_k{i}" for i in range(len(keys))))
    placed = placed.withColumn("_end", F.col("_base") + F.sum("_c").over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    place = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    holds = lambda at: (at >= F.col("_end") - F.col("_c")) & (at < F.col("_end"))
    low = lambda p: F.max(F.when(holds(F.floor(place(p))), F.col("_v")))
    high = lambda p: F.max(F.when(holds(F.ceil(place(p))), F.col("_v")))
    share = lambda p: F.max(place(p) - F.floor(place(p)))
    wanted = reduce(lambda a, b: a | b, [holds(F.floor(place(p))) | holds(F.ceil(place(p))) for p in probs])
    return placed.where(wanted).groupBy(*keys).agg(*((low(p) + (high(p) - low(p)) * share(p)).alias(f"q{i}") for i, p in enumerate(probs)))


def error_stats(df: DataFrame, error: Column, below: tuple[float, ...] = ()) -> DataFrame:
    """Mean, exact p50 / p90 / p95, maximum, and the share under each bound."""
    e = df.select(error.alias("e"))
    q = quantiles(e, [], F.col("e"), (0.5, 0.9, 0.95)).toDF("p50", "p90", "p95")
    rest = e.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.max("e").alias("max"), *(F.avg(F.when(F.col("e") < b, 1.0).otherwise(0.0)).alias(f"below_{str(b).replace('.', '_')}") for b in below))
    # one row each
    return rest.crossJoin(F.broadcast(q)).select("n", "mean", "p50", "p90", "p95", "max", *rest.columns[3:])


def bilinear(samples: DataFrame, pixels: DataFrame, width: int, height: int, channels: tuple[str, ...]) -> DataFrame:
    """Bilinear values at (sid, img, u, v): u wraps round, v stops at the border.

    The four neighbours are an equi-join on (img, u, v), so rasters of any size partition.
    """
    fu, fv = F.floor("u"), F.floor("v")
    du, dv = F.col("u") - fu, F.col("v") - fv
    corner = lambda i, j: F.struct(
        F.pmod(fu + i, F.lit(width)).cast("int").alias("pu"), F.least(F.greatest(fv + j, F.lit(0)), F.lit(height - 1)).cast("int").alias("pv"),
        ((du if i else F.lit(1.0) - du) * (dv if j else F.lit(1.0) - dv)).alias("w"),
    )
    four = samples.select("sid", "img", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("k")).select("sid", "img", "k.*")
    return four.join(pixels, ["img", "pu", "pv"]).groupBy("sid").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in channels))


def depth_image(projected: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest depth per (pano, pixel), rounded to the nearest pixel and wrapped in u."""
    pu = F.pmod(F.bround("u").cast("int"), F.lit(width))
    pv = F.least(F.greatest(F.bround("v").cast("int"), F.lit(0)), F.lit(height - 1))
    return projected.select("pano", pu.alias("pu"), pv.alias("pv"), "depth").groupBy("pano", "pu", "pv").agg(F.min("depth").alias("depth"))


def shift_correlation(a: DataFrame, b: DataFrame, width: int, shifts: int, least: int) -> DataFrame:
    """Log-depth correlation and median-scaled relative error of two depth images for each azimuth shift of b."""
    moved = b.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1)))).select(
        "shift", F.pmod(F.col("pu") + (F.col("shift") * F.lit(width // shifts)), F.lit(width)).cast("int").alias("pu"), "pv", F.col("depth").alias("other")
    )
    both = a.select("pu", "pv", "depth").join(moved, ["pu", "pv"])
    scale = quantiles(both, ["shift"], F.col("depth") / F.col("other"), (0.5,)).withColumnRenamed("q0", "scale")
    # one row per shift
    scaled = both.join(F.broadcast(scale), "shift")
    return (
        scaled.groupBy("shift")
        .agg(F.count(F.lit(1)).alias("n"), F.corr(F.log("depth"), F.log("other")).alias("corr"), F.avg(F.abs(F.col("other") * F.col("scale") - F.col("depth")) / F.col("depth")).alias("abs_rel"))
        .where(F.col("n") >= least)
    )


def low_density_trim(df: DataFrame, value: str, quantile: float) -> DataFrame:
    """Rows at or above the exact quantile of ``value``."""
    cut = quantiles(df, [], F.col(value), (quantile,)).toDF("_cut")
    return df.crossJoin(F.broadcast(cut)).where(F.col(value) >= F.col("_cut")).drop("_cut")


def percentile_stretch(df: DataFrame, value: str, low: float, high: float, out: str) -> DataFrame:
    """``value`` clipped and scaled so that its two quantiles become 0 and 1."""
    q = quantiles(df, [], F.col(value), (low, high)).toDF("_lo", "_hi")
    s = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.crossJoin(F.broadcast(q)).withColumn(out, G.clamp(s, 0.0, 1.0)).drop("_lo", "_hi")


def hash_key(pid: Column, seed: int) -> Column:
    """A number below 2 ** 32 out of an id and a seed, by one multiplication: plain SQL can say the same."""
    return F.pmod(F.pmod(pid.cast("long"), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503), F.lit(1 << 32))


def exact_sample(points: DataFrame, n: int, seed: int = 42, pid: str = "pid") -> DataFrame:
    """Exactly ``n`` rows without replacement (all, if there are fewer): those of least hash, ties to the smaller id. ``pid`` is unique.

    A histogram of the hash's leading 16 bits names the bucket in which the last row lies; rows below it are
    taken, and only that bucket is sorted. The sample is the same however the rows are dealt.
    """
    keyed = points.withColumn("_h", hash_key(F.col(pid), seed)).withColumn("_b", F.shiftright("_h", 16))
    counts = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # one row a bucket, 65,536 at most
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
    last = upto.where(F.col("_upto") >= n).agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_before"))).alias("_l"))
    # one row
    edge = keyed.crossJoin(F.broadcast(last))
    below = edge.where(F.col("_l").isNull() | (F.col("_b") < F.col("_l._b"))).select(*points.columns)
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", pid))
    cut = edge.where(F.col("_b") == F.col("_l._b")).withColumn("_r", rank).where(F.col("_r") <= n - F.col("_l._before")).select(*points.columns)
    return below.unionByName(cut)
