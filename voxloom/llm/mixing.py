"""Mixing sources to target token counts by entropy balancing (operator 3).

Only DataFrame functions. Each document gets a rate r in [0, 2]; among all rates that
meet every source's token target, the least change from "every document once" (in
relative entropy) has the exponentially tilted form r = min(2, exp(lambda * z)), with
z the document's size over its source's mean size and one multiplier per source. The
multipliers are the zero of the gradient of the convex dual, found by Newton steps kept
in a bracket. Documents of one source and size share a rate, so the steps run over the
(source, size) histogram, aggregated once and stored.

Rates become whole copies by systematic rounding from the longest document down: copies
of a row are the increments of the running sum of rates, shifted by a phase and cut to
whole numbers. Each document then gets the floor or the ceiling of its rate, and a
source misses its target by less than its longest document; of PHASES phases each source
takes the one that misses least, which the histogram tells in one aggregation. All sums
are over integers (rates in units of 2**-20), so reruns agree.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share a budget
of 150 % of all words; none gets more than twice its words, the excess is shared again
by weight (solved in closed form by sorting on the level at which a source saturates).

Edge cases: null and empty texts have size 0 and take 0 words; a source without words has
target 0; repeated rows and repeated ids are separate documents; extra columns pass
through ``mix_documents`` untouched, whatever their names; an empty table gives no rows.

Sources are rows of tables throughout (targets, multipliers, phases), so their number is
not bounded by the driver; targets are ranked over one short row a source.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
CAP = 2
#: Rates are whole multiples of 1 / UNIT.
UNIT = 1 << 20
#: Ranks within one (source, size) are taken in this many parts, so that no group is one task's.
SALTS = 256
MAX_STEPS = 60
#: Phases of the systematic rounding that are tried.
PHASES = 16
#: The dual's multipliers lie between minus and plus this.
BRACKET = 64.0
#: Columns that ``mix_documents`` adds.
ADDED = ("_size", "_source_size", "_target", "_copies")


def words(text: Column) -> Column:
    """Runs of non-blank characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source -> source_size, weight, target. ``sizes``: (source, source_size), one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (k + 1).cast("int"))
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(CAP)))
    # a source saturates once the level passes cap / weight; sort by it and find the level
    up = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    prior, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    budget = F.sum("source_size").over(everything) * F.lit(BUDGET)
    s = s.withColumn("_level", (budget - F.coalesce(F.sum("_cap").over(prior), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that its own level does not saturate fixes the level of all later ones
    s = s.withColumn("_free", F.col("_level") * F.col("weight") < F.col("_cap"))
    level = F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("_level").alias("level")))).over(everything)
    s = s.withColumn("_final", level["level"])
    return s.select("source", "source_size", "weight", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("weight"))).alias("target"))


def tilted(lam: Column, z: Column) -> Column:
    """min(CAP, exp(lam * z)) in whole units; the exponent is cut where the cap holds anyway."""
    return F.round(F.least(F.lit(float(CAP)), F.exp(F.least(lam * z, F.lit(1.0)))) * UNIT).cast("long")


def dual_state(hist: DataFrame) -> DataFrame:
    """One row a source: s0, s1, source_size, target, mean size, and where Newton begins (lam, low, high, open, full)."""
    sizes = hist.groupBy("s0", "s1").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    named = sizes.withColumn("source", F.when(~F.col("s1"), F.col("s0")))
    wanted = targets(named.select("source", "source_size")).select(F.coalesce("source", F.lit("")).alias("s0"), F.col("source").isNull().alias("s1"), "target")
    state = sizes.join(wanted, ["s0", "s1"]).withColumn("mean", F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9)))
    full, none = F.col("target") >= F.col("source_size") * CAP, (F.col("source_size") == 0) | (F.col("target") <= 0)
    return state.select(
        "s0", "s1", "source_size", "target", "mean", F.when(none, F.lit(-BRACKET)).otherwise(F.lit(0.0)).alias("lam"),
        F.lit(-BRACKET).alias("low"), F.lit(BRACKET).alias("high"), (~none & ~full).alias("open"), (full & ~none).alias("full"),
    )


def newton_step(hist: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` after one step of every open source: one aggregation of the histogram."""
    z = F.col("size") / F.col("mean")
    mass = F.col("size") * F.col("n") * tilted(F.col("lam"), z)
    slope = F.when(F.col("lam") * z < F.log(F.lit(float(CAP))), mass / F.lit(UNIT) * z).otherwise(F.lit(0.0))
    at = hist.join(state.where("open").select("s0", "s1", "lam", "mean"), ["s0", "s1"])
    found = at.groupBy("s0", "s1").agg(F.sum(mass.cast("decimal(38,0)")).cast("double").alias("g"), F.sum(F.round(slope * 1024).cast("decimal(38,0)")).cast("double").alias("h"))
    gap, slope = F.col("g") / UNIT - F.col("target"), F.col("h") / 1024
    s = state.join(found, ["s0", "s1"], "left").withColumn("gap", gap).withColumn("slope", slope)
    met = ~F.col("open") | (F.abs("gap") <= F.greatest(F.lit(0.5), 1e-9 * F.col("target")))
    s = s.withColumn("met", met).withColumn("high", F.when(~F.col("met") & (F.col("gap") > 0), F.col("lam")).otherwise(F.col("high"))).withColumn("low", F.when(~F.col("met") & (F.col("gap") <= 0), F.col("lam")).otherwise(F.col("low")))
    step = F.when(F.col("slope") > 0, F.col("lam") - F.try_divide("gap", "slope"))
    lam = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise((F.col("low") + F.col("high")) / 2)
    s = s.withColumn("lam", F.when(F.col("met"), F.col("lam")).otherwise(lam)).withColumn("open", ~F.col("met") & (F.col("high") - F.col("low") >= 1e-12))
    return s.select(*state.columns)


def solve(hist: DataFrame) -> DataFrame:
    """Newton on the dual. ``hist``: (s0, s1, size, n). The state of all sources is a stored table; only the number of open ones meets the driver."""
    state = materialise(dual_state(hist), "mix-dual")
    for _ in range(MAX_STEPS):
        if state.where("open").limit(1).count() == 0:
            return state
        state = materialise(newton_step(hist, state), "mix-dual")
    left = state.where("open").count()
    if left:
        warnings.warn(f"{left} sources are not within half a word of their targets after {MAX_STEPS} steps", stacklevel=2)
    return state


def locate(parts: DataFrame) -> DataFrame:
    """(s0, s1, size, salt, rate, from, source_size, target) of every part (s0, s1, size, salt, n) of the documents.

    from is the running sum of rates before the part's first row, in units, phase included.
    """
    hist = materialise(parts.groupBy("s0", "s1", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    dual = solve(hist)
    rate = F.when(F.col("full"), F.lit(CAP * UNIT).cast("long")).when(F.col("size") == 0, F.lit(UNIT).cast("long")).otherwise(tilted(F.col("lam"), F.col("size") / F.col("mean")))
    before = Window.partitionBy("s0", "s1").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rated = hist.join(dual, ["s0", "s1"]).select("s0", "s1", "size", "n", "source_size", "target", rate.alias("rate"))
    rated = materialise(rated.withColumn("start", F.coalesce(F.sum(F.col("rate") * F.col("n")).over(before), F.lit(0))), "mix-rates")
    shifts = [UNIT * (2 * i + 1) // (2 * PHASES) for i in range(PHASES)]
    whole = lambda x: F.floor(x / F.lit(UNIT))
    tried = rated.groupBy("s0", "s1", "target").agg(*(F.sum(F.col("size") * (whole(F.col("start") + F.col("rate") * F.col("n") + u) - whole(F.col("start") + u))).alias(f"t{i}") for i, u in enumerate(shifts)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"t{i}") - F.col("target")).alias("miss"), F.lit(i).alias("i"), F.lit(u).cast("long").alias("shift")) for i, u in enumerate(shifts))))
    rated = rated.join(tried.select("s0", "s1", best["shift"].alias("shift")), ["s0", "s1"]).withColumn("start", F.col("start") + F.col("shift"))
    earlier = Window.partitionBy("s0", "s1", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return placed.join(rated, ["s0", "s1", "size"]).select("s0", "s1", "size", "salt", "rate", (F.col("start") + F.col("earlier") * F.col("rate")).alias("from"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))


def mix_documents(docs: DataFrame, size: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with the columns of ADDED after its own.

    ``size`` and ``tie`` (words and a hash of the text) default to those of column text. A
    column of ``docs`` that is named like an added one keeps its name; the added one then
    gets further underscores in front.
    """
    columns = docs.columns
    size = words(F.col("text")) if size is None else size
    tie = F.xxhash64("text") if tie is None else tie
    # own columns have names that no input column can have: those are numbered meanwhile
    made = docs.select("*", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_0"), F.col("source").isNull().alias("_1"), size.alias("_2"), tie.alias("_3"), F.col("doc_id").alias("_4"))
    keyed = made.toDF(*(f"c{i}" for i in range(len(columns))), "s0", "s1", "size", "tie", "id").withColumn("salt", F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS)).cast("int"))
    parts = materialise(keyed.groupBy("s0", "s1", "size", "salt").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    group = ["s0", "s1", "size", "salt"]
    # rank and join have the same keys, so rows move once
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("id", "tie")))
    joined = ranked.join(locate(parts), group)
    upto = lambda n: F.floor((F.col("from") + n * F.col("rate")) / F.lit(UNIT))
    copies = (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("int")
    own = joined.select(*(f"c{i}" for i in range(len(columns))), "size", "source_size", "target", copies.alias("copies"))
    return own.toDF(*columns, *added(columns))


def added(columns: list[str]) -> list[str]:
    """Names of the added columns beside these."""
    names = []
    for name in ADDED:
        while name in columns:
            name = "_" + name
        names.append(name)
    return names


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as the mix says: the mixture itself."""
    columns = docs.columns
    rows = mix_documents(docs).toDF(*(f"c{i}" for i in range(len(columns))), *ADDED)
    copies = rows.where(F.col("_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copies.select(*(f"c{i}" for i in range(len(columns)))).toDF(*columns)


def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: words each of them gives. Texts are read once, for their sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "mix-sizes")
    rows = mix_documents(narrow, F.col("size"), F.col("tie"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).cast("long").alias("taken"), F.col("_copies").alias("copies"))
