"""Source divergence audit (operator 11): how far the sources of a language differ, and in which terms.

Every kept term has an integer probability in each (lang, source) group and in each lang. Two
reports follow: ``pair``, the summed difference of two sources over all kept terms, and ``term``,
the terms by which a group stands out from its language.

* Pairs are sparse. All terms that a group lacks share one probability, its base. The sum
  over all terms is the difference of two bases times their number, plus corrections: one for
  each term that one of the two holds (taken from the group's histogram of probabilities, not term
  by term) and one for each term that both hold.
* Ranks come from a radix select. Histograms over ten bits of the value at a time, one row a group
  and digit, narrow each group down to the value of its k-th term; ties at that value are
  narrowed by histograms over the next UTF-8 bytes of the term. Only what lies above the
  threshold, at most k rows and a bounded tie bucket a group, is sorted.

Edge cases: null text, lang and source read as ''; a group without terms has pairs (value 0 where its
language keeps no term) and no terms; equal values rank by UTF-8 bytes; repeated rows count each;
an empty table gives no rows; other columns are ignored. Sums are long, products of a
thousand million and a count are decimals of 38 digits, so nothing is rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates terms: every ASCII character but letters.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5
#: Bits of a value that one histogram spans; values are at most SCALE + 1, below two to the 30.
DIGIT, BITS = 10, 30
#: Bytes of a term that one histogram spans, and the tie bucket of a group that is sorted as it is.
STEP, BUCKET = 2, 1000

_GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. One pass over the texts."""
    words = F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), GAP)
    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), words.alias("w"))
    # list 0 has every occurrence, list 1 each term once
    both = read.select(*_GROUP, F.posexplode(F.array("w", F.array_distinct("w"))).alias("list", "w")).select(*_GROUP, "list", F.explode("w").alias("term"))
    one = F.lit(1).cast("long")
    return both.where(F.col("term") != "").groupBy(*_GROUP, "term").agg(F.sum(F.when(F.col("list") == 0, one).otherwise(0)).alias("n"), F.sum(F.when(F.col("list") == 1, one).otherwise(0)).alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exactly."""
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(20, 0)) div CAST({total} + {PRIOR} * {kept} AS DECIMAL(20, 0))")


def tables(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, cells): one row a group with V, its occurrences and base; one row a kept term that occurs in a group, with p and q."""
    counts = materialise(term_counts(docs), "term-counts")
    # ``total`` and ``kept`` are one row a language, stored so that the planner knows how small they are
    kept = materialise(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
    langs = materialise(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("lang_n").alias("lang_total")), "langs")
    held = materialise(counts.select(*_GROUP, "term", "n").join(kept, ["lang", "term"]), "held-terms")
    sums = held.groupBy(*_GROUP).agg(F.sum("n").alias("group_n"))
    every = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in _GROUP)).distinct()
    groups = every.join(sums, _GROUP, "left").join(langs, "lang", "left").select(*_GROUP, F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("V", F.lit(0)).alias("V"), "lang_total")
    groups = materialise(groups.withColumn("base", F.when(F.col("V") > 0, share("0", "group_n", "greatest(V, 1)"))), "groups")
    cells = held.join(groups, _GROUP).select(*_GROUP, "term", share("n", "group_n", "V").alias("p"), share("lang_n", "lang_total", "V").alias("q"))
    return groups, materialise(cells, "cells")


def pair_values(groups: DataFrame, cells: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of every source to every other one of its language."""
    g = groups.select("lang", "source", "base", "V")
    h = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    apart = F.abs(F.col("base") - F.col("other"))
    pairs = g.join(h, "lang").where(F.col("source") != F.col("item"))
    start = pairs.select(*_GROUP, "item", F.coalesce(F.col("V") * apart, F.lit(0)).alias("value"))
    # terms that the source holds, as if the other did not: by the histogram of its probabilities
    histogram = cells.groupBy(*_GROUP, "p").agg(F.count(F.lit(1)).alias("m"))
    alone = histogram.join(pairs, _GROUP).select(*_GROUP, "item", (F.col("m") * (F.abs(F.col("p") - F.col("other")) - apart)).alias("value"))
    alone = alone.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))
    # terms that both hold: what is still to be corrected; summed per pair where they meet
    a = cells.select("lang", "term", "source", "p").join(g.drop("V"), _GROUP)
    b = cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("r")).join(h, ["lang", "item"])
    shared = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item"))
    fixed = F.abs(F.col("p") - F.col("r")) - F.abs(F.col("p") - F.col("other")) - F.abs(F.col("base") - F.col("r")) + apart
    shared = shared.groupBy(*_GROUP, "item").agg(F.sum(fixed).alias("value"))
    swapped = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.col("value")]
    parts = start.unionByName(alone).unionByName(alone.select(*swapped)).unionByName(shared).unionByName(shared.select(*swapped))
    return parts.groupBy(*_GROUP, "item").agg(F.sum("value").alias("value"))


def _narrowed(found: DataFrame, need: DataFrame, key: str, down: bool) -> DataFrame:
    """Of a histogram (group, key, n): the bucket of each group in which its k-th row lies, and how many rows of that are wanted.

    A group with fewer rows than wanted is left out: it keeps them all."""
    order = F.col(key).desc() if down else F.col(key).asc()
    upto = F.sum("n").over(Window.partitionBy(*_GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    run = found.join(need, _GROUP).withColumn("upto", upto)
    return run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select(*_GROUP, key, "n", (F.col("need") - F.col("upto") + F.col("n")).alias("need"))


def top_terms(rows: DataFrame, top: int = TOP, step: int = STEP, bucket: int = BUCKET) -> DataFrame:
    """The ``top`` rows of (lang, source, item, value) of each group, by value downwards and UTF-8 bytes upwards, with rank."""
    # by bits of the value: ``bits`` holds the leading digits of the k-th value of each group
    state = materialise(rows.select(*_GROUP).distinct().withColumn("bits", F.lit(0).cast("long")).withColumn("need", F.lit(top).cast("long")), "digits")
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inside = rows.join(state.drop("need"), _GROUP).where(F.shiftright("value", shift + DIGIT) == F.col("bits"))
        found = inside.groupBy(*_GROUP, F.shiftright("value", shift).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        state = materialise(_narrowed(found, state.select(*_GROUP, "need"), "key", True).select(*_GROUP, F.col("key").alias("bits"), "need", "n"), "digits")
    # by bytes of the term among rows of that value: ``head`` holds the leading bytes of the k-th term
    raw = F.encode("item", "UTF-8")
    tied = rows.join(state.select(*_GROUP, F.col("bits").alias("value")), [*_GROUP, "value"])
    nothing = F.encode(F.lit(""), "UTF-8")
    ends = materialise(state.select(*_GROUP, "need", "n", nothing.alias("head"), F.lit(0).alias("depth")), "bytes")
    depth = 0
    while not ends.where((F.col("n") > bucket) & (F.col("n") > F.col("need"))).isEmpty():
        open_ = ends.where((F.col("n") > bucket) & (F.col("n") > F.col("need")))
        inside = tied.join(open_.select(*_GROUP, "head"), _GROUP).where(F.substring(raw, 1, depth) == F.col("head") if depth else F.lit(True))
        found = inside.groupBy(*_GROUP, F.substring(raw, 1, depth + step).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        depth += step
        deeper = _narrowed(found, open_.select(*_GROUP, "need"), "key", False).select(*_GROUP, "need", "n", F.col("key").alias("head"), F.lit(depth).alias("depth"))
        ends = materialise(ends.join(open_.select(*_GROUP), _GROUP, "left_anti").unionByName(deeper), "bytes")
    limits = state.select(*_GROUP, F.col("bits").alias("least")).join(ends.select(*_GROUP, "head", "depth"), _GROUP)
    start = F.expr("substring(encode(item, 'UTF-8'), 1, depth)")
    near = rows.join(limits, _GROUP, "left").where(F.col("least").isNull() | (F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (start <= F.col("head"))))
    rank = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), F.col("item").asc()))
    return near.select(*_GROUP, "item", "value", rank.alias("rank")).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of both reports."""
    groups, cells = tables(docs, min_docs)
    pairs = pair_values(groups, cells)
    order = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = pairs.select(*_GROUP, F.lit("pair").alias("part"), "item", F.col("value").cast("long").alias("value"), F.row_number().over(order).alias("rank"))
    above = materialise(cells.where(F.col("p") > F.col("q")).select(*_GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "above")
    terms = top_terms(above, top).select(*_GROUP, F.lit("term").alias("part"), "item", "value", "rank")
    return ranked.unionByName(terms)


def op11_radix_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and standout terms of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCS}),
lv AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {PRIOR})) // (total + {PRIOR} * v)::HUGEINT AS q FROM kept JOIN lv USING (lang)),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, q.term, q.q, coalesce(c.n, 0) AS n,
        1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(gn.total, 0) + {PRIOR} * lv.v)::HUGEINT AS p
      FROM g JOIN lv USING (lang) JOIN q ON q.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = q.term
        LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= {TOP}
"""
