"""Corpus pipeline: language ID, quality, near-duplicates, mixing, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which the runner writes as Parquet and reads again as the next stage's docs.
All stages but the last return the columns of ``documents``.

* language_id drops texts in which no language is found, or none with a calibrated
  probability of at least MIN_LANGUAGE; it learns from the stage's own input.
* quality drops texts that the classifier scores below its threshold.
* near_duplicates keeps of each class of near copies the row with the smallest id (of
  rows that agree in id, one). Word shingles have five words. Two texts link when
  the Jaccard similarity of their shingle sets is at least SIMILAR. Only pairs whose 512-bit
  fingerprints differ in at most RADIUS bits are candidates: at 0.8 some 78 +- 8 bits
  differ (96 +- 9 in texts of 4 and 5 shingles); unlike texts are some 256 bits apart. The first
  64 bits are looked at first and may differ in FIRST_RADIUS (10 +- 3 at 0.8). By the binomial law three
  in a million pairs at exactly 0.8 are no candidates, and one in 8,000 of texts of four and five
  shingles; the chance falls fast above 0.8. Nothing else is lost.
* mix repeats or leaves out rows so that each source meets its token target.
* pack cuts and packs what is left into sequences of 4096 ids.

SQL can't express the trained models, so ORACLE_SQL is None and tests hold the stages
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import langid, mixing, packing, quality, simhash
from voxloom.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_LANGUAGE = 0.5
SHINGLE, WORDS = 5, 8
SIMILAR = 0.8
RADIUS, FIRST_RADIUS = 136, 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language of probability MIN_LANGUAGE or more; null and letterless texts go. Repeated rows fare alike, an empty table stays empty."""
    found = langid.identify(docs.select(*COLUMNS), langid.train_model(docs))
    return found.where((F.col("_lang.lang_pred") != langid.UNKNOWN) & (F.col("_lang.score") >= MIN_LANGUAGE)).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score at least the classifier's threshold, learned from the labels of these rows; without any labels every row stays."""
    model = quality.train_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs.select(*COLUMNS), model).where(F.col("_quality") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the smallest id, null ids last. Texts without a word are one class."""
    # rows are numbered once, in a stored table: ids may repeat or be null
    keyed = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = keyed.select(F.col("_row").alias("doc_id"), "text")
    classes = materialise(simhash.similar_classes(rows, SHINGLE, SIMILAR, RADIUS, WORDS, FIRST_RADIUS), "classes")
    named = classes.join(keyed.select(F.col("_row").alias("_r"), F.col("doc_id").alias("_id")), classes["doc_id"] == F.col("_r"))
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_r").alias("r"))).alias("k"))
    return keyed.join(kept.select(F.col("k.r").alias("_row")), "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated (twice at most) or left out so that each source, null among them, meets its token target; texts without words take no part in targets."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 ids; a null or empty text is one end id, repeated rows are packed each."""
    found = packing.pack_documents(docs, packing.default_tokenizer())
    return found.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
