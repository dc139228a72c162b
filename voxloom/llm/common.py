"""Shared helpers: scratch tables in the cluster's shared folder, folds, ordered prefix sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of anything but space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names.

    A local temporary folder is used only where the setting is absent and the master is
    local, as in tests; elsewhere executors would not see it, so a missing setting raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/voxloom-scratch"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows in one Arrow batch to a Python worker: a few hundred long texts at most.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df`` in a session whose Arrow batches are bounded in bytes, not only in rows."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(conf.get(name)).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id's decimal text, mod 5; 0 is held out. A null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5


def ordered_start(df: DataFrame, order: list[str], value: str, out: str, keep_rank: bool = False) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are range partitioned and sorted, written once (so that range bounds are
    fixed), and summed within a range; the totals of the ranges, one row each, give
    every range its base. No single task sees more than one range. ``keep_rank`` also
    leaves _range and _rank, the row's range and its place in that range.
    """
    spark = df.sparkSession
    kept = materialise(
        df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    totals = kept.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: bounded by the number of partitions
    found = kept.join(F.broadcast(base), "_range").withColumn(out, (F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long"))
    if keep_rank:
        return found.withColumn("_rank", (F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1).cast("long")).drop("_base")
    return found.drop("_range", "_base")
