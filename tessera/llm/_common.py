"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_LOW33 = (1 << 33) - 1

FINALIZER_SECONDS = 1.2


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are checkpointed; it does so once their frames are garbage.

    Python gives up its hold on the JVM's frames in a thread that looks for work once a second; what these held can go at the second turn.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(FINALIZER_SECONDS)
        spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def utf8(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the gapless place (from 0) of each row in the given order.

    The rows are range-partitioned and sorted in their partitions, so no task
    sees more than its share; only one count per partition is brought together.
    Rows that tie in every order column are numbered in any order among themselves.
    """
    place = F.col("_place")
    held = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    counts = held.groupBy(F.shiftright(place, 33).alias("_part")).agg((F.max(place.bitwiseAND(F.lit(_LOW33))) + 1).alias("_n"))
    # One row per partition of the sort: as many as spark.sql.shuffle.partitions at most.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = held.withColumn("_part", F.shiftright(place, 33)).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + place.bitwiseAND(F.lit(_LOW33))).drop("_place", "_part", "_start")


#: Above this many rows the small side of bounded_join() is shuffled, not broadcast.
BROADCAST_ROWS = 100_000


def bounded_join(big: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join with a table of narrow rows that is broadcast only once it has been counted."""
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small, on, how)
