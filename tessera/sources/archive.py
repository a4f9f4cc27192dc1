"""Copy an archive of records, as its files come, into a table in which every key is there once.

A file stream finds the new files, however late they are or however old their date folder is. Each micro-batch is written under its own number together with its cursor, the
greatest key so far; a batch that is tried again after a crash replaces what it left behind. Keys that an earlier batch has are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

ROW = "key string, content string, cursor string, batch long"


def archived(spark: SparkSession, target: str) -> DataFrame:
    """ROW of everything that has been copied; no rows before the first batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], ROW)
    return spark.read.schema(ROW).parquet(target)


def copy_batch(batch: DataFrame, number: int, target: str) -> None:
    """Write the batch's (key, content) whose keys no earlier batch has; of equal keys the least content. The same batch can be written again."""
    before = archived(batch.sparkSession, target).where(F.col("batch") < number)
    last, newest = before.agg(F.max("cursor")).first()[0], batch.agg(F.max("key")).first()[0]
    rows = batch.groupBy("key").agg(F.min("content").alias("content")).join(before.select("key"), "key", "left_anti")
    cursor = max((c for c in (last, newest) if c is not None), default=None)
    rows.withColumn("cursor", F.lit(cursor).cast("string")).write.mode("overwrite").parquet(f"{target}/batch={number}")


def archive_files(spark: SparkSession, source: str, files_at_once: int = 10_000) -> DataFrame:
    """A stream of (key, content) of the files below a folder; the key is the path below it, the content the whole file."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once).load(source)
    root = source.rstrip("/").split("://")[-1]
    return rows.select(F.element_at(F.split("_metadata.file_path", F.concat(F.lit(r"\Q"), F.lit(root + "/"), F.lit(r"\E")), 2), -1).alias("key"), F.col("value").alias("content"))


def sync_archive(rows: DataFrame, target: str, state: str) -> DataStreamWriter:
    """A writer of a stream of (key, content); start() it, with a trigger of your choice. state: the stream's checkpoint folder, which target must not be moved without."""
    return rows.writeStream.foreachBatch(lambda batch, number: copy_batch(batch, number, target)).option("checkpointLocation", state)
