"""Conversation records in JSON, with a fixed schema, and versioned tables with a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = (
    "turn_id string, session_id string, mode string, ts string, question string, reply string, user_id string, intent string, confidence double, "
    "requires_human boolean, sources array<struct<source_path:string,doc:string,section:string,score:double,text:string>>, "
    "tool_calls array<struct<name:string,arguments:string,result:string>>, status string, _corrupt string"
)


def scan_turns(spark: SparkSession, path: str, processed: DataFrame | None = None) -> DataFrame:
    """Turn records of date directories; unreadable files are left out, and so are turns already processed."""
    rows = spark.read.schema(TURN).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).json(path)
    rows = rows.where("_corrupt is null and turn_id is not null").drop("_corrupt")
    return rows if processed is None else rows.join(processed.select("turn_id").distinct(), "turn_id", "left_anti")


_POINTER = "number long, version string"


def write_version(df: DataFrame, table: str) -> str:
    """Write a new version of a table and then point to it: readers see the old one or the new one, whole.

    Pointers are numbered upwards; of writers that take the same number at once, the greater version name counts.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{version}")
    number = 1 + (versions(spark, table).agg(F.max("number").alias("n")).first()["n"] or 0) if _exists(spark, f"{table}/_pointers") else 1
    spark.createDataFrame([(number, version)], _POINTER).coalesce(1).write.mode("append").parquet(f"{table}/_pointers")
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def versions(spark: SparkSession, table: str) -> DataFrame:
    """(number, version, at): every activated version in the order of activation, and when its pointer was written; pointers without a number come first."""
    rows = spark.read.schema(_POINTER).parquet(f"{table}/_pointers")
    return rows.select(F.coalesce("number", F.lit(0)).alias("number"), "version", F.col("_metadata.file_modification_time").alias("at"))


def _newest_first(spark: SparkSession, table: str) -> DataFrame:
    return versions(spark, table).orderBy(F.desc("number"), F.desc("at"), F.desc("version"))


def drop_old_versions(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Delete the files of all activated versions but the newest ``keep`` (at least one), and return the names of those deleted.

    Pointers stay, and so do versions that no pointer names yet, as their writers may be at work; to call it again changes nothing.
    """
    kept = {r["version"] for r in _newest_first(spark, table).limit(max(1, keep)).collect()}
    gone = []
    for r in versions(spark, table).select("version").distinct().collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/{r['version']}")
        if r["version"] not in kept and place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True):
            gone.append(r["version"])
    return sorted(gone)


def read_current(spark: SparkSession, table: str) -> DataFrame:
    last = _newest_first(spark, table).first()["version"]
    return spark.read.parquet(f"{table}/{last}")
