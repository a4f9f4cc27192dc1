"""Retrieval cases from JSON files, each checked: good cases, and the first thing wrong with every other one.

A file holds {"cases": [{"id", "query", "expected": [...], "k": 5, "tags": [...]}]}. Files are parsed as variants, so a value of the wrong type is found, not cast.
Nothing raises: a bad file is one row with an error, a bad case another. Ids and queries (without white space around them) are unique over all files, in
order of path and place: of several cases with the same well-formed one the first may be good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_K = 5
#: What can be wrong, in the order in which it is looked for.
FILE_ERRORS = ("not_json", "no_cases")
CASE_ERRORS = ("not_object", "missing_field", "bad_id", "duplicate_id", "bad_query", "duplicate_query", "bad_expected", "duplicate_expected", "bad_k", "bad_tags")


def read_case_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the JSON files of a folder and its subfolders; each is small enough to be a row."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _texts(value: Column, empty: bool) -> tuple[Column, Column]:
    """A variant's array of texts, null if it isn't one of texts that aren't empty (or may not be: are blank); and whether no text comes twice."""
    items = F.try_variant_get(value, "$", "array<variant>")
    kinds = F.transform(items, lambda v: _kind(v) == "STRING")
    texts = F.transform(items, lambda v: F.try_variant_get(v, "$", "string"))
    good = F.forall(kinds, lambda k: k) & F.forall(texts, lambda t: F.length(t if empty else F.trim(t)) > 0)
    array = _kind(value).startswith("ARRAY")
    held = F.when(array & F.coalesce(good, F.lit(False)), texts)
    return held, F.size(F.array_distinct(held)) == F.size(held)


def check_cases(files: DataFrame) -> DataFrame:
    """(path, place, id, query, expected, k, tags, error) of every case of files (path, content); error is null for good ones, place is null for bad files."""
    parsed = files.select("path", F.try_parse_json("content").alias("v"))
    cases = F.try_variant_get("v", "$.cases", "array<variant>")
    is_list = _kind(F.col("v")).startswith("OBJECT") & F.coalesce(_kind(F.try_variant_get("v", "$.cases", "variant")).startswith("ARRAY"), F.lit(False))
    whole = parsed.select("path", F.when(F.col("v").isNull(), "not_json").when(~is_list, "no_cases").alias("bad"), F.when(is_list, cases).alias("cases"))
    rows = whole.select("path", "bad", F.posexplode_outer("cases").alias("place", "v")).where("bad is not null or v is not null")
    part = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    text = lambda name: F.when(_kind(part(name)) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))
    filled = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    expected, once = _texts(part("expected"), empty=True)
    tags, tags_once = _texts(part("tags"), empty=False)
    k = F.when(part("k").isNull(), F.lit(DEFAULT_K).cast("long")).otherwise(F.when(_kind(part("k")) == "BIGINT", F.try_variant_get("v", "$.k", "long")))
    fields = F.json_object_keys(F.to_json("v"))
    has = lambda name: F.coalesce(F.array_contains(fields, name), F.lit(False))
    rows = rows.select(
        "path", "bad", F.when(F.col("bad").isNull(), F.col("place")).alias("place"), _kind(F.col("v")).startswith("OBJECT").alias("object"), (has("id") & has("query") & has("expected")).alias("whole"),
        filled(text("id")).alias("id"), filled(text("query")).alias("query"), expected.alias("expected"), once.alias("once"), k.alias("k"), (~has("tags") | F.coalesce(tags_once, F.lit(False))).alias("tags_ok"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
    )
    # The first place of each id and query: a least value, partly aggregated before the shuffle.
    here = F.struct("path", "place")
    ids = rows.where("object and whole and id is not null").groupBy("id").agg(F.min(here).alias("first_id"))
    asked = rows.where("object and whole and query is not null").groupBy(F.trim("query").alias("_asked")).agg(F.min(here).alias("first_query"))
    rows = rows.join(ids, "id", "left").join(asked, F.trim("query") == F.col("_asked"), "left")
    checks = (~F.col("object"), ~F.col("whole"), F.col("id").isNull(), here > F.col("first_id"), F.col("query").isNull(), here > F.col("first_query"), F.col("expected").isNull(), ~F.col("once"), F.coalesce(F.col("k") <= 0, F.lit(True)), ~F.col("tags_ok"))
    error = F.coalesce("bad", *(F.when(F.coalesce(c, F.lit(False)), name) for c, name in zip(checks, CASE_ERRORS, strict=True)))
    return rows.select("path", "place", "id", "query", "expected", "k", "tags", error.alias("error"))


def scan_retrieval_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The good cases below a path, and the rows with errors."""
    checked = check_cases(read_case_files(spark, path))
    return checked.where("error is null").drop("error"), checked.where("error is not null").select("path", "place", "id", "error")
