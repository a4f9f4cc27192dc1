"""Knowledge directories: scans, path rules, sidecars, governance and front matter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.batches import json_text
from pyspark.sql.types import StringType

#: File types that are read, directories that are, and marks of files that aren't.
SUFFIXES = ("md", "txt", "pdf", "docx", "html", "htm", "xlsx", "xlsm")
INSIDE = ("evolved", "uploads")
EXCLUDED = ("archive", ".trash", ".staging", "__pycache__")
JUNK = r"(~|\.tmp|\.bak|\.swp|\.orig)$"


def scan_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """(path, relative, text): files of some types under a directory, decoded; unreadable ones have a null text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    relative = F.regexp_replace(F.col("path"), "^.*?" + path.rstrip("/").replace(".", r"\."), "")
    return files.select("path", F.regexp_replace(relative, "^/", "").alias("relative"), decode_text(F.col("content")).alias("text"))


def decoded(content: bytes | None) -> str | None:
    for encoding in ("utf-8", "gb18030"):
        try:
            text = bytes(content or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
        controls = sum(1 for c in text if c < " " and c not in "\t\n\r\f\v" or c == "\x7f")
        return None if "\0" in text or controls > 0.02 * len(text) else text
    return None


@F.pandas_udf(StringType())
def _decode(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in contents:
        yield batch.map(decoded)


def decode_text(content: Column) -> Column:
    """UTF-8, else GB18030 (which Spark's own decode lacks); null for bytes with NUL or more than 2% control characters."""
    return _decode(content)


def allowed_path(path: Column) -> Column:
    """Files at the root or under the open directories; nothing hidden, excluded or temporary."""
    parts = F.split(path, "/")
    open_ = (F.size(parts) == 1) | parts[0].isin(*INSIDE)
    barred = F.exists(parts, lambda p: p.isin(*EXCLUDED) | p.startswith("."))
    return open_ & ~barred & ~path.rlike(JUNK)


def parse_sidecar(text: Column) -> Column:
    """'key: value' lines as a map with keys in lower case; other lines and repeated keys but the last are left out."""
    pairs = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^\s*[^:#\s][^:]*:")), lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse_frontmatter(text: Column) -> Column:
    """The map of a closed block between '---' lines at the start; empty otherwise."""
    return parse_sidecar(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^---\r?\n(.*?)\r?\n---(?:\r?\n|$)", 1))


#: Characters that make a value of the front matter a JSON string.
QUOTED = ":\"'#\n{}[]&*!|>%@`"


def front_matter(entries: Column) -> Column:
    """A '---' block of an array of structs (key, value), in order; blank and null values are left out, those with special characters or white space around them become JSON strings."""
    trimmed = lambda v: F.regexp_replace(v, r"^\s+|\s+$", "")
    special = lambda v: (F.translate(v, QUOTED, "") != v) | (trimmed(v) != v)
    line = lambda e: F.concat(e["key"], F.lit(": "), F.when(special(e["value"]), json_text(trimmed(e["value"]))).otherwise(e["value"]))
    lines = F.transform(F.filter(entries, lambda e: trimmed(F.coalesce(e["value"], F.lit(""))) != ""), line)
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), F.coalesce(lines, F.array().cast("array<string>")), F.array(F.lit("---"))), "\n"), F.lit("\n"))


def governance_problems(status: Column, authority: Column, date: Column) -> Column:
    """What is wrong with a document's governance, as a list."""
    return F.array_compact(F.array(
        F.when(~F.coalesce(status.isin("active", "archived"), F.lit(False)), "status"),
        F.when(~F.coalesce(authority.isin("platform", "external_reference"), F.lit(False)), "authority"),
        F.when(~F.coalesce(date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) | F.try_to_date(date).isNull(), "effective_date"),
        F.when((status == "active") & (authority == "external_reference"), "active_external"),
    ))


def eligible(status: Column, authority: Column) -> Column:
    return (F.coalesce(status, F.lit("active")) != "archived") & (F.coalesce(authority, F.lit("platform")) != "external_reference")


def authority_kind(path: Column, has_frontmatter: Column) -> Column:
    return F.when(path.startswith("evolved/") & has_frontmatter, "managed").otherwise("authoritative")


def knowledge_expiry(effective: Column, today: Column, aging_days: int) -> Column:
    day = F.try_to_date(effective)
    return F.when(day.isNull(), "unknown").when(day < F.date_sub(today, aging_days), "expired").otherwise("valid")


def repeated_lines(lines: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """Margin lines (doc, page, line): equal text, but for digits, on at least max(3, 60%) of a document's pages."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    norm = F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", r"\d+", "#"), r"\s+", " ")))
    counts = lines.withColumn("line", norm).groupBy("doc", "line").agg(F.countDistinct("page").alias("n"))
    return counts.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share)))
