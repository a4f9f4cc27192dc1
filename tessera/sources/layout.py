"""Structure of paged lines (doc, page, line, text, size), as a page reader gives them: headings by font size, margin lines by repetition.

Defined results: blank lines count for nothing and pass through; a null size is body text; documents without larger sizes have no
headings; margin lines are never headings; other columns pass through, and level, margin and rendered replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points that a heading is larger than the body, levels of headings, lines at each end of a page that may be margins.
HEADING_DELTA, MOST_LEVELS, MARGIN_LINES = 1.0, 6, 2
ADDED = ("level", "margin", "rendered")


def same_line(text: Column) -> Column:
    """A line without its whitespace. Digits stay: lines of text that differ in a number only are no margins."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")


def _filled(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_norm", same_line(F.col("text"))).where("_norm <> ''").withColumn("_size", F.round(F.col("size").cast("double"), 1))


def heading_levels(lines: DataFrame, delta: float = HEADING_DELTA, most: int = MOST_LEVELS) -> DataFrame:
    """(doc, size, level): the body's size has most characters (of equals the first met); the largest sizes that exceed it by ``delta`` are the levels from 1."""
    trimmed = F.length(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    sizes = _filled(lines).where("_size is not null").groupBy("doc", "_size").agg(F.sum(trimmed).alias("_weight"), F.min(F.struct("page", "line")).alias("_first"))
    # A row for each size of a document; the order is by weight, then by the place met first.
    by_weight = Window.partitionBy("doc").orderBy(F.desc("_weight"), "_first")
    body = F.first("_size").over(by_weight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    big = sizes.withColumn("_body", body).where(F.col("_size") >= F.col("_body") + delta)
    ranked = big.withColumn("level", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("_size"))))
    return ranked.where(F.col("level") <= most).select("doc", F.col("_size").alias("size"), "level")


def margin_lines(lines: DataFrame, share: float = 0.6, least: int = 3, ends: int = MARGIN_LINES) -> DataFrame:
    """(doc, norm): lines that stand among the first or last ``ends`` of a page, on at least max(``least``, ``share``) of a document's pages."""
    up, down = [Window.partitionBy("doc", "page").orderBy(o) for o in (F.asc("line"), F.desc("line"))]
    edge = _filled(lines).withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).where((F.col("_up") <= ends) | (F.col("_down") <= ends))
    counts = edge.select("doc", "page", "_norm").distinct().groupBy("doc", "_norm").agg(F.count("*").alias("_n"))
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("_pages"))
    needed = F.greatest(F.lit(max(2, least)), F.ceil(F.col("_pages") * share))
    return counts.join(pages, "doc").where(F.col("_n") >= needed).select("doc", F.col("_norm").alias("norm"))


def marked_lines(lines: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """lines with level (null for text), margin, and rendered: a Markdown heading, the line itself, or null for a margin line."""
    rows = lines.select(*[c for c in lines.columns if c.lower() not in ADDED]).withColumn("_norm", same_line(F.col("text"))).withColumn("_size", F.round(F.col("size").cast("double"), 1))
    levels = heading_levels(lines).withColumnRenamed("size", "_size")
    margins = margin_lines(lines, share, least).select("doc", F.col("norm").alias("_norm"), F.lit(True).alias("margin"))
    found = rows.join(levels, ["doc", "_size"], "left").join(margins, ["doc", "_norm"], "left")
    margin, level = F.coalesce("margin", F.lit(False)), F.when(F.col("margin").isNull() & (F.col("_norm") != ""), F.col("level"))
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rendered = F.when(margin, None).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), trimmed)).otherwise(F.col("text"))
    kept = [c for c in rows.columns if c not in ("_norm", "_size")]
    return found.select(*kept, level.alias("level"), margin.alias("margin"), rendered.alias("rendered"))


def page_texts(lines: DataFrame, share: float = 0.6, least: int = 3) -> DataFrame:
    """(doc, page, text, rebuilt): each page's rendered lines, and whether the page has a heading of its own."""
    marked = marked_lines(lines, share, least)
    held = F.sort_array(F.collect_list(F.when(~F.col("margin"), F.struct("line", "rendered"))))
    text = F.array_join(F.transform(held, lambda x: F.coalesce(x["rendered"], F.lit(""))), "\n")
    return marked.groupBy("doc", "page").agg(text.alias("text"), F.bool_or(F.col("level").isNotNull()).alias("rebuilt"))
