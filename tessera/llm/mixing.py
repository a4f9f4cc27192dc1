"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 48-bit hash of its doc_id. A source's budget becomes a hash
threshold: rows at or below it are taken. The threshold is found by histograms
that sum tokens by source and hash bucket; only the bucket in which the budget
ends is looked at more finely, so nothing is sorted and a larger budget always
takes a superset of the rows of a smaller one.

Defined results: a null text has no words; a null source is a source of its
own, ordered last; rows with equal doc_id (null counts as one value) fall on the same side of a
threshold; an empty table gives an empty plan. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import bounded_join, durable, global_index, word_count

WEIGHTS = (5, 2, 1)
HASH_BITS, BUCKET_BITS = 48, 12


def row_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id: the same in any engine and run."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, hash) of each row; size is its number of words."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("hash"))


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(source, source_size, target): share of all words dealt by weight, none above max_repeat times its size.

    The excess of capped sources is dealt again by weight until none is above
    its cap. Each round is one aggregate of a few numbers over the sources.
    """
    if share > max_repeat:
        raise ValueError("share can't be above max_repeat")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_index(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    totals = durable(ranked.select("source", "source_size", weight.cast("double").alias("_weight")))
    cap, level, capped = F.col("source_size") * max_repeat, 0.0, -1
    while True:
        above = cap <= F.lit(level) * F.col("_weight")
        total, spent, left, n = totals.agg(F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("_weight"))), F.count_if(above)).first()
        if n == capped or not left:
            break
        level, capped = (share * total - (spent or 0)) / left, n
    above = cap <= F.lit(level) * F.col("_weight")
    return totals.select("source", "source_size", F.when(above, cap.cast("double")).otherwise(F.lit(level) * F.col("_weight")).alias("target"))


def _boundary(histogram: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The bucket of each source in which its budget ends, and the words before it.

    A source has at most 2**BUCKET_BITS buckets, so the running sum is bounded.
    """
    running = Window.partitionBy("source").orderBy(bucket)
    cum = histogram.withColumn("_to", F.col("_before") + F.sum("_words").over(running))
    hit = cum.where(F.col("_to") > F.col("_rest")).groupBy("source").agg(F.min_by(F.struct(*keys, bucket, (F.col("_to") - F.col("_words")).alias("_before"), "_rest"), bucket).alias("_hit"))
    return hit.select("source", "_hit.*")


def mixture_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """One row per source: source_size, target, full (whole passes) and cut (last hash taken once more)."""
    targets = source_targets(rows, weights, share, max_repeat)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = durable(targets.withColumn("full", full).withColumn("_rest", F.col("target") - F.col("full") * F.col("source_size")))
    shift1, shift2 = HASH_BITS - BUCKET_BITS, HASH_BITS - 2 * BUCKET_BITS
    rests = targets.select(F.col("source").alias("_source"), "_rest")
    same = F.col("source").eqNullSafe(F.col("_source"))

    coarse = rows.groupBy("source", F.shiftright("hash", shift1).alias("_b1")).agg(F.sum("size").alias("_words"))
    coarse = bounded_join(coarse, rests, same).withColumn("_before", F.lit(0))
    first = durable(_boundary(coarse, [], "_b1"))

    bounds = first.select(F.col("source").alias("_source"), "_b1", "_before", "_rest")
    inside = bounded_join(rows, bounds, same & (F.shiftright("hash", shift1) == F.col("_b1")))
    fine = inside.groupBy("source", "_b1", "_before", "_rest", F.shiftright("hash", shift2).alias("_b2")).agg(F.sum("size").alias("_words"))
    second = durable(_boundary(fine, ["_b1"], "_b2"))

    # What is left is one 2**-24 part of each source: single hashes can be summed up.
    bounds = second.select(F.col("source").alias("_source"), "_b2", "_before", "_rest")
    inside = bounded_join(rows, bounds, same & (F.shiftright("hash", shift2) == F.col("_b2")))
    single = inside.groupBy("source", "_b2", "_before", "_rest", "hash").agg(F.sum("size").alias("_words"))
    running = Window.partitionBy("source").orderBy("hash")
    to = F.col("_before") + F.sum("_words").over(running)
    # The row in which the budget ends is taken if that comes nearer to the target.
    last = single.withColumn("_to", to).where(F.abs(F.col("_to") - F.col("_rest")) < F.abs(F.col("_to") - F.col("_words") - F.col("_rest")))
    cut = last.groupBy("source").agg(F.max("hash").alias("_cut"))
    cuts = second.select(F.col("source").alias("_source"), F.shiftleft("_b2", shift2).alias("_floor")).join(cut, F.col("_source").eqNullSafe(F.col("source")), "left")
    cuts = cuts.select("_source", F.coalesce("_cut", F.col("_floor") - 1).alias("cut"))
    return targets.join(cuts, same, "left").select("source", "source_size", "target", "full", F.when(F.col("_rest") > 0, F.coalesce("cut", F.lit(-1))).otherwise(-1).alias("cut"))


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs with the plan's columns and ``copies``, how often the mix takes each row; that replaces a column ``copies``, in any case."""
    cuts = durable(plan.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "full", "cut")]))
    joined = bounded_join(docs, cuts, docs["source"].eqNullSafe(F.col("_source")))
    copies = F.col("_mix_full") + F.when(row_hash(docs["doc_id"]) <= F.col("_mix_cut"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("_source")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 0.8, max_repeat: int = 1) -> DataFrame:
    """The mixed corpus itself: each row as often as the mix takes it, with the columns of docs, whatever their names."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))
    taken = apply_plan(rows, mixture_plan(durable(sized(docs)), weights, share, max_repeat)).where("copies > 0")
    if max_repeat > 1:
        taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("_row.*")
