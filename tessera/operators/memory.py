"""Memory facts: scores, selection, as-of reads, pruning, caps, mutations and near-duplicate clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import dice

#: What a category adds to a fact's score.
CATEGORY_WEIGHTS = {"identity": 0.15, "preference": 0.10, "constraint": 0.10, "event": 0.0}
HALF_LIFE_DAYS, UNKNOWN_AGE_DAYS = 180.0, 90.0


def age_days(at: Column, now: Column) -> Column:
    seconds = F.timestamp_diff("SECOND", at, now)
    return F.coalesce(F.greatest(seconds / 86400.0, F.lit(0.0)), F.lit(UNKNOWN_AGE_DAYS))


def category_weight(category: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in CATEGORY_WEIGHTS.items():
        out = F.when(category == name, weight).otherwise(out)
    return out


def recency(at: Column, now: Column) -> Column:
    return 0.1 * F.exp(-age_days(at, now) / HALF_LIFE_DAYS)


def fact_score(query: Column, content: Column, category: Column, at: Column, now: Column) -> Column:
    return dice(query, content) + category_weight(category) + recency(at, now)


def fused_score(query: Column, content: Column, cosine: Column, category: Column, at: Column, now: Column) -> Column:
    """0.4 lexical and 0.6 vector likeness where a cosine is known, else the lexical one alone."""
    like = F.when(cosine.isNotNull(), 0.4 * dice(query, content) + 0.6 * F.greatest(cosine, F.lit(0.0))).otherwise(dice(query, content))
    return like + category_weight(category) + recency(at, now)


def select_facts(facts: DataFrame, query: Column, now: Column, k: int = 8, least: float = 0.02, ttl_days: int = 365) -> DataFrame:
    """Each user's best k active facts: not past their time to live (identity and preference have none), like enough, identity always."""
    lasting = F.col("category").isin("identity", "preference")
    fresh = lasting | (age_days(F.col("created_at"), now) <= ttl_days)
    scored = facts.where((F.col("status") == "active") & fresh).withColumn("like", dice(query, F.col("content")))
    scored = scored.where((F.col("like") >= least) | (F.col("category") == "identity"))
    scored = scored.withColumn("score", F.col("like") + category_weight(F.col("category")) + recency(F.col("created_at"), now))
    order = Window.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), F.desc("created_at"), "content")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def active_at(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that held at a time: from valid_from on and before invalid_at; unknown ends are open."""
    return facts.where(F.coalesce(F.col("valid_from") <= at, F.lit(True)) & F.coalesce(at < F.col("invalid_at"), F.lit(True)))


def prune_versions(facts: DataFrame, now: Column, keep_days: int = 90) -> DataFrame:
    """Active facts, and others changed within keep_days or at an unknown time."""
    return facts.where((F.col("status") == "active") | F.col("updated_at").isNull() | (F.col("updated_at") >= now - F.expr(f"INTERVAL {keep_days} DAYS")))


def cap_active(facts: DataFrame, most: int) -> DataFrame:
    """Beyond ``most`` active facts of a user, the oldest become deleted."""
    at = F.coalesce("updated_at", "created_at")
    order = Window.partitionBy("user_id", F.col("status") == "active").orderBy(at.desc(), F.desc("fact_id"))
    over = (F.col("status") == "active") & (F.row_number().over(order) > most)
    return facts.withColumn("status", F.when(over, "deleted").otherwise(F.col("status")))


def keep_last(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= n).drop("_nth")


def backfill(facts: DataFrame, embedded: DataFrame, model: str) -> DataFrame:
    """Active facts without a vector of this model."""
    known = embedded.where(F.col("model") == model).select("user_id", "fact_id").distinct()
    return facts.where("status = 'active'").join(known, ["user_id", "fact_id"], "left_anti")


def apply_mutations(facts: DataFrame, mutations: DataFrame) -> DataFrame:
    """Fold ordered mutations (user_id, seq, operation, fact_key, content, new_id) into each user's facts.

    set replaces the key's active facts and points to the last; add keeps others, and does nothing if an active one has its content; delete
    ends all active facts of the key. Only changes of one user's key depend on each other: each set or delete ends the stretch of
    facts that are active together, so windows over a key tell what becomes of them. Facts come in order of fact_id, before all changes.
    """
    live = F.col("status").eqNullSafe("active")
    held = facts.where(live).select("user_id", "fact_key", F.lit(0).alias("_change"), F.col("fact_id").alias("_at"), "fact_id", "content", F.lit("").alias("_operation"), "supersedes_id")
    new = mutations.select("user_id", "fact_key", F.lit(1).alias("_change"), F.col("seq").alias("_at"), F.col("new_id").alias("fact_id"), "content", F.coalesce("operation", F.lit("")).alias("_operation"), F.lit(None).cast("long").alias("supersedes_id"))
    operation, order = F.col("_operation"), [F.asc("_change"), F.asc_nulls_last("_at"), F.asc("fact_id")]
    ends, of_key, so_far = operation.isin("set", "delete"), Window.partitionBy("user_id", "fact_key"), (Window.unboundedPreceding, -1)
    rows = held.unionByName(new).withColumn("_stretch", F.sum(ends.cast("int")).over(of_key.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A stretch opens with its delete, if that ended the one before, so what comes before an addition with the same content is active, or was left out for what is.
    alike = F.count_if(operation != "delete").over(Window.partitionBy("user_id", "fact_key", "_stretch", "content").orderBy(*order).rowsBetween(*so_far))
    rows = rows.withColumn("_alike", alike).where((operation != "add") | (F.coalesce("_alike", F.lit(0)) == 0))
    before = F.lag(F.when(operation != "delete", F.col("fact_id"))).over(of_key.orderBy(*order))
    rows = rows.withColumn("supersedes_id", F.when(operation == "set", before).otherwise(F.col("supersedes_id")))
    backwards = of_key.orderBy(F.desc("_change"), F.desc_nulls_first("_at"), F.desc("fact_id")).rowsBetween(*so_far)
    rows = rows.withColumn("_end", F.last(F.when(ends, operation), ignorenulls=True).over(backwards)).where(operation != "delete")
    status = F.when(F.col("_end") == "set", "superseded").when(F.col("_end") == "delete", "deleted").otherwise("active")
    columns = [F.col("user_id").cast("long"), F.col("fact_id").cast("long"), "fact_key", "content", "status", F.col("supersedes_id").cast("long")]
    return rows.withColumn("status", status).select(*columns).unionByName(facts.where(~live).select(*columns))


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """(node, cluster): connected components of like pairs (a, b), named by their least member.

    Rounds of joins: each node takes the least name around it until no name changes.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().persist()
    names = both.select(F.col("a").alias("node")).distinct().withColumn("cluster", F.col("node"))
    while True:
        around = both.join(names, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("least"))
        changed = names.join(around, F.col("node") == F.col("a")).select("node", F.least("cluster", "least").alias("cluster"), (F.col("least") < F.col("cluster")).alias("moved"))
        changed = changed.checkpoint() if changed.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else changed.persist()
        if not changed.where("moved").limit(1).count():
            return changed.select("node", "cluster")
        names = changed.select("node", "cluster")
