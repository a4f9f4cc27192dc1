"""Evaluation: ranking metrics, percentiles, calibration, A/B comparison and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """recall, mrr and ndcg of each case (query_id, expected array); null for negative cases.

    hits are (query_id, key, rank); repeated keys count at their first rank.
    """
    # A key's rank among the distinct keys of its query.
    firsts = hits.groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    firsts = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "key")))
    wanted = cases.select("query_id", F.size("expected").alias("n_expected"), F.explode(F.array_distinct("expected")).alias("key"))
    found = wanted.join(firsts, ["query_id", "key"])
    gains = found.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("covered"), F.min("rank").alias("best"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg"),
    )
    ideal_n = F.least(F.lit(k), F.size(F.array_distinct("expected")))
    ideal = F.aggregate(F.sequence(F.lit(1), ideal_n), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    positive, out = F.size("expected") > 0, cases.join(gains, "query_id", "left")
    return out.select(
        "query_id", positive.alias("positive"),
        F.when(positive, F.coalesce("covered", F.lit(0)) / F.size("expected")).alias("recall"),
        F.when(positive, F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
        F.when(positive, F.coalesce(F.col("dcg") / ideal, F.lit(0.0))).alias("ndcg"),
    )


def strata_report(metrics: DataFrame, tags: DataFrame) -> DataFrame:
    """Means by tag; a case counts in each of its tags (query_id, tag)."""
    every = metrics.join(tags, "query_id").groupBy("tag")
    return every.agg(F.count("*").alias("cases"), *[F.avg(m).alias(m) for m in ("recall", "mrr", "ndcg")])


def nearest_place(q: float) -> Column:
    """Place ceil(q n), from 1, of n values in order."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q)))


def rounded_place(q: float) -> Column:
    """Place round(q (n - 1)) + 1, halves to even."""
    return F.bround((F.col("n") - 1) * F.lit(q)) + 1


def floor_place(q: float) -> Column:
    """Place int(q n)."""
    return F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(q)))


def values_at(rows: DataFrame, by: str, value: str, places: dict[str, Column]) -> DataFrame:
    """The values of each group at places (from 1) that follow from its number of values ``n``; null values count as none.

    Equal values are counted before anything is put in order, and the running sum over a group's different values spills.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value))
    ordered = counts.withColumn("_upto", upto).withColumn("n", F.sum("_c").over(Window.partitionBy(by)))
    return ordered.groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= place, F.col(value))).alias(name) for name, place in places.items()])


def percentile_linear(value: str, q: float) -> Column:
    return F.percentile(value, F.lit(q))


#: Ranges of scores, each in one task, that auc() adds up.
AUC_RANGES = 200


def auc(scores: DataFrame) -> DataFrame:
    """P(positive > negative) + P(equal) / 2 of (score, positive); rows without a score or verdict are left out.

    Counts by distinct score are dealt into ranges by bounds that are fixed numbers once they are found, so that every use of them agrees; where they lie
    only evens out the ranges. Each range has a running sum of its own that starts from the negatives of the ranges before it.
    """
    by = scores.where("score is not null and positive is not null").groupBy(F.col("score").cast("double").alias("score"))
    by = by.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    bounds = sorted(set(by.where("not isnan(score)").approxQuantile("score", [k / AUC_RANGES for k in range(1, AUC_RANGES)], 0.25 / AUC_RANGES)))
    # NaN is the largest score, as Spark orders it.
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("score"))) if bounds else F.lit(0)
    placed = by.withColumn("part", part)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range.
    starts = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    below = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    by = placed.join(F.broadcast(starts), "part").withColumn("below", F.col("start") + F.coalesce(F.sum("n").over(below), F.lit(0)))
    return by.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def wald_interval(groups: DataFrame, by: str, hit: str) -> DataFrame:
    """Share of hits by group with its 95% normal interval."""
    p, n = F.avg(F.col(hit).cast("double")), F.count("*")
    out = groups.groupBy(by).agg(n.alias("n"), p.alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return out.withColumn("low", F.col("p") - half).withColumn("high", F.col("p") + half)


def threshold_sweep(hits: DataFrame, cases: DataFrame, thresholds: DataFrame, k: int) -> DataFrame:
    """(threshold, recall, rejected): mean recall of positive cases and share of negative ones without hits.

    hits are (query_id, key, rank, score, relevant); hits are gated and ranked anew for each threshold.
    """
    gated = hits.join(F.broadcast(thresholds), F.col("score") >= F.col("threshold"))
    again = Window.partitionBy("threshold", "query_id").orderBy("rank")
    kept = gated.withColumn("_r", F.row_number().over(again)).where(F.col("_r") <= k)
    found = kept.groupBy("threshold", "query_id").agg(F.count_if("relevant").alias("covered"), F.count("*").alias("n"))
    every = cases.crossJoin(F.broadcast(thresholds)).join(found, ["threshold", "query_id"], "left")
    recall = F.avg(F.when(F.col("n_expected") > 0, F.coalesce("covered", F.lit(0)) / F.col("n_expected")))
    rejected = F.avg(F.when(F.col("n_expected") == 0, F.col("n").isNull().cast("double")))
    return every.groupBy("threshold").agg(recall.alias("recall"), rejected.alias("rejected"))


def calibrate(sweep: DataFrame, least_recall: float) -> DataFrame:
    """The highest threshold that keeps the recall."""
    return sweep.where(F.col("recall") >= least_recall).agg(F.max("threshold").alias("threshold"), F.count("*").alias("feasible"))


def rejection_grid(signals: DataFrame, grid: DataFrame, least_negative: float = 0.90, most_positive: float = 0.05) -> DataFrame:
    """Each setting (ord, top1, gap, coverage thresholds) with its reject rates and whether it is feasible.

    signals are (query_id, positive, top1, gap, coverage); a threshold of 0 isn't used.
    """
    below = [(F.col(f"t_{c}") > 0) & (F.col(c) < F.col(f"t_{c}")) for c in ("top1", "gap", "coverage")]
    rejected = F.coalesce(below[0], F.lit(False)) | F.coalesce(below[1], F.lit(False)) | F.coalesce(below[2], F.lit(False)) | F.col("top1").isNull()
    tried = signals.join(F.broadcast(grid)).withColumn("_no", rejected.cast("double"))
    rates = tried.groupBy("ord", "t_top1", "t_gap", "t_coverage").agg(F.avg(F.when(~F.col("positive"), F.col("_no"))).alias("negative_rejected"), F.avg(F.when(F.col("positive"), F.col("_no"))).alias("positive_rejected"))
    return rates.withColumn("feasible", (F.col("negative_rejected") >= least_negative) & (F.col("positive_rejected") <= most_positive))


def ab_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cases of both runs (case_id, passed): unchanged, fixed or broken, joined one to one."""
    both = before.select("case_id", F.col("passed").alias("was")).join(after.select("case_id", F.col("passed").alias("now")), "case_id")
    return both.withColumn("change", F.when(F.col("was") == F.col("now"), "same").when(F.col("now"), "fixed").otherwise("broken"))


def security_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Categories (category, rate) whose rate dropped, or that are missing, in the second run."""
    both = before.withColumnRenamed("rate", "was").join(after.withColumnRenamed("rate", "now"), "category", "full")
    return both.withColumn("finding", F.when(F.col("now").isNull(), "missing").when(F.col("now") < F.col("was"), "dropped")).where("finding is not null")


def case_pass(cases: DataFrame, dimensions: list[str], least: float = 0.6) -> DataFrame:
    """passed: no error, critical cases by their gate, and every dimension that is there at least ``least``."""
    present = F.array_compact(F.array(*dimensions))
    ok = F.forall(present, lambda x: x >= least)
    return cases.withColumn("passed", F.when(F.col("error"), False).when(F.col("critical") & ~F.col("critical_ok"), False).otherwise(ok))


def release_gates(summary: DataFrame, least: dict[str, float], most_p95: float) -> DataFrame:
    """One row of figures to the list of gates it fails."""
    low = [F.when(F.coalesce(F.col(m) < v, F.lit(True)), f"{m}_low") for m, v in least.items()]
    failed = F.array_compact(F.array(*low, F.when(F.col("p95") > most_p95, "p95_high"), F.when(F.col("degraded") > 0, "degraded")))
    return summary.withColumn("failed", F.array_join(failed, ","))


#: The categories that gates look at, other names for them, and the least pass rates of all cases and of a category.
GATED = ("inject", "abuse", "complaint")
OTHER_NAMES = {"injection": "inject"}
LEAST_OVERALL, LEAST_CATEGORY = 0.80, 0.70


def ab_gates(before: DataFrame, after: DataFrame, judged: DataFrame, categories: tuple[str, ...] = GATED) -> DataFrame:
    """One row: whether a second run may be released, by cases (category, passed, critical, error) of both runs and of the second one's full, judged round.

    Gates: ``overall_ok`` (both rounds of the second run pass at least 80% of their cases; a round without cases passes none), ``categories_ok`` (each gated category has cases
    in the second run, passes at least 70%, and no less than before; a category without cases before has no such bound), ``critical_ok`` (every case whose critical gate
    was tested passed it), ``api_errors_ok`` (no case of the judged round ended in an error). Nulls in passed and error count as false, in critical as not tested.
    """
    rows = lambda df, run: df.select(F.lit(run).alias("run"), "category", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("passed", "error")], "critical")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in OTHER_NAMES.items() for x in pair]), F.col("category")), F.col("category"))
    every = rows(before, "before").unionByName(rows(after, "after")).unionByName(rows(judged, "judged")).withColumn("category", name)
    of = lambda run, c=None: (F.col("run") == run) if c is None else (F.col("run") == run) & (F.col("category") == c)
    rate = lambda *which: F.avg(F.when(of(*which), F.col("passed").cast("double")))
    # One aggregate over all runs: nothing is joined.
    one = every.agg(
        F.coalesce(rate("after"), F.lit(0.0)).alias("overall"), F.coalesce(rate("judged"), F.lit(0.0)).alias("full"),
        F.count_if(of("after") & F.col("critical").isNotNull()).alias("critical_total"), F.count_if(of("after") & F.col("critical")).alias("critical_passed"), F.count_if(of("judged") & F.col("error")).alias("api_errors"),
        F.array(*[F.struct(F.lit(c).alias("category"), rate("before", c).alias("was"), rate("after", c).alias("now")) for c in categories]).alias("rates"),
    )
    good = lambda r: F.coalesce(r["now"] >= F.greatest(F.lit(LEAST_CATEGORY), F.coalesce(r["was"], F.lit(0.0))), F.lit(False))
    gates = {
        "overall_ok": (F.col("overall") >= LEAST_OVERALL) & (F.col("full") >= LEAST_OVERALL), "categories_ok": F.forall("rates", good), "critical_ok": F.col("critical_total") == F.col("critical_passed"),
        "api_errors_ok": F.col("api_errors") == 0,
    }
    share = F.when(F.col("critical_total") > 0, F.col("critical_passed") / F.col("critical_total")).otherwise(1.0)
    out = one.withColumns(gates).withColumn("critical_rate", F.round(share, 4)).withColumn("failed_categories", F.filter("rates", lambda r: ~good(r))["category"])
    return out.withColumns({"overall": F.round("overall", 4), "full": F.round("full", 4), "passed": F.col("overall_ok") & F.col("categories_ok") & F.col("critical_ok") & F.col("api_errors_ok")})


def trace_figures(llm_calls: Column, tool_calls: Column) -> dict[str, Column]:
    """Of one run's calls (structs with total_tokens and reasoning_tokens; structs with name): sums, counts, and the names of tools in order. Nulls count as none."""
    def sum_of(name: str) -> Column:
        return F.coalesce(F.aggregate(llm_calls, F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(c[name].cast("long"), F.lit(0))), F.lit(0))

    count = lambda calls: F.coalesce(F.array_size(calls), F.lit(0))
    names = F.coalesce(F.transform(tool_calls, lambda c: c["name"]), F.array().cast("array<string>"))
    return {"total_tokens": sum_of("total_tokens"), "reasoning_tokens": sum_of("reasoning_tokens"), "num_llm_calls": count(llm_calls), "num_tool_calls": count(tool_calls), "tool_call_names": names}


def react_protocol(traces: DataFrame) -> DataFrame:
    """One row over traces (react_steps, steps_margin_hint, forced_finalize, protocol_corrections): rates, the mean number of steps (two places) and all corrections; 0 without traces."""
    total = F.count("*")
    rate = lambda c: F.coalesce(F.try_divide(F.count_if(c), total), F.lit(0.0)).alias(f"{c}_rate")
    steps = F.coalesce(F.round(F.try_divide(F.sum("react_steps"), total), 2), F.lit(0.0))
    return traces.agg(rate("steps_margin_hint"), rate("forced_finalize"), steps.alias("avg_react_steps"), F.coalesce(F.sum("protocol_corrections"), F.lit(0)).alias("protocol_corrections_total"))
