"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import fingerprints, jaccard_join, license_scan, lm_scoring, media, mixing, packing, period_runs, sharding, substring_dedup, token_counts, toxicity, whitening
from tessera.llm._common import durable


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(mixing.sized(documents(spark, sf_dir)))
    mixed = mixing.apply_plan(rows, mixing.mixture_plan(rows))
    return mixed.select("doc_id", "source", "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("copies") * F.col("size")).alias("taken"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_rows(documents(spark, sf_dir))
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.read_media(media.encode_media(documents(spark, sf_dir)))
    return found.withColumn("feature", F.lower(F.hex("cosine_hash"))).drop("cosine_hash")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.edited_prints(documents(spark, sf_dir))
    own, edited, following = F.col("print"), F.col("edited_print"), F.col("next_print")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"), fingerprints.as_text(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, following).alias("near_next"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("edits", token_counts.sample_edits())
    return token_counts.count_with_edits(docs).drop("text", "edits")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), toxicity.held_out(F.col("doc_id"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.size("matches").alias("n_matches"), F.array_max("matches.coverage").alias("coverage"), F.array_distinct("matches.license").alias("licenses"), "matches")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm_scoring.held_out(F.col("doc_id"))
    model = lm_scoring.learn(documents(spark, sf_dir).select("doc_id", "text"), ~held_out)
    return lm_scoring.score(model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_runs.runs_of_texts(documents(spark, sf_dir), planted=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_hilbert_shards, op3_best_fit_packing, op4_media_columns, op5_substring_dedup, op6_multiset_fingerprints, op7_token_counts, op8_jaccard_join, op9_toxicity,
        op10_license_scan, op11_lm_scores, op12_embedding_whitening, op13_period_runs,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": rf"""
WITH rows AS (
    SELECT doc_id, source, len({_WORDS})::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS s,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
    FROM rows GROUP BY source
), filled AS (
    -- In order of the level at which a source reaches its cap: what is left if this one and all before it are capped.
    SELECT *, 2.0::DOUBLE * s / w AS caps_at,
           (1.5::DOUBLE * sum(s) OVER () - coalesce(sum(2.0::DOUBLE * s) OVER (ORDER BY 2.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
    FROM totals
), level AS (
    SELECT arg_min(level, caps_at) FILTER (WHERE level < caps_at) AS level FROM filled
), targets AS (
    SELECT source, s, CASE WHEN 2 * s <= level.level * w THEN 2.0::DOUBLE * s ELSE level.level * w END AS target FROM totals, level
), budgets AS (
    SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS passes FROM targets
), running AS (
    SELECT r.doc_id, r.source, r.size, b.s, b.target, b.passes, b.target - b.passes * b.s AS rest,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h) AS upto
    FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, s AS source_size, target,
       (passes * size + CASE WHEN abs(upto - rest) < abs(upto - size - rest) THEN size ELSE 0 END)::BIGINT AS taken
FROM running
""",
    "op5_substring_dedup": rf"""
WITH texts AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), windows AS (
    SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM texts WHERE len(w) >= 13)
), firsts AS (
    SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM windows JOIN firsts USING (g) WHERE first_id < doc_id
), marked AS (
    SELECT t.doc_id, t.i, t.word, c.i IS NOT NULL AS gone
    FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM texts) t LEFT JOIN covered c ON t.doc_id = c.doc_id AND t.i = c.i
), summed AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS n_gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT texts.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n_gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN summed ON texts.doc_id = summed.doc_id
""",
    "op8_jaccard_join": rf"""
WITH RECURSIVE texts AS (
    SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS p FROM texts WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)
), reach AS (
    SELECT doc_id, doc_id AS r FROM texts UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT texts.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r)::BIGINT AS component_id
FROM texts LEFT JOIN sizes ON sizes.doc_id = texts.doc_id JOIN reach ON reach.doc_id = texts.doc_id GROUP BY texts.doc_id
""",
}
