"""The registered corpus queries: against SQL where there is any, and the pipeline against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import mixing, queries
from tests.llm.test_operators import brute_components, words_of
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_mix_sources": "doc_id size source_size target taken", "op2_hilbert_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op5_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op6_multiset_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op7_token_counts": "doc_id n_tokens edited_tokens",
    "op8_jaccard_join": "doc_id n_shingles component_id", "op9_toxicity": "doc_id held_out score predicted", "op10_license_scan": "doc_id n_matches matches",
    "op11_lm_scores": "doc_id held_out n_tokens n_known train_tokens base_score score", "op12_embedding_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_period_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    found = queries.QUERIES[name](spark, SF).cache()
    assert set(COLUMNS[name].split()) <= set(found.columns)
    table, key = ("embeddings", "vec_id") if name.startswith("op12_") else ("documents", "doc_id")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert found.select(key).distinct().count() == n
    if name in queries.ORACLE_SQL:
        assert rows_of(found) == rows_of_sql(connect(SF), queries.ORACLE_SQL[name])


def test_pipeline_stages(spark, tmp_path):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        out[name] = (before, docs)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
    before, after = ([tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()] for d in out["ngram_jaccard_join"])
    assert sorted(r[0] for r in after) == sorted(i for i, _, c in brute_components(before) if i == c)
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in out["substring_dedup"])
    first = {}
    for i in sorted(before):
        ws = words_of(before[i])
        for p in range(len(ws) - 12):
            first.setdefault(tuple(ws[p : p + 13]), i)
    for i, text in before.items():
        ws = words_of(text)
        gone = {q for p in range(len(ws) - 12) if first[tuple(ws[p : p + 13])] < i for q in range(p, p + 13)}
        if not gone:
            assert after[i] == text
        elif len(gone) == len(ws):
            assert i not in after
        else:
            assert after[i].encode() == b" ".join(w for q, w in enumerate(ws) if q not in gone)
    before, after = out["mix_sources"]
    sized = mixing.sized(before)
    plan = {r["source"]: r for r in mixing.mixture_plan(sized, share=corpus_pipeline.MIX_SHARE, max_repeat=1).collect()}
    taken, largest = Counter(), Counter()
    for r in mixing.sized(after).collect():
        taken[r["source"]] += r["size"]
    for r in sized.collect():
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - p["target"]) <= largest[s] for s, p in plan.items())
    before, packed = out["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == before.count() and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "substring_dedup", "mix_sources", "best_fit_packing"]


def test_run_returns_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, SF).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
