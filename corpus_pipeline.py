"""A training corpus from ``documents``: filter, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame; all but the last return the columns of docs. run() writes each result
as Parquet to the shared checkpoint folder and reads it back for the next stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, mixing, packing, substring_dedup, toxicity
from tessera.llm._common import bounded_join, durable, ensure_checkpoint_dir

#: The share of the words that the mix keeps; no document is repeated.
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    name, taken = "score", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays, with all its rows; rows without an id stay."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"))
    gone = durable(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    return bounded_join(docs, gone, docs["doc_id"] == gone["_gone"], "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that an earlier document has are cut; documents left without any word go."""
    return substring_dedup.dedup_texts(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources keep words by weight, up to what they have."""
    return mixing.mix_documents(docs, share=MIX_SHARE, max_repeat=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and offset."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", keep_one_of_each_group), ("substring_dedup", cut_repeats), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Model scores and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
