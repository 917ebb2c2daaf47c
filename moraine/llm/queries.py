"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from moraine.llm import covertree, guesses, licenses, mixing, readability, sharding, simhash, surrogates, tiling, toxicity

#: A public tokenizer's vocabulary, whose words the secret scan knows.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier rejects, with their scores. Every document is scored."""
    return toxicity.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_simhash_dedup")
def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has a near-duplicate which stays, with that one. All documents are compared."""
    return simhash.duplicates(table(spark, sf_dir, "documents"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item that it holds half of or more."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_source_mixing", mixing.mixture_sql())
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of a block that gets a seat, with its block, seat and shard."""
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query("op3_hash_tree_sharding", sharding.placement_sql())
def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, rack and shard of every document."""
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id"))


@query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value in a credential context of any document, with its guess cost; never the value itself."""
    return guesses.scanned(table(spark, sf_dir, "documents"), vocabulary=VOCABULARY if os.path.exists(VOCABULARY) else None)


@query("op1_pii_surrogates")
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and how many mentions were replaced."""
    return surrogates.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="replaced")


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each span of a licence template in any document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and main text of every page."""
    return readability.extracted(table(spark, sf_dir, "pages"))


@query("op9_exact_topk", covertree.top_k_sql())
def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar others, among all embeddings, of every embedding whose id is divisible by 20."""
    return covertree.top_k(table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
