"""Queries of the text operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.llm import bpe, decontaminate, hard_negatives, infill, license_scan, permutations, pii, quality_model, repetition, sharding, simhash, url_filter
from rallyplan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register under the function's name."""
    QUERIES[f.__name__] = f
    return f


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


ORACLES["op2_url_filter"] = url_filter.oracle()


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition rules on every document."""
    return repetition.quality(table(spark, sf_dir, "documents"))


@query
def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the tokenization automaton."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document by the whole-token shortcut."""
    return bpe.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.balanced_shards(table(spark, sf_dir, "documents"))


@query
def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form and hashes of every document."""
    return infill.digests(table(spark, sf_dir, "documents"))


ORACLES["op11_fill_in_middle"] = infill.oracle()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; some labels are turned on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = hard_negatives.oracle()


@query
def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every hundredth one, among all."""
    return permutations.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
