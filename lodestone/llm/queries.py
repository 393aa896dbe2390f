"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, ann, bpe, divergence, jaccard, mixing, pii, quality, secrets, sharding, url_lists, vector_dedup, warc

#: Key of the pseudonyms; a deployment passes its own.
KEY = b"lodestone example key"
RANKS = "byte_bpe_multi_50k.tiktoken"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label no findings, so those that teach are drawn, half of them among the documents' own words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = spark.createDataFrame(secrets.example_findings(), "text string, start_at int, end_at int, path string, label int")
    labelled = drawn.unionByName(secrets.planted_findings(docs, 4000))
    found = secrets.scan(docs, secrets.train(labelled, secrets.dictionary(docs)))
    return found.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents"))


def op4_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op5_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op6_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.example(read(spark, sf_dir, "pages"))


def op7_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests are of the payloads read back; a revisit's are those it states, as its payload is not stored."""
    got = warc.round_trip(read(spark, sf_dir, "pages"))
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    stored = F.col("warc_type") == "response"
    return got.select(
        page("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("bigint")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(stored, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op8_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY).select("doc_id", "text", F.size("findings").alias("n_found"), "findings")


def op9_weighted_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(read(spark, sf_dir, "documents"), a, b)


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_forest, op2_quality_rules, op3_ngram_jaccard, op4_rp_forest, op5_collision_counting, op6_temporal_url_list, op7_zip_warc, op8_feistel_pii, op9_weighted_fair_mix, op10_byte_bpe, op11_source_divergence, op12_token_alignment, op13_hash_tree)}

SQL = {"op6_temporal_url_list": url_lists.SQL, "op7_zip_warc": warc.SQL, "op9_weighted_fair_mix": mixing.SQL, "op11_source_divergence": divergence.SQL, "op13_hash_tree": sharding.SQL}
