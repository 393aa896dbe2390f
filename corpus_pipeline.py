"""From documents to token ids: five stages, each one operator of lodestone.llm.

Every stage takes what its predecessor wrote. All but the last return the columns of documents; rows
with a null id or text go through as the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, jaccard, mixing, pii, quality
from lodestone.llm._common import table
from lodestone.llm.queries import KEY, RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model).filter("score >= 0.5").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies. Rows that repeat an id are told apart by their words, and
    by their texts where they have none; rows without an id cannot be told apart and all stay."""
    found = table(jaccard.near_duplicates(docs, keys=True).filter("doc_id is not null and class_key is not null").select("doc_id", "class_key", "component_key", "kept"), "found")
    # several classes of a component may share the id that stays: the first of them stays
    first = found.filter("kept").groupBy("doc_id", "component_key").agg(F.min("class_key").alias("class_key"))
    key = ["doc_id", "class_key"]
    gone = found.select(*key).distinct().join(first.select(*key), key, "left_anti")
    keyed = jaccard.with_class_key(docs.select(*COLUMNS))
    kept = keyed.join(gone, key, "left_anti")
    again = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key)
    known = F.col("doc_id").isNotNull() & F.col("class_key").isNotNull()
    once = kept.filter(known).join(again, key, "left_anti").select(*COLUMNS)
    repeated = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*COLUMNS[1:])).alias("d")).select("doc_id", "d.*")
    blank = keyed.filter("doc_id is not null and class_key is null").select(*COLUMNS).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).unionByName(blank).unionByName(docs.select(*COLUMNS).filter("doc_id is null"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms; n_chars is that of the new text."""
    done = pii.pseudonymise(docs.select(*COLUMNS), KEY)
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


#: Copies of one row that a task writes from one row of the mix.
COPIES = 256


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, or up to three times. Rows that are equal in all columns
    are one here, with the rounds of all of them; a row taken very often is dealt out in runs of COPIES."""
    docs = docs.select(*COLUMNS).withColumn("row_key", F.md5(F.to_json(F.struct(*COLUMNS)).cast("binary")))
    taken = mixing.mix(docs, keep=("row_key",)).groupBy("row_key").agg(F.sum("rounds").alias("rounds"), F.count(F.lit(1)).alias("rows_"))
    taken = table(taken.filter("rounds > 0"), "taken")
    once = docs.join(taken.filter("rows_ = 1").select("row_key", "rounds"), "row_key")
    once = once.withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds").cast("int")))).select(*COLUMNS)
    # rows that repeat: one of each stands for all, found by partial aggregation
    many = docs.join(taken.filter("rows_ > 1").select("row_key", "rounds"), "row_key").groupBy("row_key").agg(F.max("rounds").alias("rounds"), F.min(F.struct(*COLUMNS)).alias("d"))
    runs = many.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("rounds") - 1) / COPIES)))).repartition("row_key", "run")
    again = runs.withColumn("round", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("rounds") - F.col("run") * COPIES).cast("int"))))
    return once.unionByName(again.select("d.*"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and digests of the ids and of the bytes they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return bpe.digests(coded.drop("text"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("PII", pseudonymise),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: SQL can express neither the classifier nor the permutations nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all stages over documents, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, f"stage{i}")
    return docs
