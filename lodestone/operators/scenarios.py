"""Scenarios for generated rollouts: batches of sampled constraints, request texts, stamps, judged attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import json as J
from lodestone.operators import conversations as C

# The request that a scenario is wrapped in.
REQUEST = "Generate a rollout of non-trivial complexity of a user and agent interacting together. This could involve multiple separate tool uses, and collaboration, and reading and editing large code files. The user's initial request should be: '"
NOTES = "'. The following complexity should also be introduced when relevant: '"
#: Rating from which a critique lets an attempt pass.
LEAST_RATING = 9


def _drawn(values: list[str], seed: str, batch: Column, k: int) -> Column:
    """k of the values without replacement, in the order of their hashes with the batch."""
    keyed = F.transform(F.array(*map(F.lit, values)), lambda v: F.struct(F.md5(F.concat(F.lit(f"{seed}:"), batch.cast("string"), F.lit(":"), v).cast("binary")).alias("h"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda x: x["v"])


def batches(spark: SparkSession, n: int | DataFrame, tasks: list[str], domains: list[str], modifiers: list[str], seed: str = "scenario", k: int = 5) -> DataFrame:
    """batch, tasks, domains, notes: k task types and domains for each batch, and one modifier or none. The batches are
    0 to n - 1, or those of a table that has a column batch."""
    b = F.col("batch")
    own = n.select("batch") if isinstance(n, DataFrame) else spark.range(n).select(F.col("id").alias("batch"))
    return own.select("batch", _drawn(tasks, seed + "t", b, k).alias("tasks"), _drawn(domains, seed + "d", b, k).alias("domains"), F.get(_drawn(modifiers, seed + "m", b, 1), F.lit(0)).alias("notes"))


def collected(answers: DataFrame) -> DataFrame:
    """id, prompt, notes from (batch, notes, answer): ids are made unique by their batch; bad answers give no rows."""
    items = F.try_variant_get(F.try_parse_json("answer"), "$.scenarios", "array<struct<id:string,prompt:string>>")
    rows = answers.select("batch", "notes", F.explode(items).alias("s"))
    return rows.select(F.concat(F.lit("b"), F.col("batch").cast("string"), F.lit("_"), "s.id").alias("id"), F.col("s.prompt").alias("prompt"), "notes")


def request(prompt: Column, notes: Column) -> Column:
    """The request made for a scenario, with its notes if it has any."""
    more = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit(NOTES), notes)).otherwise(F.lit(""))
    return F.concat(F.lit(REQUEST), prompt, more, F.lit("'"))


def stamped(rollouts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """rollouts (id, messages) with the fields of their scenarios."""
    s = scenarios.select(F.col("id").alias("_scenario_id"), F.col("prompt").alias("_scenario_prompt"), request(F.col("prompt"), F.col("notes")).alias("_generator_prompt"))
    return rollouts.join(s, F.col("id") == F.col("_scenario_id")).drop("id")


def judged(attempts: DataFrame, most_tokens: int = 4096) -> DataFrame:
    """Attempts (messages, n_tokens, rating) with kind and passed: rules first, then length, then the rating.
    A rollout that breaks rules is not rated; a null rating of one that should have been is a failure."""
    broken = F.size(C.long_problems(F.col("messages"))) > 0
    long = F.col("n_tokens").isNull() | (F.col("n_tokens") > most_tokens)
    kind = F.when(long, "tokenization").when(broken, "rules").when(F.coalesce("rating", F.lit(0)) < LEAST_RATING, "critique")
    return attempts.withColumn("kind", kind).withColumn("passed", F.col("kind").isNull())


def restyled(attempts: DataFrame) -> DataFrame:
    """Attempts (id, attempt, messages, answer, rating) with styled, kind and passed: the answer's contents in
    place of the assistant's, if they are as many, change nothing else and are rated well enough. A
    conversation without the assistant passes as it is."""
    m = F.col("messages")
    n = F.size(C.assistant_places(m))
    rows = attempts.withColumn("contents_", J.answer_contents(F.col("answer"), n))
    rows = rows.withColumn("styled", F.when(n == 0, m).when(F.size("contents_") == n, C.replace_answers(m, F.col("contents_"))))
    kind = F.when(n == 0, None).when(F.col("contents_").isNull(), "json_error").when(F.col("styled").isNull(), "wrong_count").when(F.size(C.restyle_problems(m, F.col("styled"))) > 0, "validation_failed").when(F.coalesce("rating", F.lit(0)) < LEAST_RATING, "critique_score")
    return rows.withColumn("kind", kind).withColumn("passed", F.col("kind").isNull()).drop("contents_")


def preference_pairs(restyles: DataFrame, key: str = "id") -> DataFrame:
    """chosen (the first styled that passed) and rejected (the original) of each conversation that has one."""
    ok = restyles.filter("passed").groupBy(key).agg(F.min_by(F.struct("styled", "messages"), "attempt").alias("p"))
    return ok.select(key, F.col("p.styled").alias("chosen"), F.col("p.messages").alias("rejected"))


def attempt_statistics(resolved: DataFrame) -> DataFrame:
    """kept, failed and the mean number of attempts; 0 without any."""
    return resolved.agg(F.count("chosen_at").alias("kept"), F.count_if(F.col("chosen_at").isNull()).alias("failed"), F.coalesce(F.avg("attempts"), F.lit(0.0)).alias("mean_attempts"))
