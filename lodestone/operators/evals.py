"""Benchmark evaluation: few-shot choice, prompts, masks, collation, and scoring of recorded predictions.

Model outputs enter as columns (loss, predicted token), so scoring is ordinary aggregation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import metrics as M
from lodestone.functions.text import strip
from lodestone.operators.tokenizer import Tokenizer

ITEM = "pos bigint, query string, choices array<string>, gold int, context_options array<string>, continuation string, context string"


def _render(shots: Column, shot, tail: Column) -> Column:
    return F.concat(F.array_join(F.transform(shots, lambda e: F.concat(shot(e), F.lit("\n"))), ""), tail)


def choice_prompts(item: Column, delimiter: str, shots: Column) -> Column:
    """A prompt for each choice: examples with their gold answers, then the query and the choice."""
    d = F.lit(delimiter)
    return F.transform(item["choices"], lambda c: _render(shots, lambda e: F.concat(e["query"], d, F.get(e["choices"], e["gold"])), F.concat(item["query"], d, c)))


def schema_prompts(item: Column, delimiter: str, shots: Column) -> Column:
    """A prompt for each context: the continuation is the same."""
    d = F.lit(delimiter)
    return F.transform(item["context_options"], lambda c: _render(shots, lambda e: F.concat(F.get(e["context_options"], e["gold"]), d, e["continuation"]), F.concat(c, d, item["continuation"])))


def lm_prompts(item: Column, delimiter: str, shots: Column) -> Column:
    """The prompt without its continuation, stripped, and with it."""
    d = F.lit(delimiter)
    shot = lambda e: F.concat(strip(e["context"]), d, e["continuation"])
    head = F.concat(strip(item["context"]), d)
    return F.array(strip(_render(shots, shot, head)), _render(shots, shot, F.concat(head, item["continuation"])))


def prompts(item: Column, task_type: Column, delimiter: str, shots: Column) -> Column:
    return F.when(task_type == "multiple_choice", choice_prompts(item, delimiter, shots)).when(task_type == "schema", schema_prompts(item, delimiter, shots)).when(task_type == "language_modeling", lm_prompts(item, delimiter, shots))


def few_shot(items: DataFrame, n: int, seed: int = 1234, task: str = "task", pos: str = "pos") -> DataFrame:
    """items with shots: n others of their task, by the MD5 of seed, the item's first equal place, and the draw.

    Places are drawn without replacement by arithmetic on the hash, so no item meets all others: a draw among the
    places that are left moves up past each place, in order, that was taken before it, the item's own first. A task
    of n items or fewer is an error.
    """
    fields = [c for c in items.columns if c != task]
    same = [c for c in fields if c != pos]
    first = F.min(pos).over(Window.partitionBy(task, F.xxhash64(*same), *same))
    size = items.groupBy(F.col(task).alias("task_")).agg(F.count(F.lit(1)).alias("n_"))
    rows = items.withColumn("first_", first).join(F.broadcast(size), F.col(task) == F.col("task_")).drop("task_")
    if n <= 0:
        return rows.drop("n_").withColumnRenamed("first_", "index").withColumn("shots", F.slice(F.array(F.struct(*fields)), 1, 0))
    enough = F.assert_true(F.col("n_") > n, F.lit(f"a task has too few items for {n} others of each"))
    rows = rows.filter(enough.isNull())

    def draw(taken: Column, k: Column) -> Column:
        drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("first_").cast("string"), k.cast("string")).cast("binary"))
        left = F.pmod(F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint"), F.col("n_") - F.size(taken))
        place = F.aggregate(F.array_sort(taken), left, lambda p, x: F.when(p >= x, p + 1).otherwise(p))
        return F.concat(taken, F.array(place))

    own = F.array(F.col("first_").cast("bigint"))
    picks = F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(n)), own, draw), 2, n)
    asked = rows.select("*", F.posexplode_outer(picks).alias("k_", "pick_"))
    pool = items.select(F.col(task).alias("t_"), F.col(pos).alias("p_"), F.struct(*fields).alias("shot_"))
    met = asked.join(pool, (F.col(task) == F.col("t_")) & (F.col("pick_") == F.col("p_")), "left")
    shots = F.transform(F.array_sort(F.collect_list(F.when(F.col("shot_").isNotNull(), F.struct("k_", "shot_")))), lambda x: x["shot_"])
    return met.groupBy(task, *fields, F.col("first_").alias("index")).agg(shots.alias("shots"))


def masked_sequences(df: DataFrame, tokenizer: Tokenizer, max_len: int, prompt: str = "prompts", task_type: str = "task_type") -> DataFrame:
    """df with sequences: array of (ids, mask), cut to their tails. Choices learn what follows their common
    prefix, schemas their common suffix, language modelling what follows the context."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)
    schema = df.withColumn("ids_", F.lit(None).cast("array<array<int>>")).schema

    def run(batches):
        for b in batches:
            got = [None if p is None else [shared.value.encode(x, shared.value.bos) for x in p] for p in b.column(b.schema.get_field_index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(pa.list_(pa.int32())))], names=[*b.schema.names, "ids_"])

    rows = df.mapInArrow(run, schema)
    ids, kind = F.col("ids_"), F.col(task_type)
    pair = lambda t, m: F.struct(A.keep_tail(t, max_len).alias("ids"), A.keep_tail(m, max_len).alias("mask"))
    prefix, suffix = A.common_length(ids), A.common_length(ids, from_right=True)
    whole = F.get(ids, F.lit(1))
    made = (
        F.when(kind == "multiple_choice", F.transform(ids, lambda t: pair(t, A.choice_mask(t, prefix))))
        .when(kind == "schema", F.transform(ids, lambda t: pair(t, A.suffix_mask(t, suffix))))
        .when(kind == "language_modeling", F.array(pair(whole, A.continuation_mask(F.get(ids, F.lit(0)), whole))))
    )
    return rows.withColumn("sequences", made).drop("ids_")


def collated(df: DataFrame, minibatch: int, pad: int, pos: str = "seq", ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Sequences padded to the bucket of the longest of their minibatch. df is read twice: the longest are found from
    sizes alone, and sequences pass their join without a sort, which would hold a task's share of them in memory."""
    rows = df.withColumn("batch_id", F.floor(F.col(pos) / minibatch))
    longest = rows.groupBy(F.col("batch_id").alias("batch_")).agg(A.bucket(F.max(F.size(ids))).alias("length"))
    rows = rows.join(longest.hint("shuffle_hash"), F.col("batch_id").eqNullSafe(F.col("batch_"))).drop("batch_")
    return rows.withColumns({ids: A.pad(F.col(ids), F.col("length"), pad), mask: A.pad(F.col(mask), F.col("length"), 0)})


def choice_correct(predictions: DataFrame, item: list[str], choice: str = "choice", loss: str = "loss", length: str = "length", gold: str = "gold") -> DataFrame:
    """Per item: the choice of least mean loss, and whether it is the gold one."""
    out = predictions.groupBy(*item).agg(M.first_least(F.col(choice), F.col(loss), F.col(length)).alias("predicted"), F.first(gold).alias("gold"))
    return out.withColumn("correct", F.coalesce(F.col("predicted") == F.col("gold"), F.lit(False)))


def lm_correct(tokens: DataFrame, item: list[str], predicted: str = "predicted", target: str = "target", valid: str = "valid") -> DataFrame:
    return tokens.groupBy(*item).agg(M.all_match(F.col(predicted), F.col(target), F.col(valid)).alias("correct"))


def with_baseline(rows: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """rows with the baseline of their task; a task without a baseline is an error."""
    out = rows.join(F.broadcast(baselines.select(F.col(task).alias("task_"), "baseline")), F.col(task) == F.col("task_"), "left")
    ok = F.assert_true(F.col("baseline").isNotNull(), F.concat(F.lit("no random baseline for "), F.coalesce(F.col(task), F.lit("null"))))
    return out.filter(ok.isNull()).drop("task_")


def task_scores(items: DataFrame, baselines: DataFrame, task: str = "task") -> DataFrame:
    """task, accuracy, centered; a task without a baseline is an error."""
    scored = items.groupBy(task).agg(M.accuracy(F.col("correct")).alias("accuracy"))
    return with_baseline(scored, baselines, task).select(task, "accuracy", M.centered(F.col("accuracy"), F.col("baseline")).alias("centered"))


def with_token_bytes(tokens: DataFrame, vocabulary: DataFrame, target: str = "target") -> DataFrame:
    """tokens with n_bytes of their targets; 0 for special tokens and ignored targets."""
    table = vocabulary.select(F.col("id").alias("id_"), F.col("n_bytes").cast("bigint").alias("n_bytes"))
    out = tokens.join(table, F.col(target) == F.col("id_"), "left").drop("id_")
    return out.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))


def core(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("centered").alias("core_metric"))


def sequence_logp(tokens: DataFrame, keys: list[str], logp: str = "logp", target: str = "target") -> DataFrame:
    """Sum of log-probabilities of each sequence over the targets that are not ignored."""
    return tokens.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(target) != A.IGNORE, F.col(logp))), F.lit(0.0)).alias("logp"))


def mean_of_steps(df: DataFrame, step: str, *values: str) -> DataFrame:
    """Means of the steps' means: steps count alike, whatever their rows."""
    each = df.groupBy(step).agg(*[F.avg(v).alias(v) for v in values])
    return each.agg(*[F.avg(v).alias(v) for v in values])


def tokenizer_comparison(lengths: DataFrame, base: str = "base", ours: str = "ours") -> DataFrame:
    """Per text name: bytes, tokens and ratios of two tokenizers, the difference in percent, and the winner.

    lengths: name, tokenizer, n_bytes, n_tokens.
    """
    wide = lengths.groupBy("name").pivot("tokenizer", [base, ours]).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    ratio = {t: F.col(f"{t}_n_bytes") / F.col(f"{t}_n_tokens") for t in (base, ours)}
    winner = F.when(ratio[base] > ratio[ours], base).when(ratio[ours] > ratio[base], ours).otherwise("tie")
    return wide.select("name", ratio[base].alias("base_ratio"), ratio[ours].alias("ours_ratio"), M.relative_difference(F.col(f"{base}_n_tokens"), F.col(f"{ours}_n_tokens")).alias("relative_diff"), winner.alias("winner"))
