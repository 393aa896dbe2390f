"""Sinks: sharded parquet, JSON lines, splits, tokenizer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.sampling import shard_cuts
from lodestone.operators.tokenizer import Tokenizer
from lodestone.sources.shared import scratch  # noqa: F401

#: Characters of the shards that one task writes, about, where there are more shards than shuffle partitions.
TASK_CHARS = 64 << 20


def write_shards(df: DataFrame, path: str, order: str, text: str = "text", shard_chars: int = 250_000_000, row_group: int = 1024, max_chars: int | None = None) -> None:
    """text in shards below path/shard=00000 and so on, names that sort as the shards do: a shard closes at the end of a row group once it holds shard_chars.

    zstd, plain encoding, row groups of row_group rows. The order is cut into shards by sums of row groups;
    a task writes one large shard, or many small ones one after the other.
    """
    from lodestone.operators.sampling import within_budget

    size = F.length(text).cast("bigint")
    if max_chars is not None:
        df = within_budget(df, order, size, max_chars, "lt")
    cut = shard_cuts(df.select(order, text), order, size, shard_chars, row_group)
    n = (cut.agg(F.max("shard")).first()[0] or 0) + 1
    total = df.agg(F.sum(size)).first()[0] or 0
    n = min(n, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_CHARS))
    # sorted by the very column that the writer partitions by: a sort of its own would undo the order in a shard
    rows = cut.select(F.format_string("%05d", "shard").alias("shard"), order, text).repartition(n, "shard").sortWithinPartitions("shard", order).select("shard", text)
    out = rows.write.mode("overwrite").option("compression", "zstd").option("parquet.enable.dictionary", "false").option("parquet.block.row.count.limit", row_group)
    out.partitionBy("shard").parquet(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; null fields are absent, arguments of calls are objects again."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """The train and the test part, each in a folder of its own."""
    for part in ("train", "test"):
        df.filter(F.col(split) == part).drop(split).write.mode("overwrite").json(f"{path}_{part}")


def write_tokenizer(tokenizer: Tokenizer, df_session, path: str) -> None:
    """The vocabulary as a table: id, bytes, is_special, n_bytes, true_bytes."""
    tokenizer.vocabulary(df_session).coalesce(1).write.mode("overwrite").parquet(path)


def read_tokenizer(spark, path: str) -> Tokenizer:
    """A tokenizer from its vocabulary table, whose size is fixed by the vocabulary."""
    rows = spark.read.parquet(path).orderBy("id").collect()
    ranks = {bytes(r["bytes"]): r["id"] for r in rows if not r["is_special"]}
    return Tokenizer(ranks, specials=tuple(bytes(r["bytes"]).decode() for r in rows if r["is_special"]))
