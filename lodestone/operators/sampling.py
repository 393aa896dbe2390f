"""Deterministic shuffles, splits, samples, budgets, unions and running sums without a global task."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles that a numeric order is cut at, and rows of one range between them: ranges grow with the table.
RANGES, RANGE_ROWS = 64, 1_000_000
#: Rows of the range that a budget's boundary is cut from, at most.
EDGE_ROWS = 100_000
#: Blocks of a shard cut that a task follows at once.
CHUNK = 65_536
#: Hexadecimal digits of a shuffle key that make a range: 65,536 ranges, each a task of a window.
DIGITS = 4


def shuffle_key(seed: int | str, *keys: Column | str) -> Column:
    """A key whose order is a random one, the same in every engine with MD5."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))


def _running(df: DataFrame, cell: Column, order: list[Column | str], value: Column, name: str, inclusive: bool) -> DataFrame:
    """Running sum over the whole order: sums by cell first, then within each cell. Cells follow the order."""
    cells = df.withColumn("cell_", cell)
    sums = cells.groupBy("cell_").agg(F.sum(value).alias("sum_"))
    sums = sums.select(F.col("cell_").alias("at_"), F.coalesce(F.sum("sum_").over(Window.partitionBy(F.lit(0)).orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    w = Window.partitionBy("cell_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = cells.join(F.broadcast(sums), F.col("cell_") == F.col("at_"))  # one row a cell
    return out.withColumn(name, F.col("before_") + F.coalesce(F.sum(value).over(w), F.lit(0))).drop("cell_", "at_", "before_")


def running_sum(df: DataFrame, order: str, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Running sum by a numeric column: the order is cut at quantiles, and between them evenly into ranges of about
    RANGE_ROWS rows, so no task holds all rows."""
    bounds = sorted(set(df.approxQuantile(order, [i / RANGES for i in range(RANGES + 1)], 0.002)))
    cell = F.lit(0)
    if len(bounds) > 1:
        fine = max(1, -(-df.count() // (RANGES * RANGE_ROWS)))
        at, edges = F.col(order).cast("double"), F.array(*map(F.lit, bounds))
        coarse = F.least(F.size(F.filter(F.array(*map(F.lit, bounds[1:])), lambda b: b < at)), F.lit(len(bounds) - 2))
        low, high = F.get(edges, coarse), F.get(edges, coarse + 1)
        within = F.greatest(F.least(F.floor((at - low) / (high - low) * fine), F.lit(fine - 1)), F.lit(0))
        cell = coarse.cast("bigint") * fine + within
    return _running(df, F.coalesce(cell.cast("bigint"), F.lit(-1)), [order], value, name, inclusive)


def shuffled(df: DataFrame, seed: int | str, *keys: str, name: str = "pos") -> DataFrame:
    """df with its 1-based place in a seeded random order of the keys."""
    df = df.withColumn("shuffle_", shuffle_key(seed, *keys))
    cell = F.conv(F.substring("shuffle_", 1, DIGITS), 16, 10).cast("int")
    return _running(df, cell, ["shuffle_", *keys], F.lit(1), name, True).drop("shuffle_")


def head_fraction(df: DataFrame, fraction: float, pos: str = "pos") -> DataFrame:
    """The first int(n * fraction) rows by place."""
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    return df.join(F.broadcast(n), F.col(pos) <= F.floor(F.col("n_") * fraction)).drop("n_")


def split(df: DataFrame, test: float, seed: int | str, *keys: str) -> DataFrame:
    """df with split: the first int(n * test) rows of a seeded shuffle are test, the others train."""
    rows = shuffled(df, seed, *keys, name="pos_")
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    return rows.join(F.broadcast(n)).withColumn("split", F.when(F.col("pos_") <= F.floor(F.col("n_") * test), "test").otherwise("train")).drop("pos_", "n_")


def _boundary(df: DataFrame, order: str, size: Column, budget: int, crossing: str) -> tuple[Column | None, Column | None, int]:
    """What is kept whole, what holds the crossing row, and the sizes before that. The order is cut into RANGES at
    its quantiles and sizes are summed by range; the range that crosses is cut again until it has few rows. Every
    round reads only the order and the sizes, and after the first only of the crossing range."""
    rows = df.select(F.col(order).alias("o_"), F.coalesce(size, F.lit(0)).alias("s_"))
    kept, edge, held, part = None, F.lit(True), 0, rows
    low = top = None
    while True:
        bounds = sorted(set(part.approxQuantile("o_", [i / RANGES for i in range(1, RANGES)], 0.005)))
        at = F.col("o_").cast("double")
        cell = F.when(at.isNull(), -1).otherwise(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < at)) if bounds else F.lit(0))
        cells = part.groupBy(cell.alias("cell_")).agg(F.sum("s_").alias("sum_"), F.max("o_").alias("top_"), F.count(F.lit(1)).alias("n_"))
        last = None
        for c in sorted(cells.collect(), key=lambda c: c["cell_"]):  # RANGES rows at most
            through = held + c["sum_"]
            if through > budget or (crossing == "lt" and through == budget):
                last = c
                break
            held = through
            low = c["top_"] if c["top_"] is not None else low
            kept = F.col(order).isNull() | (F.col(order) <= F.lit(low)) if low is not None else F.col(order).isNull()
        if last is None:
            return (F.lit(True), None, held) if part is rows else (kept, None, held)
        if last["top_"] is None:
            return None, F.col(order).isNull(), held
        edge = F.col(order) <= F.lit(last["top_"])
        if low is not None:
            edge = (F.col(order) > F.lit(low)) & edge
        elif kept is not None:
            edge = F.col(order).isNotNull() & edge
        if last["n_"] <= EDGE_ROWS or last["top_"] == top or last["top_"] == low:
            return kept, edge, held
        top = last["top_"]
        part = rows.filter((F.col("o_") <= F.lit(top)) & ((F.col("o_") > F.lit(low)) if low is not None else F.col("o_").isNotNull()))


def within_budget(df: DataFrame, order: str, size: Column, budget: int, crossing: str = "le") -> DataFrame:
    """Rows in a numeric order until the sizes before them pass the budget: the crossing row is the last one. "le"
    also takes the row that starts exactly at the budget, "lt" does not. Rows without an order come first.

    Two phases: sums by range find the boundary from the order and the sizes alone; then the rows before it are a
    filter on the order, which reaches the scan and skips what lies behind, and a window cuts the boundary's range.
    """
    kept, edge, held = _boundary(df, order, size, budget, crossing)
    if edge is None:
        return df.filter(kept) if kept is not None else df.limit(0)
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # one range
    cut = df.filter(edge).withColumn("prior_", F.lit(held) + F.coalesce(F.sum(size).over(w), F.lit(0)))
    cut = cut.filter(F.col("prior_") <= budget if crossing == "le" else F.col("prior_") < budget).drop("prior_")
    return cut if kept is None else df.filter(kept).unionByName(cut)


def mixture(tasks: list[tuple[DataFrame, int]], seed: int | str, key: str) -> DataFrame:
    """Bag union of (frame, times) with task_idx, copy and a seeded global place; a task listed more often is upsampled."""
    parts = [df.withColumns({"task_idx": F.lit(i), "copy": F.explode(F.sequence(F.lit(1), F.lit(times)))}) for i, (df, times) in enumerate(tasks) if times > 0]
    return shuffled(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), seed, "task_idx", "copy", key)


def sequence(tasks: list[DataFrame], order: str) -> DataFrame:
    """Ordered concatenation with task_idx and a global 0-based pos."""
    out, base = [], 0
    for i, df in enumerate(tasks):
        out.append(running_sum(df, order, F.lit(1), "pos", inclusive=False).withColumn("pos", F.col("pos") + base).withColumn("task_idx", F.lit(i)))
        base += df.count()
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def interleave(first: DataFrame, second: DataFrame, ratio: float, seed: int | str, ordinal: str = "ordinal") -> DataFrame:
    """Batches of two sources (numbered from 0 without gaps) in one order: at each step the hash of the step
    picks the second with the given probability, until the picked source is exhausted.

    The k-th pick of a source is a lookup of that source's k-th batch, so this is a join, not a loop.
    """
    spark = first.sparkSession
    n = first.count() + second.count()
    steps = spark.range(n).select(F.col("id").alias("step"), (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) < ratio).cast("int").alias("from_second"))
    steps = running_sum(steps, "step", F.col("from_second"), "seconds", inclusive=False)
    steps = steps.withColumn("at_", F.when(F.col("from_second") == 1, F.col("seconds")).otherwise(F.col("step") - F.col("seconds")))
    sources = first.withColumn("source_", F.lit(0)).unionByName(second.withColumn("source_", F.lit(1)), allowMissingColumns=True)
    out = steps.join(sources, (F.col("from_second") == F.col("source_")) & (F.col("at_") == F.col(ordinal)), "left")
    end = out.filter(F.col("source_").isNull()).agg(F.min("step").alias("end_"))
    return out.join(F.broadcast(end)).filter(F.col("end_").isNull() | (F.col("step") < F.col("end_"))).drop("seconds", "at_", "source_", "end_")


def rank_stride(df: DataFrame, pos: str, world: int) -> DataFrame:
    """df with the rank that reads each row."""
    return df.withColumn("rank", F.pmod(F.col(pos), F.lit(world)).cast("int"))


def hash_sample(df: DataFrame, group: str, key: str, k: int, seed: int | str) -> DataFrame:
    """k rows of each group without replacement, by hash rank; the limit is applied before the exchange."""
    w = Window.partitionBy(group).orderBy(shuffle_key(seed, group, key), key)
    return df.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)


def _successors(blocks: DataFrame, shard_size: int) -> DataFrame:
    """a, b of (block_, size_, through_): a shard that starts at block a closes before block b. There is no row for a
    start whose shard stays open.

    That is the first block whose running sum reaches a's by shard_size. Sums and goals are sorted together within
    ranges of shard_size, from the top, so that the nearest sum above a goal has been seen; a goal that no sum of its
    range reaches takes the first of the next range that has any.
    """
    sums = blocks.select(F.floor(F.col("through_") / shard_size).alias("range_"), F.col("through_").alias("at_"), F.col("block_").alias("sum_of_"), F.lit(None).cast("bigint").alias("goal_of_"))
    goal = F.col("through_") - F.col("size_") + shard_size
    goals = blocks.select(F.floor(goal / shard_size).alias("range_"), goal.alias("at_"), F.lit(None).cast("bigint").alias("sum_of_"), F.col("block_").alias("goal_of_"))
    # at equal places the sum comes first: it reaches the goal
    w = Window.partitionBy("range_").orderBy(F.desc("at_"), F.col("goal_of_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sums.unionByName(goals).withColumn("first_", F.min("sum_of_").over(w)).filter("goal_of_ is not null")
    ranges = sums.select("range_", "sum_of_").unionByName(goals.select("range_", F.lit(None).cast("bigint").alias("sum_of_"))).groupBy("range_").agg(F.min("sum_of_").alias("least_"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("range_")).rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    ranges = ranges.select(F.col("range_").alias("r_"), F.min("least_").over(above).alias("next_"))
    out = met.join(ranges, F.col("range_") == F.col("r_"))
    return out.select(F.col("goal_of_").alias("a"), (F.coalesce("first_", "next_") + 1).alias("b")).filter("b is not null")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of the rows of each chunk, without the chunk."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, part in groupby(rows, lambda r: r[0]):
        yield list(map(list, zip(*part, strict=True)))[1:]


def _exits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of each start a of a chunk, the first place b behind the chunk that jumps lead to; none where they end in it."""
    for a, b in _chunks(batches):
        end, out = (a[0] // size + 1) * size, {}
        for start, to in zip(reversed(a), reversed(b), strict=True):
            out[start] = to if to >= end else out.get(to)
        some = [(x, y) for x, y in out.items() if y is not None]
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in some], "b": [y for _, y in some]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _walks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The starts of a chunk that its entry leads to."""
    for a, b, entry in _chunks(batches):
        jumps, at = dict(zip(a, b, strict=True)), entry[0]
        end, out = (at // size + 1) * size, []
        while (at := jumps.get(at)) is not None and at < end:
            out.append(at)
        yield pa.RecordBatch.from_pydict({"start_": out}, schema=pa.schema([("start_", pa.int64())]))


def shard_cuts(df: DataFrame, order: str, size: Column, shard_size: int, block_rows: int = 1024) -> DataFrame:
    """df with shard: a shard closes at the end of a block of block_rows rows once its sizes reach shard_size.

    The rule resets at each close. Where a shard that starts at a block would close does not depend on where shards
    start, so it is looked up for all blocks at once. Within a chunk of CHUNK blocks these jumps are followed from the
    last block to the first, which tells for each where a walk from it leaves the chunk; the places where the walk from
    block 0 enters the chunks are found by doubling over these exits, in log2(chunks) joins; and from its entry each
    chunk's own shards are walked. No task sees the blocks of more than one chunk.
    """
    from lodestone.sources.shared import Tables

    if shard_size < 1:
        raise ValueError("a shard holds at least 1")
    table, chunk_size = Tables(df.sparkSession), CHUNK
    rows = running_sum(df, order, F.lit(1), "row_", inclusive=False).withColumn("block_", F.floor(F.col("row_") / block_rows).cast("bigint"))
    blocks = rows.groupBy("block_").agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("size_"))
    dense = lambda df, value, name: _running(df, F.floor(F.col("block_") / chunk_size), ["block_"], value, name, True)
    blocks = table(dense(blocks, F.col("size_"), "through_"), "blocks")
    n = blocks.count()
    chunk = lambda c: F.floor(F.col(c) / chunk_size)
    jumps = table(_successors(blocks, shard_size).filter(F.col("b") < n).withColumn("chunk_", chunk("a")), "jumps")
    by_chunk = lambda df: df.repartition("chunk_").sortWithinPartitions("chunk_", "a")
    entries, reached = df.sparkSession.createDataFrame([(0,)], "start_ bigint"), 1
    if n > chunk_size:
        exits = table(by_chunk(jumps).select("chunk_", "a", "b").mapInArrow(lambda b: _exits(b, chunk_size), "a bigint, b bigint"), "exits")
    while reached <= (n - 1) // chunk_size:
        more = entries.join(exits, F.col("start_") == F.col("a")).select(F.col("b").alias("start_"))
        entries = table(entries.unionByName(more), "entries")
        found = entries.count()
        if found < 2 * reached:  # some exit led nowhere: the last chunk is found
            break
        reached = found
        further = exits.select(F.col("a").alias("a_"), F.col("b").alias("b_")).join(exits, F.col("b_") == F.col("a")).select(F.col("a_").alias("a"), "b")
        exits = table(further, "exits")
    met = jumps.join(entries.withColumn("of_", chunk("start_")), F.col("chunk_") == F.col("of_")).select("chunk_", "a", "b", "start_")
    starts = entries.unionByName(by_chunk(met).mapInArrow(lambda b: _walks(b, chunk_size), "start_ bigint"))
    opens = blocks.select("block_").join(starts, F.col("block_") == F.col("start_"), "left").select("block_", F.col("start_").isNotNull().cast("bigint").alias("opens_"))
    cuts = dense(opens, F.col("opens_"), "shard_").select(F.col("block_").alias("at_"), (F.col("shard_") - 1).cast("int").alias("shard"))
    return rows.join(cuts, F.col("block_") == F.col("at_")).drop("row_", "block_", "at_")
