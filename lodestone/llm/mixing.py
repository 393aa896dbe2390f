"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a keyed random order and in up to `repeats` rounds, gets a virtual finish
time: the words its source has sent once it is sent, divided by the source's target. Sending by finish
time until the total budget is spent gives each source its target, as far as whole documents allow.

Sizes are counts of runs of characters other than space and \\t..\\r (null text: 0). Sources are ordered
by code point, null last, and weigh 5, 2, 1, repeating. Targets share the budget by weight, stop at
`repeats` times a source's size, and pass the excess on by weight. Ties fall by source, key, round.
Rows with null or repeated ids are documents of their own, told apart in the order by their texts; empty
texts take nothing; an empty table gives no rows. Result columns are named here, and with them those of `keep`;
others of the input are not read.

No source is sorted in one task: a source's order is cut into ranges of the key, the words of each range
are summed first, and running sums within a range start at what lies before it. The final order is cut
the same way into ranges of finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import table

#: Rows that one range of an order holds, about.
RANGE_ROWS = 20_000


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3) -> DataFrame:
    """source, source_size, target of each source of (source, size): water-filling in closed form.

    Sources are filled in the order of cap / weight: those before the level are at their caps, the rest
    share what is left by weight. The windows run over one row for each source, not for each document.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.select("source", "source_size", w.alias("weight"), F.row_number().over(by_name).alias("source_rank"), (F.col("source_size") * repeats).alias("cap"), F.sum("source_size").over(one).alias("budget"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = one.orderBy("ratio", "source_rank")
    s = s.withColumns({"spent": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("budget") - F.col("spent")) / F.col("left"))
    # the first source in this order that its level leaves below its cap sets the level for all after it
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("final", level)
    target = F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final"))
    return s.select("source", "source_size", "source_rank", target.alias("target"), "budget")


def _before(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Running sum of the rows before, over a small table of ranges."""
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[float, ...] = (5.0, 2.0, 1.0), repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, rounds of every document (see the module), and its columns `keep`,
    which are small and can be sorted; they settle the order of rows that have the same id and text."""
    own = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))
    sizes = table(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), key.alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep]), "sizes")
    n = sizes.count()
    ranges = max(64, n // RANGE_ROWS)
    cut = lambda of: F.floor(F.conv(F.substring(of, 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int")
    sizes = sizes.withColumn("range", cut("key"))
    same = lambda a, b, *on: a.join(b, [a[c].eqNullSafe(b[c + "_"]) for c in on]).drop(*[c + "_" for c in on])
    per = _before(sizes.groupBy("source", "range").agg(F.sum("size").alias("sum")), ["source"], "range", "sum")
    src = targets(sizes, weights, repeats)
    per = same(per, src.withColumnRenamed("source", "source_"), "source").select(F.col("source").alias("source_"), F.col("range").alias("range_"), "before", "source_size", "source_rank", "target", "budget")
    rows = same(sizes, per, "source", "range")
    order = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *[f"keep_{c}" for c in keep]).rowsBetween(Window.unboundedPreceding, 0)
    rows = table(rows.withColumn("sent", F.col("before") + F.sum("size").over(order)).drop("before", "range"), "queue")
    # every round of every document with its finish time
    sends = rows.filter("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    sends = sends.withColumn("finish", (F.col("round") * F.col("source_size") + F.col("sent")) / F.col("target"))
    # ranges of finish time, in its order: even ones to 2, where targets are met, and ever wider ones beyond
    slots = max(64, repeats * n // RANGE_ROWS)
    f = F.col("finish")
    sends = sends.withColumn("slot", F.when(f < 2, F.floor(f * slots)).otherwise(2 * slots + F.floor(F.log2(f) * (slots // 8))))
    sums = _before(sends.groupBy("slot").agg(F.sum("size").alias("sum")), [], "slot", "sum").select("slot", "before", (F.col("before") + F.col("sum")).alias("through"))
    sends = sends.join(sums, "slot").filter("before <= budget")
    order = Window.partitionBy("slot").orderBy("finish", "source_rank", "key", "round", "doc_id", "sent").rowsBetween(Window.unboundedPreceding, 0)
    taken = sends.withColumn("total", F.col("before") + F.sum("size").over(order)).filter("total <= budget")
    taken = taken.groupBy(*[F.col(c).alias(c + "_") for c in ("source", "key", "doc_id", "sent")]).agg(F.count(F.lit(1)).alias("rounds"))
    on = [rows[c].eqNullSafe(taken[c + "_"]) for c in ("source", "key", "doc_id", "sent")]
    out = rows.join(taken, on, "left").withColumn("rounds", F.when(F.col("size") > 0, F.coalesce("rounds", F.lit(0))).otherwise(F.lit(0)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds")).alias("taken"), F.col("rounds").cast("int").alias("rounds"), *[F.col(f"keep_{c}").alias(c) for c in keep])


#: The same for DuckDB, without the ranges.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((source_rank - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS cap, sum(source_size) OVER () AS budget FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY ratio, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT (SELECT level FROM l WHERE ratio > level ORDER BY ratio, source_rank LIMIT 1) AS final),
t AS (SELECT source, source_size, source_rank, budget, CASE WHEN final IS NULL OR ratio <= final THEN cap::DOUBLE ELSE weight * final END AS target FROM l, f),
q AS (SELECT d.doc_id, d.size, d.key, t.*, sum(size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, g.round, ((g.round * source_size + sent) / target)::DOUBLE AS finish FROM q, (VALUES (0), (1), (2)) g(round) WHERE size > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, source_rank, key, round, doc_id, sent ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT source_rank, key, sent, doc_id, count(*) AS rounds FROM c WHERE total <= budget GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(k.rounds, 0))::BIGINT AS taken, coalesce(k.rounds, 0)::INT AS rounds
FROM q LEFT JOIN k ON q.source_rank = k.source_rank AND q.key = k.key AND q.sent = k.sent AND q.doc_id IS NOT DISTINCT FROM k.doc_id AND q.size > 0
"""
