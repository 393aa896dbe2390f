"""Registered queries of joins, masks, schedules, reports and decoding that take their inputs from whole tables."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import metrics as M
from lodestone.operators import conversations as C
from lodestone.operators import evals as E
from lodestone.operators import logs as L
from lodestone.operators import packing as P
from lodestone.operators import scenarios as Y
from lodestone.operators import tokenizer as K
from lodestone.plans.queries import query, read, tokenizer
from lodestone.sources import readers as I
from lodestone.sources import sinks as O


@query("""
WITH i AS (SELECT item_id AS pos, text, min(item_id) OVER (PARTITION BY text, item_id % 2) AS first, count(*) OVER () AS n FROM benchmark),
h AS (SELECT pos, first, n, [('0x' || substr(md5('1234:' || first || ':' || k), 1, 8))::BIGINT FOR k IN range(1, 4)] AS h FROM i),
a AS (SELECT *, list_reduce([h[1] % (n - 1), first], lambda p, x: CASE WHEN p >= x THEN p + 1 ELSE p END) AS a FROM h),
b AS (SELECT *, list_reduce(list_prepend(h[2] % (n - 2), list_sort([first, a])), lambda p, x: CASE WHEN p >= x THEN p + 1 ELSE p END) AS b FROM a),
c AS (SELECT *, list_reduce(list_prepend(h[3] % (n - 3), list_sort([first, a, b])), lambda p, x: CASE WHEN p >= x THEN p + 1 ELSE p END) AS c FROM b)
SELECT pos, first AS index, [a, b, c] AS shots FROM c""")
def joi6_few_shot(spark, d):
    """Three others for each item, drawn without replacement."""
    items = read(spark, d, "benchmark").select(F.lit("t").alias("task"), F.col("item_id").alias("pos"), "text", F.pmod("item_id", F.lit(2)).alias("gold"))
    return E.few_shot(items, 3).select("pos", "index", F.transform("shots", lambda s: s["pos"]).alias("shots"))


@query("""
WITH c AS (SELECT conv_id AS id, max_by(text, turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id),
a AS (SELECT id, said, min(attempt) AS attempt FROM c, range(4) t(attempt) WHERE (id + attempt) % 3 = 0 AND id % 5 <> 0 GROUP BY ALL)
SELECT id, CASE WHEN said IS NOT NULL THEN said || ' v' || attempt END AS chosen, said AS rejected FROM a""")
def joi2_preference_pairs(spark, d):
    """Restyles of each conversation in four attempts, of which some pass: the first that does against the original."""
    m = F.col("messages")
    rows = C.assemble(read(spark, d, "conversations")).withColumnRenamed("conv_id", "id").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    words = F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: F.concat(x["content"], F.lit(" v"), F.col("attempt").cast("string")))
    tried = rows.select("id", "attempt", "messages", C.replace_answers(m, words).alias("styled"), (((F.col("id") + F.col("attempt")) % 3 == 0) & (F.col("id") % 5 != 0)).alias("passed"))
    return Y.preference_pairs(tried).select("id", C.last_of(F.col("chosen"), "assistant").alias("chosen"), C.last_of(F.col("rejected"), "assistant").alias("rejected"))


@query("SELECT doc_id, doc_id % 10 = 9 AS failed, CASE WHEN doc_id % 10 <> 9 THEN md5(text) END AS h FROM documents")
def fil3_decoded_blobs(spark, d):
    """Texts packed by gzip in three encodings, one in ten cut off: each row is decoded by its own encoding."""
    name = F.element_at(F.array(F.lit("utf-8"), F.lit("utf-16"), F.lit("utf-32-le")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    docs = read(spark, d, "documents").select("doc_id", name.alias("encoding"), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, texts = (b.column(i).to_pylist() for i in range(3))
            packed = [None if t is None else gzip.compress(t.encode(n), 1) for n, t in zip(names, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p[: len(p) // 2] if i % 10 == 9 and p else p for i, p in zip(ids, packed, strict=True)], pa.binary())], names=["doc_id", "encoding", "content"])

    rows = docs.mapInArrow(pack, "doc_id bigint, encoding string, content binary")
    return I.decoded_blobs(rows).select("doc_id", "failed", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS back FROM documents")
def snk6_tokenizer_tables(spark, d):
    """A tokenizer written as its tables and read again gives every text back."""
    path = O.scratch(spark, "tokenizer")
    O.write_tokenizer(tokenizer(spark, d), spark, path)
    t = O.read_tokenizer(spark, path)
    rows = K.decoded(K.encoded(read(spark, d, "documents").select("doc_id", "text"), t, prepend="<|bos|>").withColumn("ids", F.expr("slice(ids, 2, size(ids))")), t)
    return rows.select("doc_id", F.md5(F.coalesce("decoded", F.lit("")).cast("binary")).alias("back"))


@query("""
WITH v AS (SELECT l_orderkey AS k, list(l_suppkey::INT ORDER BY l_linenumber, l_suppkey) AS l FROM lineitem GROUP BY ALL)
SELECT k, [0 FOR i IN range(len(l) - 1)] || [1, 1] AS choice, [0, 0] || [1 FOR i IN range(len(l) - 1)] AS suffix,
       [0 FOR i IN range(len(l))] || [1, 1] AS continuation FROM v""")
def arr2_masks(spark, d):
    """Sequences that differ at their ends, at their starts, and by what one has more."""
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey")))["l_suppkey"].cast("array<int>")
    v = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(each.alias("l"))
    head, tail, one = F.expr("slice(l, 1, size(l) - 1)"), F.expr("slice(l, 2, size(l) - 1)"), lambda *x: F.array(*[F.lit(i) for i in x])
    ends = F.array(F.concat(head, one(-1, 5)), F.concat(head, one(-2, 5)))
    starts = F.array(F.concat(one(5, -1), tail), F.concat(one(5, -2), tail))
    v = v.select("k", "l", ends.alias("ends"), starts.alias("starts"))
    v = v.withColumns({"prefix": A.common_length(F.col("ends")), "suffix_": A.common_length(F.col("starts"), from_right=True)})
    return v.select("k", A.choice_mask(F.col("ends")[0], F.col("prefix")).alias("choice"), A.suffix_mask(F.col("starts")[0], F.col("suffix_")).alias("suffix"), A.continuation_mask(F.col("l"), F.concat("l", one(7, 8))).alias("continuation"))


@query(f"SELECT doc_id, list_min([b FOR b IN [{', '.join(map(str, A.BUCKETS))}] IF b >= n_chars])::INT AS bucket FROM documents")
def arr3_buckets(spark, d):
    return read(spark, d, "documents").select("doc_id", A.bucket(F.col("n_chars")).alias("bucket"))


@query(f"""
WITH s AS (SELECT l_orderkey AS k, least(greatest(1, sum(l_quantity)::INT * 4), {max(A.BUCKETS)}) AS n FROM lineitem GROUP BY l_orderkey),
r AS (SELECT k, n, (row_number() OVER (ORDER BY k) - 1) // 4 AS b FROM s),
m AS (SELECT *, max(n) OVER (PARTITION BY b) AS longest FROM r)
SELECT k, b AS batch_id, list_min([x FOR x IN [{', '.join(map(str, A.BUCKETS))}] IF x >= longest])::INT AS length, n::BIGINT AS used FROM m""")
def pck5_collated(spark, d):
    """Sequences of each order's quantity, four to a minibatch, padded to the bucket of the longest."""
    from lodestone.operators.sampling import running_sum

    n = F.least(F.greatest(F.lit(1), F.sum("l_quantity").cast("int") * 4), F.lit(max(A.BUCKETS)))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(n.alias("n"))
    rows = running_sum(rows, "k", F.lit(1), "seq", inclusive=False).select("k", "seq", F.array_repeat(F.lit(7), F.col("n")).alias("ids"), F.array_repeat(F.lit(1), F.col("n")).alias("mask"))
    got = E.collated(rows, 4, -1)
    return got.select("k", "batch_id", F.size("ids").alias("length"), F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("used"))


@query("""
WITH n AS (SELECT count(*) AS n FROM events), s AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS step FROM events)
SELECT step, round(CASE WHEN step < round(0.1 * n) THEN (step + 1) / round(0.1 * n) WHEN step <= n - round(0.4 * n) THEN 1.0
  ELSE (n - step) / round(0.4 * n) + (1 - (n - step) / round(0.4 * n)) * 0.1 END::DOUBLE, 12) AS lr,
  round((CASE WHEN step / n < 0.7 THEN 1.0 ELSE 1 - (step / n - 0.7) / 0.7 END)::DOUBLE, 12) AS late, round((1 - step / n)::DOUBLE, 12) AS linear FROM s, n""")
def mth1_schedule_of_events(spark, d):
    """The three schedules over a run that has a step for each event."""
    from lodestone.operators.sampling import running_sum

    steps = running_sum(read(spark, d, "events").select("event_id"), "event_id", F.lit(1), "step", inclusive=False)
    n, s = steps.count(), F.col("step")
    return steps.select("step", F.round(M.learning_rate(s, n, 0.1, 0.4, 0.1), 12).alias("lr"), F.round(M.late_decay(s, n), 12).alias("late"), F.round(M.linear_decay(s, n), 12).alias("linear"))


@query("SELECT p_partkey, 6 * (p_partkey * 1000 - p_size * 64) + 12 * p_size * 4 * 64 * 1024 AS flops, ceil(8 * p_partkey * 1000 / (p_size * 512.0))::BIGINT + 1 AS steps FROM part")
def mth3_sizes_of_parts(spark, d):
    """Operations for a token, and steps, of a model for each part: its key for parameters, its size for layers."""
    p, size = F.col("p_partkey") * 1000, F.col("p_size").cast("bigint")
    return read(spark, d, "part").select("p_partkey", M.flops_per_token(p, size * 64, size, 4, 64, 1024).alias("flops"), M.training_steps(8, p, size * 512).alias("steps"))


@query("""
WITH t AS (SELECT list(r_name) AS l FROM region), n AS (SELECT list(n_name) AS l FROM nation)
SELECT item_id AS batch, list_transform(list_sort(list_transform(t.l, lambda x: md5('st:' || item_id || ':' || x) || x))[1:3], lambda x: x[33:]) AS tasks,
  list_transform(list_sort(list_transform(n.l, lambda x: md5('sd:' || item_id || ':' || x) || x))[1:3], lambda x: x[33:]) AS domains FROM benchmark, t, n""")
def udf5_batches_of_items(spark, d):
    """A batch for each item: three of the regions' names for tasks, three of the nations' for domains."""
    names = lambda table, c: [r[0] for r in read(spark, d, table).select(c).orderBy(c).collect()]  # noqa: E731  fixed tables of 5 and 25 rows
    of = read(spark, d, "benchmark").select(F.col("item_id").alias("batch"))
    return Y.batches(spark, of, names("region", "r_name"), names("nation", "n_name"), ["none"], "s", 3).select("batch", "tasks", "domains")


@query("""
SELECT n_name AS task, CASE WHEN n_nationkey % 2 = 0 THEN 'multiple_choice' ELSE 'language_modeling' END AS task_type, 'n/' || n_nationkey || '.jsonl' AS dataset_uri,
  n_nationkey AS num_fewshot, CASE WHEN n_nationkey % 3 = 0 THEN chr(10) || 'A: ' ELSE ' ' END AS delimiter, n_regionkey * 12.5::DOUBLE AS baseline FROM nation""")
def src11_bundle_of_nations(spark, d):
    """A benchmark's YAML with a task for each nation, and its CSV of baselines."""
    nation = read(spark, d, "nation")
    lines = ["icl_tasks:"]
    for r in nation.orderBy("n_nationkey").collect():  # a configuration file
        k = r["n_nationkey"]
        shots = [f"  num_fewshot: [{k}]"] if k % 4 else ["  num_fewshot:", f"  - {k}"]
        lines += [f"- label: {r['n_name']}", f"  icl_task_type: {'language_modeling' if k % 2 else 'multiple_choice'}  # of {k}", f"  dataset_uri: n/{k}.jsonl", *shots, *(["  continuation_delimiter: \"\\nA: \""] if k % 3 == 0 else [])]
    path = O.scratch(spark, "baselines")
    nation.select(F.col("n_name").alias("Eval Task"), (F.col("n_regionkey") * 12.5).alias("Random baseline")).write.option("header", True).csv(path)
    return E.with_baseline(I.bundle_tasks(spark, "\n".join(lines)).withColumnRenamed("label", "task"), I.baselines(spark, path))


@query("""
WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT item_id AS pos, e AS epoch, e * n + item_id AS place, n FROM benchmark, n, range(3) t(e)),
m AS (SELECT *, place // 6 AS mini, place % 6 AS k FROM r)
SELECT pos, epoch::INT AS epoch, (mini // 2)::BIGINT AS step, (mini % 2)::BIGINT AS minibatch_id, (k // 3)::BIGINT AS device, side, (k % 3 + CASE WHEN side = 'rejected' THEN 3 ELSE 0 END)::BIGINT AS slot
FROM m, (VALUES ('chosen'), ('rejected')) s(side) WHERE mini // 2 < 3 * n // 6 // 2""")
def pck3_epochs(spark, d):
    """Minibatches that an epoch leaves unfilled go on in the next."""
    rows = P.preference_batches(read(spark, d, "benchmark").select(F.col("item_id").alias("pos")), batch=6, minibatch=3, devices=2, epochs=3)
    return rows.select("pos", "epoch", "step", F.col("minibatch_id").cast("bigint").alias("minibatch_id"), "device", "side", F.col("slot").cast("bigint").alias("slot"))


@query("""
WITH e AS (SELECT user_id % 4 AS log, event_id AS line_no, event_id % 6 AS c FROM events),
f AS (SELECT *, ['base', 'sft', 'dpo', 'other'][log + 1] AS phase FROM e WHERE log < 3),
s AS (SELECT *, sum((c = 0)::INT) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS b FROM f),
h AS (SELECT log, phase, 0 AS part, 0 AS nth, '' AS sub, '## ' || phase AS line FROM f GROUP BY ALL),
t AS (SELECT log, phase, 1, 0, '', printf('Training took %.2f minutes.', min(line_no)::DOUBLE) FROM f WHERE c = 5 GROUP BY ALL),
v AS (SELECT log, phase, series, nth, name, arg_min(val, line_no) AS a, arg_max(val, line_no) AS z
      FROM (SELECT f.*, n.series, n.name, n.nth, CASE n.name WHEN 'loss' THEN line_no + 0.5 WHEN 'tkps' THEN line_no WHEN 'mfu' THEN 1.5 WHEN 'CORE' THEN 0.125 ELSE 2.5 END AS val
            FROM f JOIN (VALUES ('base', 0, 'train', 'loss', 1), ('base', 0, 'train', 'tkps', 1), ('base', 0, 'train', 'mfu', 1), ('base', 1, 'memory', 'memory (GB)', 4), ('base', 2, 'core', 'CORE', 3),
                                ('sft', 0, 'train', 'loss', 1), ('sft', 0, 'train', 'tkps', 1), ('sft', 0, 'train', 'mfu', 1), ('sft', 1, 'memory', 'memory (GB)', 3),
                                ('dpo', 0, 'train', 'loss', 3), ('dpo', 0, 'train', 'tkps', 3), ('dpo', 0, 'train', 'mfu', 3), ('dpo', 1, 'memory', 'memory (GB)', 4)) n(phase, c, series, name, nth) USING (phase, c)) GROUP BY ALL),
x AS (SELECT log, phase, 3, nth, name, '| ' || series || ' | ' || name || ' | ' || CASE WHEN name = 'tkps' THEN a::BIGINT::VARCHAR ELSE printf('%.4f', a) END || ' | ' || CASE WHEN name = 'tkps' THEN z::BIGINT::VARCHAR ELSE printf('%.4f', z) END || ' |' FROM v),
l AS (SELECT *, max(b) FILTER (c = 3) OVER (PARTITION BY log) AS top FROM s),
q AS (SELECT *, sum((c IN (0, 1, 3, 5))::INT) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS grp FROM l),
g AS (SELECT log, phase, 4, row_number() OVER (PARTITION BY log ORDER BY min(line_no)), '', string_agg(CASE c WHEN 3 THEN '> <|bos|>made ' || line_no WHEN 2 THEN '>   CORE metric: 0.125' ELSE '> and more' END, chr(10) ORDER BY line_no)
      FROM q WHERE c IN (2, 3, 4) AND b = top GROUP BY log, phase, grp HAVING bool_or(c = 3)),
u AS (SELECT * FROM h UNION ALL SELECT * FROM t UNION ALL SELECT log, phase, 2, 0, '', '| series | name | first | last |' FROM h UNION ALL SELECT log, phase, 2, 1, '', '|-|-|-|-|' FROM h UNION ALL SELECT * FROM x UNION ALL SELECT * FROM g)
SELECT log, phase, row_number() OVER (PARTITION BY log ORDER BY part, nth, sub)::INT AS place, line FROM u""")
def snk7_phase_report(spark, d):
    """Logs of three phases, and of one that is none, as reports."""
    k = F.col("event_id").cast("string")
    kinds = F.array(F.concat(F.lit("Step: "), k, F.lit("/9999 | Loss: "), k, F.lit(".5 | lr tkps: "), k, F.lit(" | mfu: 1.5")), F.lit("\tPeak bytes reserved/limit: 2.5/9.0GB"), F.lit("  CORE metric: 0.125"), F.concat(F.lit("\t<|bos|>made "), k), F.lit("and more"), F.concat(F.lit("Total training time: "), k, F.lit(".00min")))
    phase = F.element_at(F.array(F.lit("base"), F.lit("sft"), F.lit("dpo"), F.lit("other")), (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    lines = read(spark, d, "events").select(F.pmod("user_id", F.lit(4)).alias("log"), phase.alias("phase"), F.col("event_id").alias("line_no"), F.element_at(kinds, (F.pmod("event_id", F.lit(6)) + 1).cast("int")).alias("line"))
    return L.phase_report(lines)
