"""Registered queries over the driver's tables, one or more for each operator family, and their DuckDB SQL.

documents stand for a corpus, conversations for chat turns, benchmark for evaluation items, lineitem and
orders for per-token and per-choice model outputs (loss, predicted, valid), events for training logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import metrics as M
from lodestone.functions import text as S
from lodestone.operators import conversations as C
from lodestone.operators import evals as E
from lodestone.operators import logs as L
from lodestone.operators import packing as P
from lodestone.operators import rollouts as R
from lodestone.operators import sampling as Z
from lodestone.operators import tokenizer as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- projections, filters, text functions


@query("SELECT doc_id, substr(text, 1, 200) AS head, length(substr(text, 1, 200))::INT AS n FROM documents")
def prj3_crop(spark, d):
    head = F.substring("text", 1, 200)
    return read(spark, d, "documents").select("doc_id", head.alias("head"), F.length(head).alias("n"))


@query(r"""
SELECT doc_id, coalesce(round(length(regexp_replace(p, '[^\x00-\x7F]', '', 'g')) / nullif(length(p), 0), 12), 1.0) AS share,
       coalesce(length(regexp_replace(p, '[^\x00-\x7F]', '', 'g')) / nullif(length(p), 0), 1.0) >= 0.85 AS english
FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS p FROM documents)""")
def fil5_is_english(spark, d):
    return read(spark, d, "documents").select("doc_id", F.round(S.ascii_share(F.col("text")), 12).alias("share"), S.is_english(F.col("text")).alias("english"))


@query(r"""
SELECT doc_id, md5(array_to_string([lpad(i::VARCHAR, greatest(5, length(i::VARCHAR))::INT, ' ') || '→' || l[i] FOR i IN range(1, len(l) + 1)], chr(10))) AS numbered
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def str1_line_numbers(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(S.line_numbers(F.col("text")).cast("binary")).alias("numbered"))


@query("SELECT doc_id, ((length(text) - length(replace(text, 'th', ''))) / 2)::BIGINT AS n FROM documents")
def str14_substring_count(spark, d):
    return read(spark, d, "documents").select("doc_id", S.count_substring(F.col("text"), "th").alias("n"))


@query("SELECT doc_id, strlen(text)::INT AS n_bytes, length(text)::INT AS n_chars FROM documents")
def str22_utf8_bytes(spark, d):
    return read(spark, d, "documents").select("doc_id", S.utf8_bytes(F.col("text")).alias("n_bytes"), F.length("text").alias("n_chars"))


@query(r"""
SELECT page_id, len(blocks)::INT AS n_blocks, blocks[1] AS first FROM (
  SELECT page_id, [x FOR x IN regexp_extract_all(html, '<li><a href="([^"]*)"', 1) IF x <> ''] AS blocks FROM pages)""")
def str6_extract_all(spark, d):
    blocks = F.filter(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1)), lambda x: x != "")
    return read(spark, d, "pages").select("page_id", F.size(blocks).alias("n_blocks"), F.get(blocks, F.lit(0)).alias("first"))


@query("""
SELECT item_id, 'Multiple Choice question: ' || text || chr(10) || '- yes=A' || chr(10) || '- no=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM benchmark""")
def str17_render_choices(spark, d):
    letters, choices = F.array(F.lit("A"), F.lit("B")), F.array(F.lit("yes"), F.lit("no"))
    return read(spark, d, "benchmark").select("item_id", S.render_choices(F.col("text"), letters, choices).alias("prompt"))


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_answers FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant' AND coalesce(text, '') <> '')")
def fil1_has_answer(spark, d):
    c = C.assemble(read(spark, d, "conversations")).filter(C.has_answer(F.col("messages")))
    return c.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), F.size(C.assistant_places(F.col("messages"))).cast("bigint").alias("n_answers"))


# ---- conversations


@query("SELECT conv_id, max_by(text, turn) FILTER (role = 'user') AS last_user, max_by(text, turn) FILTER (role = 'assistant') AS last_answer FROM conversations GROUP BY conv_id")
def agg22_last_messages(spark, d):
    m = F.col("messages")
    return C.assemble(read(spark, d, "conversations")).select("conv_id", C.last_of(m, "user").alias("last_user"), C.last_of(m, "assistant").alias("last_answer"))


@query("""
WITH m AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, (len(l) - (l[1].role = 'system')::INT)::INT AS n,
       CASE WHEN l[1].role = 'system' THEN l[1].text || chr(10) || chr(10) || l[2].text ELSE l[1].text END AS first
FROM m WHERE l[1].role <> 'system' OR (len(l) > 1 AND l[2].role = 'user')""")
def prj6_merge_system(spark, d):
    m = F.col("messages")
    rows = C.assemble(read(spark, d, "conversations")).filter((m[0]["role"] != "system") | F.get(m, F.lit(1))["role"].eqNullSafe(F.lit("user")))
    merged = C.merge_system(m)
    return rows.select("conv_id", F.size(merged).alias("n"), merged[0]["content"].alias("first"))


@query("""
WITH m AS (SELECT *, lead(role) OVER w AS nxt, lag(role) OVER w AS prv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, nxt, prv, role = 'assistant' AND coalesce(prv, '') <> 'user' AS odd FROM m""")
def win3_neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("nxt"), F.lag("role").over(w).alias("prv"))
    return rows.withColumn("odd", (F.col("role") == "assistant") & (F.coalesce("prv", F.lit("")) != "user"))


@query("""
SELECT conv_id, CASE WHEN min_by(role, turn) = 'user' THEN 'valid' ELSE 'invalid' END AS outcome,
       (min_by(role, turn) <> 'user')::INT AS n_problems FROM conversations GROUP BY conv_id""")
def fil8_short_rules(spark, d):
    rows = R.outcomes(C.assemble(read(spark, d, "conversations")))
    return rows.select("conv_id", "outcome", F.size(C.short_problems(F.col("messages"))).alias("n_problems"))


@query(r"""
WITH m AS (SELECT conv_id, role, lower(coalesce(text, '')) AS t, turn, max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS final, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
p AS (SELECT conv_id, (i = 1 AND role <> 'user')::INT + (role = 'user' AND contains(t, 'scenario:'))::INT
   + (role = 'assistant' AND regexp_matches(t, 'anything\s+else|let\s+me\s+know\s+if'))::INT + (role = 'assistant' AND turn = final AND contains(t, '?'))::INT
   + (role = 'assistant' AND turn = final AND regexp_matches(t, 'would\s+you\s+like|let\s+me\s+know\s+if|anything\s+else'))::INT AS n, final FROM m)
SELECT conv_id, (sum(n) + bool_and(final IS NULL)::INT)::INT AS n_problems FROM p GROUP BY conv_id""")
def fil9_long_rules(spark, d):
    return C.assemble(read(spark, d, "conversations")).select("conv_id", F.size(C.long_problems(F.col("messages"))).alias("n_problems"))


@query("SELECT conv_id, count(*) FILTER (role = 'assistant')::INT AS n_problems FROM conversations GROUP BY conv_id")
def val3_restyle_unchanged(spark, d):
    m = F.col("messages")
    rows = C.assemble(read(spark, d, "conversations"))
    shout = C.replace_answers(m, F.transform(F.filter(m, lambda x: x["role"] == "assistant"), lambda x: F.upper(x["content"])))
    call = lambda x: F.when(x["role"] == "assistant", x.withField("tool_call", F.struct(F.lit("Read").alias("name"), F.array().cast(C.ARGS).alias("args")))).otherwise(x)
    # new words are no problem, new calls are
    return rows.select("conv_id", (F.size(C.restyle_problems(m, shout)) + F.size(C.restyle_problems(m, F.transform(m, call)))).alias("n_problems"))


# ---- joins


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def joi1_not_done(spark, d):
    done = read(spark, d, "labels").filter("quality = 1").select("doc_id")
    return R.not_done(read(spark, d, "documents").select("doc_id", "source"), done, ("doc_id",))


@query("SELECT o_orderpriority AS task, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(b) AS baseline FROM orders JOIN (VALUES ('1-URGENT', 25.0::DOUBLE), ('2-HIGH', 50.0), ('3-MEDIUM', 0.0)) t(p, b) ON o_orderpriority = p GROUP BY ALL")
def joi3_baselines(spark, d):
    b = spark.createDataFrame([("1-URGENT", 25.0), ("2-HIGH", 50.0), ("3-MEDIUM", 0.0)], "p string, baseline double")
    o = read(spark, d, "orders").join(F.broadcast(b), F.col("o_orderpriority") == F.col("p"))
    return o.groupBy(F.col("o_orderpriority").alias("task")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("baseline").alias("baseline"))


_BASELINES = [("1-URGENT", 25.0), ("2-HIGH", 50.0), ("3-MEDIUM", 0.0), ("4-NOT SPECIFIED", 10.0), ("5-LOW", 20.0)]


@query(f"SELECT o_orderpriority AS task, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(b) AS baseline FROM orders LEFT JOIN (VALUES {', '.join(f"('{p}', {b}::DOUBLE)" for p, b in _BASELINES)}) t(p, b) ON o_orderpriority = p GROUP BY ALL")
def joi3_all_baselines(spark, d):
    b = spark.createDataFrame(_BASELINES, "task string, baseline double")
    o = E.with_baseline(read(spark, d, "orders").withColumnRenamed("o_orderpriority", "task"), b)
    return o.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("baseline").alias("baseline"))


@query("SELECT n_name AS nation, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def joi2_lookup(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


# ---- aggregates and metrics


@query("SELECT source, lang, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars, sum(strlen(text))::BIGINT AS n_bytes, count(*) FILTER (text IS NULL) AS failures FROM documents GROUP BY source, lang")
def agg4_corpus_totals(spark, d):
    return read(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.octet_length("text")).alias("n_bytes"), F.count_if(F.col("text").isNull()).alias("failures"))


@query("SELECT event_type, n FROM (SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type) ORDER BY n DESC, first LIMIT 2")
def agg2_most_common(spark, d):
    g = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return g.orderBy(F.desc("n"), "first").limit(2).select("event_type", "n")


@query("SELECT l_returnflag AS split, round(sum(l_extendedprice) FILTER (l_linenumber > 1) / (ln(2) * sum(l_linenumber - 1) FILTER (l_linenumber > 1)), 6) AS bpb FROM lineitem GROUP BY l_returnflag")
def agg7_bits_per_byte(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("split"), F.col("l_extendedprice").alias("loss"), (F.col("l_linenumber") - 1).alias("n_bytes"))
    return rows.groupBy("split").agg(F.round(M.bits_per_byte(F.col("loss"), F.col("n_bytes")), 6).alias("bpb"))


@query("SELECT l_linestatus AS split, round(sum(l_extendedprice) FILTER (l_discount > 0.05) / (count(*) FILTER (l_discount > 0.05) + 1e-9), 6) AS loss FROM lineitem GROUP BY l_linestatus")
def agg8_masked_mean(spark, d):
    rows = read(spark, d, "lineitem")
    return rows.groupBy(F.col("l_linestatus").alias("split")).agg(F.round(M.masked_mean(F.col("l_extendedprice"), F.col("l_discount") > 0.05), 6).alias("loss"))


_CHOICES = """
c AS (SELECT l_orderkey AS item, l_linenumber AS choice, l_extendedprice / l_quantity AS mean FROM lineitem),
i AS (SELECT item, arg_min(choice, (mean, choice)) AS predicted FROM c GROUP BY item),
g AS (SELECT o_orderpriority AS task, item, predicted, predicted = 1 + item % 3 AS correct FROM i JOIN orders ON o_orderkey = item)"""


def _choices(spark, d) -> DataFrame:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_linenumber").alias("choice"), F.col("l_extendedprice").alias("loss"), F.col("l_quantity").alias("length"), (1 + F.col("l_orderkey") % 3).cast("int").alias("gold"))
    tasks = read(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderpriority").alias("task"))
    return E.choice_correct(lines, ["item"]).join(tasks, "item")


@query(f"WITH {_CHOICES.strip()} SELECT task, item, predicted, correct FROM g")
def agg11_choice_argmin(spark, d):
    return _choices(spark, d).select("task", "item", "predicted", "correct")


@query(f"WITH {_CHOICES.strip()} SELECT task, round(avg(correct::INT), 9) AS accuracy, round((avg(correct::INT) - 0.01 * 25) / (1 - 0.01 * 25), 9) AS centered FROM g GROUP BY task")
def agg13_task_scores(spark, d):
    items = _choices(spark, d)
    base = items.select("task").distinct().withColumn("baseline", F.lit(25.0))
    return E.task_scores(items, base).select("task", F.round("accuracy", 9).alias("accuracy"), F.round("centered", 9).alias("centered"))


@query("SELECT l_orderkey AS item, bool_and(l_returnflag = 'N' OR l_linenumber <= 2) AS correct FROM lineitem GROUP BY l_orderkey")
def agg12_all_match(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("predicted"), F.lit("N").alias("target"), (F.col("l_linenumber") > 2).alias("valid"))
    return E.lm_correct(rows, ["item"])


@query("""
SELECT o_orderpriority AS grp, round(avg((x - 5) * (x - 5)), 6) AS loss, round(avg(0.1 * x), 9) AS margin, round(avg((x > 0)::INT), 9) AS acc
FROM (SELECT o_orderpriority, (o_totalprice / 100000.0 - 1.0) - (o_custkey % 7 - 3.0) AS x FROM orders) GROUP BY o_orderpriority""")
def agg14_preference_metrics(spark, d):
    p = M.preference(F.col("o_totalprice") / 100000.0, F.col("o_custkey") % 7 * 1.0, F.lit(1.0), F.lit(3.0), 0.1)
    rows = read(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), *[c.alias(k) for k, c in p.items()])
    return rows.groupBy("grp").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("margin"), 9).alias("margin"), F.round(M.accuracy(F.col("correct")), 9).alias("acc"))


@query("SELECT l_orderkey AS seq, round(coalesce(sum(-l_discount) FILTER (l_linenumber <> 1), 0), 9) AS logp FROM lineitem GROUP BY l_orderkey")
def agg15_sequence_logp(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), (-F.col("l_discount")).alias("logp"), F.when(F.col("l_linenumber") == 1, A.IGNORE).otherwise(F.col("l_linenumber")).alias("target"))
    return E.sequence_logp(rows, ["seq"]).select("seq", F.round("logp", 9).alias("logp"))


@query("SELECT round(avg(v), 9) AS value FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY user_id)")
def agg18_mean_of_steps(spark, d):
    return E.mean_of_steps(read(spark, d, "events"), "user_id", "value").select(F.round("value", 9).alias("value"))


@query("SELECT event_type AS name, count(*) AS n, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM events GROUP BY event_type")
def agg16_series_summary(spark, d):
    rows = read(spark, d, "events").select(F.lit("log").alias("log"), F.lit("s").alias("series"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("line_no"), F.col("event_id").alias("step"))
    return L.summary(rows).select("name", "n", "first_value", "last_value")


@query("SELECT s::INT AS step, CASE WHEN s < 100 THEN (s + 1) / 100.0 WHEN s <= 600 THEN 1.0 ELSE round((1000 - s) / 400.0 + (1 - (1000 - s) / 400.0) * 0.1, 12) END::DOUBLE AS lr FROM range(1000) t(s)")
def mth1_learning_rate(spark, d):
    return spark.range(1000).select(F.col("id").cast("int").alias("step"), F.round(M.learning_rate(F.col("id"), 1000, 0.1, 0.4, 0.1), 12).alias("lr"))


# ---- windows, budgets, shuffles, sampling


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS prior FROM documents) WHERE prior <= 500000")
def win1_char_budget(spark, d):
    return Z.within_budget(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 500_000)


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS prior FROM documents) WHERE prior < 600000")
def win6_repository_budget(spark, d):
    return Z.within_budget(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), int(500_000 * 1.2), "lt")


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS step FROM events""")
def win2_carry_forward(spark, d):
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("Step: "), "event_id", F.lit("/9"))).otherwise(F.col("event_type"))
    rows = read(spark, d, "events").select("event_id", "user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    return L.with_step(rows, log="user_id").select("event_id", "user_id", "step")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS pos FROM documents")
def sam1_shuffle(spark, d):
    return Z.shuffled(read(spark, d, "documents").select("doc_id"), 7, "doc_id")


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p <= floor(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r""")
def sam4_split(spark, d):
    return Z.split(read(spark, d, "documents").select("doc_id"), 0.1, 42, "doc_id")


@query("""
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || source || ':' || doc_id), doc_id) AS pick FROM documents)
SELECT source, doc_id, pick::INT AS pick FROM r WHERE pick <= 5""")
def sam5_group_sample(spark, d):
    return Z.hash_sample(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 3)


@query("""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('9:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, p AS pos FROM r WHERE p <= floor(n * 0.25)""")
def lim2_fraction(spark, d):
    return Z.head_fraction(Z.shuffled(read(spark, d, "documents").select("doc_id"), 9, "doc_id"), 0.25)


@query("""
WITH t AS (SELECT 0 AS task_idx, c AS copy, conv_id AS id FROM (SELECT DISTINCT conv_id FROM conversations), range(1, 4) r(c) UNION ALL SELECT 1, 1, item_id FROM benchmark)
SELECT task_idx::INT AS task_idx, copy::INT AS copy, id, row_number() OVER (ORDER BY md5('5:' || task_idx || ':' || copy || ':' || id), task_idx, copy, id) AS pos FROM t""")
def set2_mixture(spark, d):
    a = read(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    return Z.mixture([(a, 3), (b, 1)], 5, "id").select("task_idx", "copy", "id", "pos")


@query("""
SELECT 0 AS task_idx, item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM benchmark
UNION ALL SELECT 1, page_id, row_number() OVER (ORDER BY page_id) - 1 + (SELECT count(*) FROM benchmark) FROM pages""")
def set3_sequence(spark, d):
    return Z.sequence([read(spark, d, "benchmark").select(F.col("item_id").alias("id")), read(spark, d, "pages").select(F.col("page_id").alias("id"))], "id").select("task_idx", "id", "pos")


@query("""
WITH a AS (SELECT item_id AS id, row_number() OVER (ORDER BY item_id) - 1 AS o FROM benchmark), b AS (SELECT page_id AS id, row_number() OVER (ORDER BY page_id) - 1 AS o FROM pages),
s AS (SELECT step, (('0x' || substr(md5('mix:' || step), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.2)::INT AS from_second FROM range((SELECT count(*) FROM a) + (SELECT count(*) FROM b)) t(step)),
p AS (SELECT step, from_second, coalesce(sum(from_second) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM s),
m AS (SELECT p.step, p.from_second, CASE WHEN from_second = 1 THEN b.id ELSE a.id END AS id FROM p LEFT JOIN a ON from_second = 0 AND a.o = step - k LEFT JOIN b ON from_second = 1 AND b.o = k)
SELECT step, from_second, id FROM m WHERE step < coalesce((SELECT min(step) FROM m WHERE id IS NULL), 1e18)""")
def sam3_interleave(spark, d):
    # ordinals of the two sources, by place
    a = Z.running_sum(read(spark, d, "benchmark").select(F.col("item_id").alias("id")), "id", F.lit(1), "ordinal", inclusive=False)
    b = Z.running_sum(read(spark, d, "pages").select(F.col("page_id").alias("id")), "id", F.lit(1), "ordinal", inclusive=False)
    return Z.interleave(a, b, 0.2, "mix").select("step", "from_second", "id")


@query("SELECT (doc_id % 8)::INT AS rank, count(*) AS n, sum(doc_id)::BIGINT AS total FROM documents GROUP BY ALL")
def win8_rank_stride(spark, d):
    return Z.rank_stride(read(spark, d, "documents"), "doc_id", 8).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("total"))


@query("""
WITH RECURSIVE r AS (SELECT n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b FROM documents),
s AS (SELECT b, sum(n_chars)::BIGINT AS n, count(*) AS docs FROM r GROUP BY b),
f(b, shard, held) AS (SELECT b, 0, n FROM s WHERE b = 0 UNION ALL SELECT s.b, CASE WHEN f.held >= 300000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= 300000 THEN s.n ELSE f.held + s.n END FROM f JOIN s ON s.b = f.b + 1)
SELECT shard::INT AS shard, sum(docs)::BIGINT AS n_docs, sum(n)::BIGINT AS n_chars FROM f JOIN s USING (b) GROUP BY shard""")
def agg9_shard_cuts(spark, d):
    cut = Z.shard_cuts(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), 300_000, 64)
    return cut.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))


# ---- arrays


@query("""
WITH v AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS l FROM lineitem GROUP BY ALL)
SELECT k, len(l)::INT AS n, l[1:len(l) - 1] AS inputs, l[2:] AS targets, CASE WHEN len(l) > 3 THEN l[-3:] ELSE l END AS tail FROM v""")
def arr4_shift(spark, d):
    each = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"])
    v = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(each.alias("l"))
    s = A.shift(F.col("l"))
    return v.select("k", F.size("l").alias("n"), s["inputs"].alias("inputs"), s["targets"].alias("targets"), A.keep_tail(F.col("l"), 3).alias("tail"))


@query("""
WITH v AS (SELECT o_custkey AS k, list(substr(o_orderpriority, 1, 8) ORDER BY o_orderkey) AS l FROM orders GROUP BY ALL)
SELECT k, coalesce(list_min([i FOR i IN range(0, 9) IF i = list_min([length(x) FOR x IN l]) OR len(list_distinct([substr(x, i::INT + 1, 1) FOR x IN l])) > 1]), 0)::INT AS prefix FROM v""")
def arr1_common_prefix(spark, d):
    each = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.substring("o_orderpriority", 1, 8).alias("p")))), lambda x: F.filter(F.split(x["p"], ""), lambda c: c != ""))
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(each.alias("l")).select("k", A.common_length(F.col("l")).alias("prefix"))


# ---- tokenizer, packing, evaluation: by kernels that SQL does not express

#: Ids of the tokenizer, as the reference trains it by default.
VOCABULARY = 32_768
_TOKENIZER: dict[str, K.Tokenizer] = {}


def tokenizer(spark, d) -> K.Tokenizer:
    """Trained on the whole corpus, once for each folder."""
    if d not in _TOKENIZER:
        _TOKENIZER[d] = K.train(read(spark, d, "documents"), VOCABULARY)
    return _TOKENIZER[d]


# without look-ahead and possessive repeats, which the other engine lacks; equal where no text has runs of blanks
_PIECES = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]|\s+"""


@query(f"SELECT chunk, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_PIECES.replace(chr(39), chr(39) * 2)}')) AS chunk FROM documents) GROUP BY chunk")
def tok1_chunk_counts(spark, d):
    return K.chunk_counts(read(spark, d, "documents"))


@query()
def tok2_train(spark, d):
    return tokenizer(spark, d).vocabulary(spark)


@query()
def tok3_encode(spark, d):
    docs = K.encoded(read(spark, d, "documents").select("doc_id", "text"), tokenizer(spark, d), prepend="<|bos|>")
    return docs.select("doc_id", F.size("ids").alias("n_tokens"), F.round(M.compression_ratio(F.col("text"), F.size("ids") - 1), 6).alias("ratio"))


@query()
def tok6_render(spark, d):
    m = F.col("messages")
    c = C.assemble(read(spark, d, "conversations")).filter((m[0]["role"] != "system") | F.get(m, F.lit(1))["role"].eqNullSafe(F.lit("user")))
    return K.rendered(c, tokenizer(spark, d)).select("conv_id", "ids", "mask")


@query()
def pck1_packed_rows(spark, d):
    docs = K.encoded(read(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text"), tokenizer(spark, d), prepend="<|bos|>").select("pos", "ids")
    return P.packed_rows(docs, 513, world=8)


@query()
def pck2_padded_rows(spark, d):
    c = tok6_render(spark, d).withColumnRenamed("conv_id", "pos")
    return P.padded_rows(c, 2049, tokenizer(spark, d).bos, world=4)


@query("""
WITH r AS (SELECT item_id AS pos, item_id // 4 AS mini, item_id % 4 AS k FROM benchmark), n AS (SELECT count(*) // 4 // 2 AS steps FROM benchmark)
SELECT pos, (mini // 2)::BIGINT AS step, (mini % 2)::BIGINT AS minibatch_id, (k // 2)::BIGINT AS device, side, (k % 2 + CASE WHEN side = 'rejected' THEN 2 ELSE 0 END)::BIGINT AS slot
FROM r, n, (VALUES ('chosen'), ('rejected')) s(side) WHERE mini // 2 < steps""")
def pck3_preference_batches(spark, d):
    rows = P.preference_batches(read(spark, d, "benchmark").select(F.col("item_id").alias("pos")), batch=4, minibatch=2, devices=2)
    return rows.select("pos", "step", F.col("minibatch_id").cast("bigint").alias("minibatch_id"), "device", "side", F.col("slot").cast("bigint").alias("slot"))


@query()
def pck5_few_shot(spark, d):
    item = read(spark, d, "benchmark").select(F.lit("t").alias("task"), F.col("item_id").alias("pos"), F.col("text").alias("query"), F.array(F.lit("yes"), F.lit("no")).alias("choices"), F.pmod("item_id", F.lit(2)).cast("int").alias("gold"))
    shots = E.few_shot(item, 3)
    asked = shots.withColumns({"prompts": E.choice_prompts(F.struct("query", "choices", "gold"), " ", F.col("shots")), "task_type": F.lit("multiple_choice")})
    return E.masked_sequences(asked, tokenizer(spark, d), 2048).select("pos", F.posexplode("sequences").alias("choice", "s")).select("pos", "choice", "s.ids", "s.mask")


@query()
def str9_edit_pair(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text").withColumn("edited", F.regexp_replace("text", r"^([^\n]*)\n", "$1 more\n"))
    return docs.withColumn("e", R.compute_edit("text", "edited")).select("doc_id", F.length("e.old_string").alias("old_chars"), F.length("e.new_string").alias("new_chars"))
