"""Registered queries of the operators on text, code, calls, files and streams, and their DuckDB SQL.

The driver's tables have no code, tool calls or logs, so each query derives its input from a whole table by a rule
that its SQL states the outcome of: texts with fences, calls, numbered lines and log lines, one for each row.
Queries of sources and sinks write a table to the shared folder and read it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A
from lodestone.functions import json as J
from lodestone.functions import metrics as M
from lodestone.functions import text as S
from lodestone.operators import conversations as C
from lodestone.operators import evals as E
from lodestone.operators import logs as L
from lodestone.operators import packing as P
from lodestone.operators import rollouts as R
from lodestone.operators import sampling as Z
from lodestone.operators import scenarios as Y
from lodestone.operators import tokenizer as K
from lodestone.plans.queries import query, read, tokenizer
from lodestone.sources import readers as I
from lodestone.sources import row_groups as G
from lodestone.sources import sinks as O
from lodestone.streaming import endless as X
from lodestone.streaming import streams as T


def _case(key: str, *values: Column) -> Column:
    """The value whose place is the key modulo their number."""
    out = F.lit(None)
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.pmod(F.col(key), F.lit(len(values))) == i, v).otherwise(out)
    return out


def _text(*parts) -> Column:
    """Parts joined: text as it is, columns by their names in braces."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


def _docs(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "text")


def _messages(spark, d):
    return C.assemble(read(spark, d, "conversations"))


# ---- text and code

# parts of _text, as columns cannot be made before there is a session
FENCED = "Intro ", "{source}", "\n```python\nx = ", "{doc_id}", "\n```\nThe END"
BARE = "Some WORDS\nimport os\ny = ", "{doc_id}"
NONE = "Nothing here ", "{doc_id}"
FOUND = "def find_", "{doc_id}", "(x):\n    y = x\n    return y"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '_' || doc_id || '.py' WHEN 1 THEN 'kind' || doc_id || '.py' ELSE 'solution_' || doc_id || '.py' END AS name FROM documents")
def str2_infer_filename(spark, d):
    code = _case("doc_id", _text("x = 1\ndef ", "{source}", "_", "{doc_id}", " (a):\n    return a"), _text("class Kind", "{doc_id}", "(Base):\n    pass"), F.lit("x = 2"))
    return _docs(spark, d).select("doc_id", S.infer_filename(code, F.col("doc_id")).alias("name"))


@query(r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'intro ' || lower(source) WHEN 1 THEN 'some words' ELSE '' END AS before,
       CASE doc_id % 3 WHEN 0 THEN 'x = ' || doc_id WHEN 1 THEN 'import os' || chr(10) || 'y = ' || doc_id ELSE '' END AS code,
       CASE doc_id % 3 WHEN 0 THEN 'the end' ELSE '' END AS after FROM documents""")
def str3_extract_chat_code(spark, d):
    return _docs(spark, d).select("doc_id", S.extract_chat_code(_case("doc_id", _text(*FENCED), _text(*BARE), _text(*NONE))).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, 'Intro ' || source AS before, 'x = ' || doc_id AS code, 'The END' AS after FROM documents WHERE doc_id % 3 = 0")
def str4_extract_pair_code(spark, d):
    return _docs(spark, d).select("doc_id", S.extract_pair_code(_case("doc_id", _text(*FENCED), _text(*BARE), _text(*NONE))).alias("x")).filter("x is not null").select("doc_id", "x.*")


@query(r"""
SELECT doc_id, bare, CASE doc_id % 3 WHEN 0 THEN 'Intro ' || source || chr(10) || chr(10) || 'The END' WHEN 2 THEN 'Nothing here ' || doc_id
       ELSE CASE WHEN bare THEN 'Some WORDS' ELSE 'Some WORDS' || chr(10) || 'import os' || chr(10) || 'y = ' || doc_id END END AS prose,
       CASE doc_id % 3 WHEN 0 THEN 'x = ' || doc_id WHEN 2 THEN '' ELSE CASE WHEN bare THEN 'import os' || chr(10) || 'y = ' || doc_id ELSE '' END END AS code
FROM documents, (VALUES (true), (false)) t(bare)""")
def str5_extract_field_code(spark, d):
    text = _case("doc_id", _text(*FENCED), _text(*BARE), _text(*NONE))
    each = F.array(*[F.struct(F.lit(b).alias("bare"), S.extract_field_code(text, b).alias("x")) for b in (True, False)])
    return _docs(spark, d).select("doc_id", F.explode(each).alias("e")).select("doc_id", "e.bare", "e.x.*")


@query("SELECT doc_id, (doc_id % 4)::INT AS n, rtrim(repeat('b = 1|', (doc_id % 4)::INT), '|') AS joined FROM documents")
def str6_fenced_blocks(spark, d):
    blocks = S.fenced_blocks(F.expr("repeat('```\\nb = 1\\n```\\n ```python\\n  \\n``` prose ', cast(doc_id % 4 as int))"))
    return _docs(spark, d).select("doc_id", F.size(blocks).alias("n"), F.array_join(blocks, "|").alias("joined"))


@query("SELECT doc_id, 'def' AS keyword, 'find_' || doc_id AS name, 'f.py:1:def find_' || doc_id || '(x):' || chr(10) || 'f.py:2:    y = x' || chr(10) || 'f.py:3:    return y' AS found FROM documents")
def str8_grep_result(spark, d):
    target = S.grep_target(_text(*FOUND))
    found = S.grep_result(target, F.lit("f.py"), _text(*FOUND), F.col("doc_id"))
    return _docs(spark, d).select("doc_id", target["keyword"].alias("keyword"), target["name"].alias("name"), found.alias("found"))


@query("""SELECT doc_id, '{"k": ' || doc_id || '}' AS answer FROM documents""")
def str10_clean_answer(spark, d):
    return _docs(spark, d).select("doc_id", S.clean_answer(_text("<think>a\nb</think>\n ```json\n{\"k\": ", "{doc_id}", "}\n```\n")).alias("answer"))


@query("""
SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN '[user]: ' || coalesce(text, '') ELSE '[assistant]: "' || coalesce(text, '') || '"' END, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS shown
FROM conversations GROUP BY conv_id""")
def str11_render_restyle(spark, d):
    return _messages(spark, d).select("conv_id", S.render_restyle(F.col("messages")).alias("shown"))


@query("SELECT doc_id, md5(text) AS back FROM documents")
def str12_strip_line_numbers(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(S.strip_line_numbers(S.line_numbers(F.col("text"))).cast("binary")).alias("back"))


@query("SELECT doc_id, 'Edit' AS name, 3 AS n, 'a' || doc_id || '.py' AS path, doc_id AS line, '' AS flag FROM documents")
def str13_parse_tool_call(spark, d):
    call = S.parse_tool_call(_text(" Edit <|tool_arg|>file_path<|tool_val|> a", "{doc_id}", ".py <|tool_arg|>line<|tool_val|>", "{doc_id}", "<|tool_arg|>flag"))
    rows = _docs(spark, d).select("doc_id", call.alias("c"))
    return rows.select("doc_id", "c.name", F.size("c.args").alias("n"), F.col("c.args")[0]["val"].alias("path"), F.col("c.args")[1]["int_val"].alias("line"), F.col("c.args")[2]["val"].alias("flag"))


@query("SELECT doc_id, source || '|' AS plain FROM documents")
def str15_strip_ansi(spark, d):
    return _docs(spark, d).select("doc_id", S.strip_ansi(_text("\x1b[92m", "{source}", "\x1b[0;1m|")).alias("plain"))


@query("SELECT doc_id, printf('shard_%05d.parquet', doc_id) AS name FROM documents")
def str19_shard_name(spark, d):
    return _docs(spark, d).select("doc_id", S.shard_name(F.col("doc_id")).alias("name"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN trunc(value)::BIGINT::VARCHAR ELSE printf('%.4f', value) END AS shown FROM events")
def str20_metric_text(spark, d):
    return read(spark, d, "events").select("event_id", S.metric_text(F.when(F.col("event_type") == "click", "tkps").otherwise("loss"), F.col("value")).alias("shown"))


# ---- conversations, scenarios, rollouts


@query("SELECT conv_id, (count(*) + 1)::INT AS n, 'system:Be brief.' AS first FROM conversations GROUP BY conv_id")
def prj2_prepend_system(spark, d):
    m = C.prepend_system(F.col("messages"), "Be brief.")
    return _messages(spark, d).select("conv_id", F.size(m).alias("n"), F.concat_ws(":", m[0]["role"], m[0]["content"]).alias("first"))


@query("""
WITH v AS (SELECT l_orderkey AS k, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS l FROM lineitem GROUP BY ALL)
SELECT k, l[:3] AS head, [0 FOR x IN l[:1]] || [1 FOR x IN l[2:]] AS mask, 128 AS padded, l[len(l)] AS last_own, -7 AS last_pad, [l[i:least(i + 1, len(l))] FOR i IN range(1, len(l) + 1, 2)] AS chunks FROM v""")
def arr3_pad_and_chunk(spark, d):
    each = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"].cast("int"))
    v = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(each.alias("l"))
    padded = A.pad(F.col("l"), A.bucket(F.size("l")), -7)
    return v.select("k", A.keep_head(F.col("l"), 3).alias("head"), A.choice_mask(F.col("l"), F.lit(1)).alias("mask"), F.size(padded).alias("padded"), F.get(padded, F.size("l") - 1).alias("last_own"), F.element_at(padded, -1).alias("last_pad"), A.chunked(F.col("l"), 2).alias("chunks"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, max_by(role, turn) AS last, arg_max(role, turn) FILTER (turn < mx) AS before FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS mx FROM conversations) GROUP BY conv_id)
SELECT conv_id, (n - 1)::INT AS n, before FROM c WHERE last = 'assistant'""")
def prj7_without_last_answer(spark, d):
    rows = _messages(spark, d).filter(F.element_at("messages", -1)["role"] == "assistant")
    m = C.without_last_answer(F.col("messages"))
    return rows.select("conv_id", F.size(m).alias("n"), F.try_element_at(m, F.lit(-1))["role"].alias("before"))


_QUOTED = Y.REQUEST.replace("'", "''"), Y.NOTES.replace("'", "''")


@query(f"SELECT item_id, 's' || item_id AS _scenario_id, text AS _scenario_prompt, '{_QUOTED[0]}' || text || CASE WHEN item_id % 2 = 0 THEN '{_QUOTED[1]}note' ELSE '' END || '''' AS _generator_prompt FROM benchmark")
def prj9_stamped_rollouts(spark, d):
    items = read(spark, d, "benchmark")
    s = items.select(_text("s", "{item_id}").alias("id"), F.col("text").alias("prompt"), F.when(F.col("item_id") % 2 == 0, "note").alias("notes"))
    return Y.stamped(items.select("item_id", _text("s", "{item_id}").alias("id")), s)


@query("""
WITH f AS (SELECT o_custkey AS pos, o_orderkey AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'C' ELSE 'Python' END AS lang, o_orderkey % 5 = 0 AS vendor, floor(o_totalprice)::BIGINT AS n FROM orders),
r AS (SELECT pos, count(*) AS stars, coalesce(sum(n) FILTER (lang = 'Python' AND NOT vendor AND n BETWEEN 20000 AND 200000), 0) AS size FROM f GROUP BY pos HAVING count(*) >= 2),
k AS (SELECT pos, sum(size) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) - size AS prior FROM r)
SELECT f.pos, path, n AS length_bytes FROM f JOIN k USING (pos) WHERE prior < 12000000 AND lang = 'Python' AND NOT vendor AND n BETWEEN 20000 AND 200000""")
def fil2_repository_files(spark, d):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "C").otherwise("Python")
    file = F.struct(F.col("o_orderkey").alias("path"), kind.alias("language"), F.when(F.col("o_orderkey") % 5 == 0, True).alias("is_vendor"), F.lit(None).cast("boolean").alias("is_generated"), F.floor("o_totalprice").cast("bigint").alias("length_bytes"))
    repos = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("pos")).agg(F.count(F.lit(1)).alias("star_events_count"), F.collect_list(file).alias("files"))
    return I.repository_files(repos, 2, 20_000, 200_000, budget=10_000_000).select("pos", "path", "length_bytes")


_CODE = "value = 1234567890"
_FENCE = lambda code: F.lit(f"Done:\n```python\n{code}\n```")
_OUTCOMES = ("empty", "not_english", "no_code_out", "not_python_out", "identical", "code_out_only", "code_both", "build_fail")


def _evolved(spark, d):
    write = F.lit("Write some code for me")
    ask = _case("doc_id", F.lit(""), F.lit("é" * 20), write, write, _FENCE(_CODE), write, _FENCE(_CODE + "\nother = 1"), write)
    got = _case("doc_id", write, write, write, _FENCE("x = = 1\nfoo bar baz"), _FENCE(_CODE), _FENCE(_CODE + "\nother = 2"), _FENCE(_CODE + "\nother = 2"), _FENCE(_CODE))
    return R.evolved(_docs(spark, d).select("doc_id", ask.alias("instruction"), got.alias("output")))


@query(f"SELECT doc_id, [{', '.join(repr(x) for x in _OUTCOMES)}][doc_id % 8 + 1] AS outcome FROM documents")
def fil6_evolved_outcomes(spark, d):
    return _evolved(spark, d).select("doc_id", "outcome")


@query(f"SELECT [{', '.join(repr(x) for x in _OUTCOMES)}][doc_id % 8 + 1] AS outcome, count(*) AS n FROM documents GROUP BY 1")
def agg1_outcome_counts(spark, d):
    return _evolved(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS _source_idx, 'demo' AS _source, 4 AS n, 'def total_' || doc_id || '(values):' || chr(10) || '    return sum(values)' AS code, 'total_' || doc_id || '.py' AS path FROM documents WHERE doc_id % 2 = 0")
def fil7_rollouts_from_pairs(spark, d):
    good = _text("Sure.\n```python\ndef total_", "{doc_id}", "(values):\n    return sum(values)\n```\nIt adds.")
    rows = _docs(spark, d).select(F.col("doc_id").alias("_source_idx"), F.lit("Add them").alias("instruction"), _case("doc_id", good, F.lit("```python\nx = 1\n```")).alias("response"))
    call = F.col("messages")[1]["tool_call"]
    return R.from_pairs(rows, "demo").select("_source_idx", "_source", F.size("messages").alias("n"), C.argument(call, "new_string").alias("code"), C.argument(call, "file_path").alias("path"))


@query("""
WITH c AS (SELECT conv_id, min_by(role, turn) AS first, CASE WHEN conv_id % 7 <> 0 THEN sum(length(text)) END AS n FROM conversations GROUP BY conv_id)
SELECT CASE WHEN first <> 'user' THEN 'invalid' WHEN n IS NULL THEN 'tokenizer_failure' WHEN n > 1000 THEN 'too_long' ELSE 'valid' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def fil10_validated(spark, d):
    n = F.aggregate("messages", F.lit(0), lambda s, m: s + F.length(m["content"]))
    return R.outcomes(_messages(spark, d), F.when(F.col("conv_id") % 7 != 0, n), 1000).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, 7 AS n, 'user,assistant:Grep,tool_result,assistant:Read,tool_result,assistant:Edit,tool_result' AS steps, '    1→def find_' || doc_id || '(x):' AS shown FROM documents")
def arr8_add_search_steps(spark, d):
    code = _text(*FOUND)
    m = F.array(C.message("user", F.lit("change it")), C.message("assistant", F.lit("ok"), F.lit("Edit"), C.args(file_path=F.lit("f.py"), new_string=code)), C.message("tool_result", F.lit("done")))
    rows = _docs(spark, d).select("doc_id", R.add_search_steps(m, code, F.col("doc_id")).alias("m"))
    steps = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["tool_call"]["name"])), ",")
    return rows.select("doc_id", F.size("m").alias("n"), steps.alias("steps"), S.lines(F.col("m")[4]["content"])[0].alias("shown"))


# Edits of a rollout with one fault each, and what the rules say of it.
# Messages are functions, as columns cannot be made before there is a session.
def _call(name: str, **values: str) -> Callable[[], Column]:
    return lambda: C.message("assistant", F.lit("ok"), F.lit(name), C.args(**{k: F.lit(v) for k, v in values.items()}))


_SAID = lambda role, text: lambda: C.message(role, F.lit(text))
_ASK, _DONE, _END = _SAID("user", "do it"), _SAID("tool_result", "done"), _SAID("assistant", "All done.")
_EDIT = {"old_string": "a", "new_string": "b"}
_CASES = (
    ([_ASK, _call("Edit", **_EDIT), _DONE, _END], [], []),
    ([_ASK, _call("Edit", old_string="1→a", new_string="b"), _DONE, _END], ["Edit old_string contains line numbers"], ["Edit old_string contains line number formatting"]),
    ([_ASK, _call("Edit", **_EDIT), _SAID("tool_result", "rejected: 1→x"), _END], [], ["Rejection tool_result contains file contents", "Rejection not followed by user message", "Rejection not followed by user message (got assistant)"]),
    ([_ASK, _call("Read", file_path="f"), _SAID("tool_result", "error: none"), _ASK, _END], [], ["Error followed by user instead of assistant"]),
    ([_ASK, _call("Read", file_path="f")], ["tool_call at end without tool_result"], ["tool_call at end without tool_result"]),
    ([_ASK, _call("Read", file_path="f"), _END], ["tool_call not followed by tool_result"], ["tool_call not followed by tool_result (got assistant)"]),
    ([_ASK, *[_call("Read", file_path="f"), _DONE] * 4, _END], [], ["Agent made same tool call 3+ times in a row"] * 2),
    ([_ASK, _call("Edit", old_string="a", pattern="x"), _DONE, _END], [], ["Edit tool call contains invalid 'pattern' arg", "Edit tool call missing required 'new_string'"]),
    ([_ASK, _call("Read", file_path="f"), _SAID("tool_result", "    1→a\n    3→b\n    2→c\n 4→d"), _END], ["line prefix wrong length: 2"], ["Line number prefix wrong length (2): ' 4→d'", "Line numbers not sequential: 3 -> 2"]),
    ([_ASK, _call("Read", file_path="f"), _SAID("tool_result", "EXACTLY"), _SAID("assistant", "Anything  else?")], [], ["Format description leaked into tool_result", "Assistant soliciting new work at turn 3", "Assistant asked question in final turn", "Assistant offering follow-up in final turn"]),
    ([_SAID("assistant", "Hi."), _SAID("user", "Scenario: x")], ["first message not from user"], ["First message not from user", "User content contains 'scenario:'"]),
    ([_ASK], [], ["No assistant message"]),
)


def _listed(rows) -> str:
    return "[" + ", ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + "]::VARCHAR[]" for r in rows) + "]"


def _faulty(spark, d):
    return read(spark, d, "documents").select("doc_id", _case("doc_id", *[F.array(*[m() for m in c[0]]).cast(C.MESSAGES) for c in _CASES]).alias("messages"))


@query(f"SELECT doc_id, {_listed([c[1] for c in _CASES])}[doc_id % {len(_CASES)} + 1] AS problems FROM documents")
def val1_short_rules_on_calls(spark, d):
    return _faulty(spark, d).select("doc_id", C.short_problems(F.col("messages")).alias("problems"))


@query(f"SELECT doc_id, list_sort({_listed([c[2] for c in _CASES])}[doc_id % {len(_CASES)} + 1] || ['Unexpected top-level key: extra']) AS problems FROM documents")
def val2_long_rules_on_calls(spark, d):
    keys = F.array(F.lit("messages"), F.lit("extra"), F.lit("_scenario_id"))
    return _faulty(spark, d).select("doc_id", F.array_sort(C.long_problems(F.col("messages"), keys)).alias("problems"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['Line numbers not sequential: 3 -> 2']::VARCHAR[] ELSE [] END AS problems FROM documents")
def win5_rising_line_numbers(spark, d):
    content = _case("doc_id", F.lit("    1→a\n    3→b\n    2→c"), F.lit("    1→a\n    7→b\nno → here\nerror: → x"))
    return read(spark, d, "documents").select("doc_id", C.line_problems(content).alias("problems"))


@query("""
WITH a AS (SELECT user_id, event_id, value < 2 AS passed, CASE WHEN event_type = 'view' THEN 'tokenization' ELSE event_type END AS kind FROM events),
c AS (SELECT *, min(event_id) FILTER (passed) OVER (PARTITION BY user_id) AS chosen FROM a)
SELECT user_id, any_value(chosen) AS chosen_at, min(event_id) FILTER (NOT passed AND kind <> 'tokenization') AS rejected_at, count(*) AS attempts FROM c WHERE chosen IS NULL OR event_id <= chosen GROUP BY user_id""")
def stm5_resolved_attempts(spark, d):
    kind = F.when(F.col("event_type") == "view", "tokenization").otherwise(F.col("event_type"))
    rows = read(spark, d, "events").select("user_id", "event_id", (F.col("value") < 2).alias("passed"), kind.alias("kind"))
    return R.resolve_attempts(rows, "user_id", "event_id").select("user_id", "chosen_at", "rejected_at", "attempts")


@query("""
WITH c AS (SELECT *, min(event_id) FILTER (value < 2) OVER (PARTITION BY user_id) AS chosen FROM events),
u AS (SELECT user_id, any_value(chosen) AS chosen, count(*) AS n FROM c WHERE chosen IS NULL OR event_id <= chosen GROUP BY user_id)
SELECT count(chosen) AS kept, count(*) FILTER (chosen IS NULL) AS failed, round(avg(n), 9) AS mean_attempts FROM u""")
def agg3_attempt_statistics(spark, d):
    return Y.attempt_statistics(stm5_resolved_attempts(spark, d)).withColumn("mean_attempts", F.round("mean_attempts", 9))


@query("""
WITH c AS (SELECT conv_id, min_by(role, turn) AS first, count(*) FILTER (role = 'assistant') AS answers FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'tokenization' WHEN p > 0 THEN 'rules' WHEN conv_id % 10 < 9 THEN 'critique' END AS kind
FROM (SELECT conv_id, CASE WHEN bad THEN 1 ELSE 0 END AS p FROM (SELECT conv_id, (first <> 'user') OR answers = 0 AS bad FROM c))""")
def udf2_judged(spark, d):
    plain = C.replace_answers(F.col("messages"), F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.lit("Well.")))
    rows = _messages(spark, d).select("conv_id", plain.alias("messages"), F.when(F.col("conv_id") % 3 == 0, 5000).otherwise(10).alias("n_tokens"), (F.col("conv_id") % 10).cast("int").alias("rating"))
    return Y.judged(rows).select("conv_id", "kind")


@query("""
WITH m AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS n, list(CASE WHEN role = 'assistant' THEN 'new ' || turn ELSE text END ORDER BY turn) AS l FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 0 AND conv_id % 2 = 1 THEN 'json_error' END AS kind, CASE WHEN n = 0 OR conv_id % 2 = 0 THEN l END AS styled FROM m""")
def udf3_restyled(spark, d):
    new = F.transform(F.filter(F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), i.alias("i"))), lambda x: x["role"] == "assistant"), lambda x: F.concat(F.lit("new "), (x["i"] + F.col("first_turn")).cast("string")))
    first = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.min("turn").cast("int").alias("first_turn"))
    rows = _messages(spark, d).join(first, F.col("conv_id") == F.col("c"))
    answer = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(new.alias("assistant_contents")))).otherwise(F.lit("[oh"))
    rows = rows.select(F.col("conv_id").alias("id"), F.lit(1).alias("attempt"), "messages", answer.alias("answer"), F.lit(9).alias("rating"))
    return Y.restyled(rows).select(F.col("id").alias("conv_id"), "kind", F.transform("styled", lambda m: m["content"]).alias("styled"))


@query("SELECT item_id, 'Re: ' || text AS answer FROM benchmark")
def udf1_with_model(spark, d):
    return R.with_model(read(spark, d, "benchmark"), lambda prompts: ["Re: " + p for p in prompts], "text").select("item_id", "answer")


@query("SELECT b AS batch, list_transform(list_sort(list_transform(['t1', 't2', 't3'], lambda x: md5('st:' || b || ':' || x) || x))[1:2], lambda x: x[33:]) AS tasks FROM range(50) t(b)")
def udf5_scenario_batches(spark, d):
    return Y.batches(spark, 50, ["t1", "t2", "t3"], ["d1", "d2"], ["m1"], seed="s", k=2).select("batch", "tasks")


# ---- JSON, joins, metrics


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ['hi ' || doc_id] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c'] WHEN 3 THEN ['plain words'] END AS contents FROM documents""")
def jsn1_answer_contents(spark, d):
    text = _case("doc_id", _text('"hi ', "{doc_id}", '"'), F.lit('["a", "b"]'), F.lit('{"assistant_contents": ["c"]}'), F.lit(" plain words "), F.lit("[broken"))
    return read(spark, d, "documents").select("doc_id", J.answer_contents(text, F.lit(1)).alias("contents"))


@query("""SELECT doc_id, '{"id":' || doc_id || ',"source":"' || source || '"}' AS j FROM documents""")
def jsn2_dumps(spark, d):
    return _docs(spark, d).select("doc_id", J.dumps(F.struct(F.col("doc_id").alias("id"), F.col("source"))).alias("j"))


@query("SELECT event_id, coalesce((props->>'$.k')::BIGINT, -1) AS k, -1::BIGINT AS other, json_exists(props, '$.k') AS has FROM events")
def jsn3_fields(spark, d):
    p = F.col("props")
    return read(spark, d, "events").select("event_id", J.field(p, "$.k", F.lit(-1).cast("bigint"), "bigint").alias("k"), J.field(p, "$.none", F.lit(-1).cast("bigint"), "bigint").alias("other"), J.has_key(p, "k").alias("has"))


@query("SELECT l_returnflag AS flag, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE length(p_name) END)::BIGINT AS n_bytes, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def joi4_token_bytes(spark, d):
    vocabulary = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.length("p_name").alias("n_bytes"))
    target = F.when(F.col("l_linenumber") == 1, F.lit(A.IGNORE)).otherwise(F.col("l_partkey"))
    rows = E.with_token_bytes(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), target.alias("target")), vocabulary)
    return rows.groupBy("flag").agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT lang AS name, sum(strlen(text)) AS b, sum(length(text)) AS x, sum(length(text) // 2 + 1) AS y FROM documents GROUP BY lang)
SELECT name, round(b / x, 9) AS base_ratio, round(b / y, 9) AS ours_ratio, round((x - y) / x * 100, 9) AS relative_diff, CASE WHEN b / x > b / y THEN 'base' WHEN b / y > b / x THEN 'ours' ELSE 'tie' END AS winner FROM s""")
def agg6_tokenizer_comparison(spark, d):
    n = F.length("text")
    each = F.array(F.struct(F.lit("base").alias("tokenizer"), n.cast("bigint").alias("n_tokens")), F.struct(F.lit("ours").alias("tokenizer"), (F.floor(n / 2) + 1).alias("n_tokens")))
    rows = read(spark, d, "documents").select(F.col("lang").alias("name"), F.octet_length("text").alias("n_bytes"), F.explode(each).alias("e")).select("name", "n_bytes", "e.*")
    return E.tokenizer_comparison(rows).select("name", "winner", *[F.round(c, 9).alias(c) for c in ("base_ratio", "ours_ratio", "relative_diff")])


@query("SELECT l_orderkey AS k, l_linenumber AS n, floor(l_quantity * 1000 / l_linenumber)::BIGINT AS tkps, round(100 * 6000.0 * floor(l_quantity * 1000 / l_linenumber) / 1e9, 9) AS mfu, round(((l_discount + l_tax) / 2)::DOUBLE, 9) AS mean FROM lineitem")
def agg17_throughput(spark, d):
    tkps = M.throughput(F.col("l_quantity") * 1000, F.col("l_linenumber"))
    rows = read(spark, d, "lineitem").withColumn("tkps", tkps.cast("bigint"))
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "tkps", F.round(M.utilisation(F.col("tkps"), F.lit(6000.0), F.lit(1e9)), 9).alias("mfu"), F.round(M.average(F.col("l_discount"), F.col("l_tax")).cast("double"), 9).alias("mean"))


@query("SELECT n AS layers, 6 * (1000000 * n - 5000) + 12 * n * 4 * 64 * 1024 AS flops, ceil(8 * 1000000.0 * n / 4096)::BIGINT + 1 AS steps FROM range(1, 25) t(n)")
def mth3_model_sizes(spark, d):
    rows = [(n, M.flops_per_token(1_000_000 * n, 5000, n, 4, 64, 1024), M.training_steps(8, 1_000_000 * n, 4096)) for n in range(1, 25)]
    return spark.createDataFrame(rows, "layers bigint, flops bigint, steps bigint")


# ---- logs


def _log(spark, d):
    line = _case("event_id", _text("Step: ", "{event_id}", "/9999 | Loss: ", "{event_id}", ".5 | lr tkps: ", "{event_id}", " | mfu: 1.5"), F.lit("\tPeak bytes reserved/limit: 2.5/9.0GB"), F.lit("  CORE metric: 0.125"), F.lit("noise"))
    return read(spark, d, "events").select(F.pmod("user_id", F.lit(5)).alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))


_LOGGED = """
e AS (SELECT user_id % 5 AS log, event_id AS line_no, event_id % 4 AS c FROM events),
s AS (SELECT *, coalesce(max(CASE WHEN c = 0 THEN line_no END) OVER (PARTITION BY log ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) AS step FROM e),
v AS (SELECT log, series, line_no, step, name, value FROM s JOIN (VALUES (0, 'train', 'loss'), (0, 'train', 'tkps'), (0, 'train', 'mfu'), (1, 'memory', 'memory (GB)'), (2, 'core', 'CORE')) n(c, series, name) USING (c),
      LATERAL (SELECT CASE name WHEN 'loss' THEN line_no + 0.5 WHEN 'tkps' THEN line_no WHEN 'mfu' THEN 1.5 WHEN 'CORE' THEN 0.125 ELSE 2.5 END::DOUBLE AS value))"""


@query(f"WITH {_LOGGED.strip()} SELECT * FROM v")
def str16_log_metrics(spark, d):
    return L.metrics(_log(spark, d))


@query(f"""
WITH {_LOGGED.strip()}, f AS (SELECT log, series, name, min_by(value, line_no) AS a, max_by(value, line_no) AS b FROM v GROUP BY ALL)
SELECT log, '| ' || series || ' | ' || name || ' | ' || CASE WHEN name = 'tkps' THEN a::BIGINT::VARCHAR ELSE printf('%.4f', a) END || ' | ' || CASE WHEN name = 'tkps' THEN b::BIGINT::VARCHAR ELSE printf('%.4f', b) END || ' |' AS line FROM f""")
def snk7_report(spark, d):
    return L.report(L.metrics(_log(spark, d))).select("log", "line")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, sum((event_type = 'click')::INT) OVER w AS b FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, max(b) FILTER (event_type = 'view') OVER (PARTITION BY user_id) AS top FROM e)
SELECT user_id AS log, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS n, '<|bos|>made ' || event_id AS text FROM t WHERE b = top AND event_type = 'view'""")
def win7_generations(spark, d):
    line = F.when(F.col("event_type") == "click", _text("Step: ", "{event_id}", "/9")).otherwise(_text("\t<|bos|>made ", "{event_id}"))
    rows = read(spark, d, "events").filter("event_type in ('click', 'view')").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line"))
    return L.generations(rows)


@query("SELECT o_orderpriority AS task, round(avg(o_totalprice) / 1000000, 6) AS accuracy, round(avg(o_custkey) / 1000000, 6) AS centered FROM orders GROUP BY 1 UNION ALL SELECT 'CORE', NULL, round(avg(c), 6) FROM (SELECT avg(o_custkey) / 1000000 AS c FROM orders GROUP BY o_orderpriority)")
def src13_eval_csv(spark, d):
    scores = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("task")).agg((F.avg("o_totalprice") / 1_000_000).cast("double").alias("accuracy"), (F.avg("o_custkey") / 1_000_000).alias("centered"))
    return L.parse_eval_csv(L.format_eval_csv(scores))


@query("SELECT user_id AS log, round(min_by(value, event_id), 2) AS fwe_bpb, 0.5 AS sv2_bpb, 0.25 AS avg_bpb FROM events GROUP BY user_id")
def src13_eval_bpb(spark, d):
    line = F.concat(F.lit("fwe_bpb: "), F.format_string("%.2f", "value"), F.lit(" | sv2_bpb: 0.5 | avg_bpb: 0.25"))
    return L.parse_eval_bpb(read(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), line.alias("line")))


# ---- sources and sinks

_SHARDS = """
RECURSIVE r AS (SELECT doc_id, text, n, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b, (row_number() OVER (ORDER BY doc_id) - 1) AS k FROM (SELECT doc_id, text, length(text) AS n FROM documents)),
s AS (SELECT b, sum(n)::BIGINT AS n FROM r GROUP BY b),
f(b, shard, held) AS (SELECT b, 0, n FROM s WHERE b = 0 UNION ALL SELECT s.b, CASE WHEN f.held >= 300000 THEN f.shard + 1 ELSE f.shard END, CASE WHEN f.held >= 300000 THEN s.n ELSE f.held + s.n END FROM f JOIN s ON s.b = f.b + 1),
c AS (SELECT r.*, f.shard, (b - min(b) OVER (PARTITION BY f.shard))::INT AS rg, max(f.shard) OVER () AS last FROM r JOIN f USING (b))"""


def _sharded(spark, d) -> str:
    path = O.scratch(spark, "shards")
    O.write_shards(read(spark, d, "documents"), path, "doc_id", shard_chars=300_000, row_group=64)
    return path


@query(f"WITH {_SHARDS.strip()} SELECT DISTINCT shard::BIGINT AS pos, CASE WHEN shard = last THEN 'val' ELSE 'train' END AS split, printf('shard=%05d', shard) AS folder FROM c")
def src1_list_shards(spark, d):
    return I.shards(spark, _sharded(spark, d)).select(F.col("pos").cast("bigint").alias("pos"), "split", F.element_at(F.split("file", "/"), -2).alias("folder"))


@query(f"WITH {_SHARDS.strip()} SELECT doc_id, CASE WHEN shard = last THEN 'val' ELSE 'train' END AS split, rg, (k % 64)::BIGINT AS pos FROM c WHERE rg >= 1 AND (rg - 1) % 2 = 0")
def src2_row_groups(spark, d):
    path = _sharded(spark, d)
    plan = G.plan(spark, path)
    hashed = lambda df, s: df.select("file", "rg", "pos", F.md5(F.col("text").cast("binary")).alias("h"), F.lit(s).alias("split"))
    both = hashed(I.corpus(spark, path, "train", start=1, step=2, plan=plan), "train").unionByName(hashed(I.corpus(spark, path, "val", start=1, step=2, plan=plan), "val"))
    # texts that repeat are told apart by their order, which the shards keep
    at = lambda *o: F.row_number().over(Window.partitionBy("h").orderBy(*o))
    docs = read(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    every = hashed(G.scan(spark, plan), "")
    named = every.withColumn("n", at("file", "rg", "pos")).join(docs.withColumn("n", at("doc_id")), ["h", "n"]).select("doc_id", "file", "rg", "pos")
    return both.join(named, ["file", "rg", "pos"]).select("doc_id", "split", "rg", "pos")


@query(f"""
WITH {_SHARDS.strip()}, x AS (SELECT shard, rg, (k % 64)::BIGINT AS pos, substr(text, 1, 500) AS text, last FROM c),
y AS (SELECT *, sum(length(text)) OVER (ORDER BY shard, rg, pos ROWS UNBOUNDED PRECEDING) - length(text) AS prior FROM x WHERE shard <> last)
SELECT shard::INT AS shard, rg, pos, md5(text) AS h FROM y WHERE prior <= 100000""")
def lim5_early_stop(spark, d):
    """A scan of the train shards that stops at its budget of characters, each document cropped to 500."""
    got = I.early_stop(spark, _sharded(spark, d), 100_000, crop=500)
    return got.select(F.regexp_extract("file", r"shard=(\d+)", 1).cast("int").alias("shard"), "rg", "pos", F.md5(F.col("text").cast("binary")).alias("h"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n, min_by(role, turn) AS first FROM conversations GROUP BY conv_id)
SELECT conv_id AS _source_idx, copy AS _source, n::INT AS n FROM c, (VALUES ('once', 1), ('again', 2)) t(copy, i) WHERE NOT (copy = 'once' AND conv_id % 4 = 0)""")
def snk2_jsonl(spark, d):
    """Written, appended to, read back with a bad line skipped; rollouts that are done are left out."""
    path = O.scratch(spark, "rollouts")
    rows = _messages(spark, d).select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"), F.col("conv_id").alias("_source_idx"))
    O.write_jsonl(rows.withColumn("_source", F.lit("once")), path)
    O.write_jsonl(rows.withColumn("_source", F.lit("again")), path, append=True)
    spark.createDataFrame([('{"messages": [{"role"',)], "value string").write.mode("append").text(path)
    back = I.conversations(spark, path, mode="DROPMALFORMED")
    done = rows.filter("_source_idx % 4 = 0").select(F.lit("once").alias("_source"), "_source_idx")
    return R.not_done(back, done).select("_source_idx", "_source", F.size("messages").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, md5(text) AS h FROM documents")
def snk3_split_sink(spark, d):
    path = O.scratch(spark, "split")
    O.write_split(read(spark, d, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train").alias("split")), path)
    parts = [spark.read.schema("doc_id long, text string").json(f"{path}_{s}").withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("doc_id", "split", F.md5(F.col("text").cast("binary")).alias("h"))


@query("SELECT conv_id AS _source_idx, (count(*) + 1)::INT AS n FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant' AND coalesce(text, '') <> '')")
def src6_answered_preferences(spark, d):
    path = O.scratch(spark, "pairs")
    side = F.struct(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    O.write_jsonl(_messages(spark, d).select(side.alias("chosen"), side.alias("rejected"), F.col("conv_id").alias("_source_idx")), path)
    return I.preferences(spark, path, 1, 1.0, "Be brief.", answered=True).select("_source_idx", F.size("chosen").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS _source_idx FROM documents QUALIFY _source_idx < 300 AND _source_idx < round(count(*) OVER () * 0.4)")
def src7_instructions(spark, d):
    path = O.scratch(spark, "instructions")
    read(spark, d, "documents").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.parquet(path)
    every = I.instructions(spark, path)
    return I.percent_slice(every, 40).join(I.instructions(spark, path, 300).select(F.col("_source_idx").alias("i")), F.col("_source_idx") == F.col("i")).select("doc_id", "_source_idx")


@query("SELECT 's' || item_id AS id, text AS prompt, CASE WHEN item_id % 2 = 0 THEN 'note' END AS notes FROM benchmark")
def src10_scenarios(spark, d):
    path = O.scratch(spark, "scenarios")
    O.write_jsonl(read(spark, d, "benchmark").select(_text("s", "{item_id}").alias("id"), F.col("text").alias("prompt"), F.when(F.col("item_id") % 2 == 0, "note").alias("notes")), path)
    return I.scenarios(spark, path)


_YAML = """icl_tasks:
-
  label: one
  dataset_uri: a/b.jsonl
  num_fewshot: [10]
  icl_task_type: multiple_choice
  continuation_delimiter: "\\nAnswer: "
-
  label: two  # a comment
  dataset_uri: c.jsonl
  num_fewshot:
  - 3
  icl_task_type: language_modeling
"""


@query("SELECT 'one' AS label, 'multiple_choice' AS task_type, 'a/b.jsonl' AS dataset_uri, 10 AS num_fewshot, chr(10) || 'Answer: ' AS delimiter, 25.0::DOUBLE AS baseline UNION ALL SELECT 'two', 'language_modeling', 'c.jsonl', 3, ' ', 0.0")
def src11_bundle(spark, d):
    path = O.scratch(spark, "baselines")
    spark.createDataFrame([("one", "25"), ("two", "0.0")], "task string, b string").select(F.col("task").alias("Eval Task"), F.col("b").alias("Random baseline")).coalesce(1).write.option("header", True).csv(path)
    tasks = I.bundle_tasks(spark, _YAML.replace("-\n  label", "- label"))
    return E.with_baseline(tasks.withColumnRenamed("label", "task"), I.baselines(spark, path)).withColumnRenamed("task", "label")


@query("SELECT item_id, text AS query, ['yes', 'no'] AS choices, (item_id % 2)::INT AS gold FROM benchmark")
def src11_eval_items(spark, d):
    path = O.scratch(spark, "items")
    O.write_jsonl(read(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("|"), "text").alias("query"), F.array(F.lit("yes"), F.lit("no")).alias("choices"), F.pmod("item_id", F.lit(2)).cast("int").alias("gold")), path)
    got = I.eval_items(spark, path)
    return got.select(F.substring_index("query", "|", 1).cast("bigint").alias("item_id"), F.regexp_replace("query", r"^\d+\|", "").alias("query"), "choices", "gold")


@query("SELECT item_id AS log, n::INT AS line_no, 'line ' || n || ' of ' || item_id AS line FROM benchmark, range(3) t(n)")
def src12_log_lines(spark, d):
    path = O.scratch(spark, "logs")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda n: F.concat(F.lit("line "), n.cast("string"), F.lit(" of "), F.col("item_id").cast("string"))), "\n")
    read(spark, d, "benchmark").select("item_id", lines.alias("value")).repartition(8, "item_id").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    got = I.log_lines(spark, path).filter("line <> ''")
    return got.select(F.regexp_extract("line", r"of (\d+)$", 1).cast("bigint").alias("log"), F.regexp_extract("line", r"^line (\d+)", 1).cast("int").alias("line_no"), "line")


@query("SELECT item_id, 'é ' || replace(text, chr(10), ' ') AS line FROM benchmark")
def src15_blobs(spark, d):
    path = O.scratch(spark, "blobs")
    read(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("|é "), F.regexp_replace("text", "\n", " "))).repartition(5).write.option("compression", "gzip").text(path)
    lines = I.blobs(spark, path + "/*.gz").select(F.explode(F.split("content", "\n")).alias("x")).filter("x <> ''")
    return lines.select(F.substring_index("x", "|", 1).cast("bigint").alias("item_id"), F.regexp_replace("x", r"^\d+\|", "").alias("line"))


# ---- tokenizer and packing, where the texts that come back are known


@query("SELECT doc_id, md5(coalesce(text, '')) AS back, strlen(text)::BIGINT AS n_bytes FROM documents")
def tok5_decode(spark, d):
    """Texts encoded and decoded again; the bytes of their ids by the vocabulary's table."""
    t = tokenizer(spark, d)
    rows = K.decoded(K.encoded(_docs(spark, d), t), t).select("doc_id", "ids", F.md5(F.coalesce("decoded", F.lit("")).cast("binary")).alias("back"))
    each = rows.select("doc_id", F.explode("ids").alias("id")).join(F.broadcast(t.vocabulary(spark).select("id", "true_bytes")), "id")
    n = each.groupBy("doc_id").agg(F.sum("true_bytes").alias("n_bytes"))
    return rows.join(n, "doc_id", "left").select("doc_id", "back", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


_RENDERED = """
m AS (SELECT conv_id, list(struct_pack(r := role, t := coalesce(text, '')) ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
g AS (SELECT conv_id, CASE WHEN l[1].r = 'system' THEN [struct_pack(r := 'user', t := l[1].t || chr(10) || chr(10) || l[2].t)] || l[3:] ELSE l END AS l FROM m WHERE l[1].r <> 'system' OR (len(l) > 1 AND l[2].r = 'user')),
p AS (SELECT conv_id, l, [CASE x.r WHEN 'user' THEN '<|user_start|>' || x.t || '<|user_end|>' ELSE '<|assistant_start|>' || x.t || '<|assistant_end|>' END FOR x IN l] AS s FROM g)"""


def _renderable(spark, d):
    m = F.col("messages")
    return _messages(spark, d).filter((m[0]["role"] != "system") | F.get(m, F.lit(1))["role"].eqNullSafe(F.lit("user")))


@query(f"WITH {_RENDERED.strip()} SELECT conv_id, '<|bos|>' || array_to_string(s, '') AS back FROM p")
def tok6_rendered_text(spark, d):
    t = tokenizer(spark, d)
    return K.decoded(K.rendered(_renderable(spark, d), t, max_tokens=None), t).select("conv_id", F.col("decoded").alias("back"))


@query(f"WITH {_RENDERED.strip()} SELECT conv_id, '<|bos|>' || array_to_string(s[:len(s) - 1], '') || '<|assistant_start|>' AS back FROM p WHERE l[len(l)].r = 'assistant'")
def tok7_completion_text(spark, d):
    t = tokenizer(spark, d)
    rows = _renderable(spark, d).filter(F.element_at("messages", -1)["role"] == "assistant")
    return K.decoded(K.rendered(rows, t, max_tokens=None, completion=True), t).select("conv_id", F.col("decoded").alias("back"))


@query("SELECT name, row_number() OVER () - 1 AS place FROM (VALUES " + ", ".join(f"('{x}')" for x in K.SPECIAL_TOKENS) + ") t(name)")
def tok4_special_ids(spark, d):
    t = tokenizer(spark, d)
    return t.vocabulary(spark).filter("is_special").select(F.col("bytes").cast("string").alias("name"), (F.col("id") - t.bos).cast("bigint").alias("place"))


@query("""
WITH v AS (SELECT l_orderkey AS k, list((l_suppkey % 50)::INT ORDER BY l_linenumber, l_suppkey) AS l FROM lineitem GROUP BY ALL),
s AS (SELECT k, l[1:6] AS l FROM v WHERE k < 200)
SELECT k AS pos, l[1:len(l) - 1] || [9 FOR i IN range(5 - len(l) + 1)] AS inputs, l[2:] || [-1 FOR i IN range(5 - len(l) + 1)] AS targets FROM s""")
def pck4_fixed_batch(spark, d):
    each = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: (x["l_suppkey"] % 50).cast("int"))
    v = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pos")).agg(each.alias("ids"))
    return P.fixed_batch(v.withColumn("mask", F.array_repeat(F.lit(1), F.size("ids"))), 200, 5, 9)


@query("SELECT doc_id % 2 AS rank, doc_id // 2 AS row_id, doc_id // 2 // 6 AS step, (doc_id % 2) * 3 + doc_id // 2 % 6 // 2 AS device FROM documents")
def pck6_global_rows(spark, d):
    rows = read(spark, d, "documents").select(F.pmod("doc_id", F.lit(2)).alias("rank"), F.floor(F.col("doc_id") / 2).alias("row_id"))
    return P.global_rows(rows, 2, 3, 2)


@query("SELECT doc_id % 8 AS rank, least(sum(1 + strlen(text))::BIGINT, 1000000000) > 0 AS some FROM documents GROUP BY 1")
def pck1_ranks(spark, d):
    """Each rank fills rows of exactly the capacity, from tokens of its own documents alone, as whole pieces of them."""
    t = tokenizer(spark, d)
    docs = K.encoded(read(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text"), t, prepend="<|bos|>").select("pos", "ids")
    held = docs.groupBy(F.pmod("pos", F.lit(8)).alias("rank")).agg(F.sum(F.size("ids")).alias("n"))
    used = P.packed_rows(docs, 65, world=8).groupBy(F.col("rank").cast("bigint").alias("rank")).agg(F.sum(F.size("tokens")).alias("used"), F.min(F.size("tokens")).alias("least"), F.max(F.size("tokens")).alias("most"))
    return held.join(used, "rank", "left").select("rank", (F.col("used").isNull() | ((F.col("least") == 65) & (F.col("most") == 65) & (F.col("used") <= F.col("n")))).alias("some"))


_PACKED = """
d AS (SELECT doc_id % 4 AS rank, length(text) + 1 AS n FROM documents)
SELECT rank::INT AS rank, count(*) AS n_docs, sum(n)::BIGINT AS n_ids, 0::BIGINT AS broken, 0::BIGINT AS short_rows FROM d GROUP BY rank"""


def _kept(rows, docs, capacity):
    """By rank: documents and ids, counted from the rows' pieces, what they crop and what is in no row; pieces that are
    not the head of their document, and rows of another length."""
    at = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.aggregate(F.slice("pieces", 1, i - 1), F.lit(0), lambda n, p: n + p["taken"]))
    each = rows.withColumn("p_", F.explode(F.arrays_zip("pieces", at.alias("at"))))
    each = each.select("rank", F.col("p_.pieces.pos").alias("pos"), F.col("p_.pieces.length").alias("length"), F.md5(F.to_json(F.slice("tokens", F.col("p_.at") + 1, F.col("p_.pieces.taken"))).cast("binary")).alias("h"), F.col("p_.pieces.taken").alias("taken"))
    met = P.loosened(P.pressed(docs, "ids").join(each.withColumnRenamed("rank", "of_rank"), "pos", "full"), "ids")
    head = F.md5(F.to_json(F.slice("ids", 1, F.col("taken"))).cast("binary"))
    met = met.groupBy(F.coalesce("of_rank", F.pmod("pos", F.lit(4)).cast("int")).alias("rank")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("length", F.size("ids"))).alias("n_ids"), F.count_if(F.col("h").isNotNull() & ~F.col("h").eqNullSafe(head)).alias("broken"))
    short = rows.groupBy("rank").agg(F.count_if(F.size("tokens") != capacity).alias("short"))
    return met.join(short, "rank", "left").select("rank", "n_docs", "n_ids", "broken", F.coalesce("short", F.lit(0)).alias("short_rows"))


def _lettered(spark, d):
    """pos and ids of documents: 1, and the code points of the text."""
    points = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), F.ascii)
    return read(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.array(F.lit(1)), points).alias("ids"))


@query(f"WITH {_PACKED.strip()}")
def pck1_pieces(spark, d):
    """Every document is in one row of its rank at most, by its head; what is in rows, cropped and left is all there is."""
    docs = _lettered(spark, d)
    return _kept(P.packed_rows(docs, 2048, world=4, pieces=True), docs, 2048)


@query(f"WITH {_PACKED.strip()}")
def pck2_pieces(spark, d):
    docs = _lettered(spark, d)
    rows = P.padded_rows(docs.withColumn("mask", F.transform("ids", lambda x: F.lit(1))), 4096, 0, world=4, pieces=True)
    return _kept(rows, docs, 4096)


# ---- streams


@query("SELECT item_id, e::INT AS epoch FROM benchmark, range(3) t(e)")
def stm1_epochs(spark, d):
    return P.epochs(read(spark, d, "benchmark").select("item_id"), 3).select("item_id", "epoch")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY event_type")
def stm4_resumable_append(spark, d):
    """Appended in one run, and again in another that finds all keys there."""
    source, out = O.scratch(spark, "stream"), O.scratch(spark, "appended")
    events = read(spark, d, "events").select("event_id", "event_type")
    events.repartition(3).write.parquet(source)
    for run in range(2):
        stream = T.documents(spark, source, events.schema, 1)
        T.resumable_append(stream, lambda b: b.filter("event_id % 3 <> 0"), out, O.scratch(spark, f"run{run}"), ["event_id"]).awaitTermination()
    return T.appended(spark, out, events.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
k AS (SELECT *, pos % 4 AS rank, pos // 4 // 2 AS row_id, pos // 4 % 2 AS odd FROM p)
SELECT rank::INT AS rank, row_id, min(doc_id) FILTER (odd = 1) AS first, min(doc_id) FILTER (odd = 0) AS second FROM k GROUP BY ALL HAVING count(*) = 2""")
def stm2_packed_stream(spark, d):
    """Documents of three and of five ids by turns, in rows of eight: five and three of them, each in its order. The
    stream comes in four parts, each a run of its own from the checkpoint, and one that ends the ranks."""
    source, out, checkpoint = O.scratch(spark, "stream"), O.scratch(spark, "packed"), O.scratch(spark, "packing")
    docs = Z.running_sum(read(spark, d, "documents").select("doc_id"), "doc_id", F.lit(1), "pos", inclusive=False)
    five = F.pmod(F.floor(F.col("pos") / 4), F.lit(2)) == 1
    rows = docs.select("pos", F.array_repeat(F.col("doc_id").cast("int"), F.when(five, 5).otherwise(3)).alias("ids"), F.lit(False).alias("last"))
    n = docs.count()
    ends = spark.range(4).select(F.col("id").alias("pos"), F.lit(None).cast("array<int>").alias("ids"), F.lit(True).alias("last"))
    for k in range(5):
        part = rows.filter((F.col("pos") >= k * n // 4) & (F.col("pos") < (k + 1) * n // 4)) if k < 4 else ends
        part.write.mode("append").parquet(source)
        stream = T.packed(T.documents(spark, source, "pos long, ids array<int>, last boolean", 1000), 8, end="last")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("rank", "row_id", F.col("tokens")[0].cast("bigint").alias("first"), F.col("tokens")[5].cast("bigint").alias("second"))


_ENDLESS = """
a AS (SELECT 0 AS source, b, n, c, count(*) OVER () AS groups FROM (SELECT b, count(*) AS n, sum(length(text))::BIGINT AS c FROM (SELECT text, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b FROM documents) GROUP BY b)),
p AS (SELECT 1 AS source, b, n, c, count(*) OVER () AS groups FROM (SELECT b, count(*) AS n, sum(length(html))::BIGINT AS c FROM (SELECT html, (row_number() OVER (ORDER BY page_id) - 1) // 16 AS b FROM pages) GROUP BY b)),
g AS (FROM a UNION ALL FROM p),
s AS (SELECT step, (('0x' || substr(md5('e:' || step), 1, 8))::BIGINT::DOUBLE / 4294967296.0 < 0.3)::INT AS source FROM range((SELECT 4 * max(groups) FROM a)) t(step)),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS k FROM s),
e AS (SELECT k.step, k.source, k // m.groups AS epoch, k % m.groups AS x, m.groups AS m FROM k JOIN (SELECT DISTINCT source, groups FROM g) m USING (source)),
h AS (SELECT *, ('0x' || substr(md5('e:' || epoch || ':a'), 1, 8))::BIGINT % m AS a0, ('0x' || substr(md5('e:' || epoch || ':b'), 1, 8))::BIGINT AS b0 FROM e),
o AS (SELECT *, ([y FOR y IN range(greatest(a0, 1), greatest(a0, 1) + m + 1) IF gcd(y, m) = 1][1] * x + b0) % m AS at FROM h)
SELECT o.step, o.source::INT AS source, o.epoch, g.n, g.c AS n_chars FROM o JOIN g ON g.source = o.source AND g.b = o.at"""


@query(f"WITH {_ENDLESS.strip()}")
def stm1_endless_mix(spark, d):
    """Four epochs of documents in row groups of 64, mixed with pages in row groups of 16, each epoch in an order of its
    own; the stream is stopped three times and goes on from its checkpoint."""
    plans = []
    for table, key, text, rows in (("documents", "doc_id", "text", 64), ("pages", "page_id", "html", 16)):
        path = O.scratch(spark, table)
        O.write_shards(read(spark, d, table).select(key, F.col(text).alias("text")), path, key, shard_chars=1, row_group=rows)
        plans.append(G.plan(spark, path))
    n = 4 * G.chosen(spark, plans[0]).count()
    out, checkpoint = O.scratch(spark, "mixed"), O.scratch(spark, "mixing")
    for _ in range(4):
        stream = X.texts(X.steps(spark, plans, 0.3, "e", True, per_trigger=-(-n // 4), last=n))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("step", "source", "epoch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))
