"""Conversations, rollouts, sampling, tokenizer, packing, evaluation and logs on hand-made inputs."""

import difflib
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.operators import conversations as C
from lodestone.operators import evals as E
from lodestone.operators import logs as L
from lodestone.operators import packing as P
from lodestone.operators import rollouts as R
from lodestone.operators import sampling as Z
from lodestone.operators import tokenizer as K
from pyspark.sql import functions as F

EDIT = ("Edit", [("file_path", "a.py"), ("old_string", "x"), ("new_string", "y")])
GOOD = [("user", "please", None), ("assistant", "ok", EDIT), ("tool_result", "    1→y", None), ("assistant", "done", None)]


def frame(spark, *conversations):
    return spark.createDataFrame(list(enumerate(conversations)), f"i int, messages {C.MESSAGES}").orderBy("i")


def problems(spark, rule, *conversations):
    return [r[0] for r in frame(spark, *conversations).select(rule(F.col("messages"))).collect()]


def swapped(at, message):
    return [*GOOD[:at], message, *GOOD[at + 1 :]]


def test_short_rules(spark):
    cases = {
        "": GOOD,
        "no messages": [],
        "first message not from user": GOOD[1:],
        "tool_call at end without tool_result": GOOD[:2],
        "tool_call not followed by tool_result": [GOOD[0], GOOD[1], GOOD[3]],
        "line prefix wrong length: 4": swapped(2, ("tool_result", "   1→y\n  2→z", None)),
        "Edit old_string contains line numbers": swapped(1, ("assistant", "", ("Edit", [("old_string", "1→x"), ("new_string", "")]))),
        "Edit new_string contains line numbers": swapped(1, ("assistant", "", ("Edit", [("new_string", "1→x")]))),
    }
    for want, got in zip(cases, problems(spark, C.short_problems, *cases.values()), strict=True):
        assert got == ([want] if want else [])


def test_long_rules(spark):
    call = ("assistant", "", ("Read", [("file_path", "a")]))
    result = ("tool_result", "    1→a", None)
    cases = [
        (GOOD, []),
        ([], ["No messages"]),
        ([("user", "hi", None)], ["No assistant message"]),
        ([("user", "Scenario: x", None), ("assistant", "hm", None)], ["User content contains 'scenario:'"]),
        ([("user", "x", None), ("assistant", "let me know  if so?", None)], ["Assistant soliciting new work at turn 1", "Assistant asked question in final turn", "Assistant offering follow-up in final turn"]),
        ([GOOD[0], call, ("tool_result", "rejected: no", None)], ["Rejection at end without user follow-up", "Rejection at end without user follow-up"]),
        ([GOOD[0], call, ("tool_result", "error: x", None), GOOD[0], GOOD[3]], ["Error followed by user instead of assistant"]),
        ([GOOD[0], call, result, GOOD[0], GOOD[3]], ["Success not followed by assistant"]),
        ([GOOD[0], call, ("tool_result", "    2→a\n    1→b", None), GOOD[3]], ["Line numbers not sequential: 2 -> 1"]),
        ([GOOD[0], call, ("tool_result", "oops → b", None), GOOD[3]], ["Malformed line with →: 'oops → b'"]),
        ([GOOD[0], call, ("tool_result", "EXACTLY", None), GOOD[3]], ["Format description leaked into tool_result"]),
        ([GOOD[0], call, result, call, result, call, result, GOOD[3]], ["Agent made same tool call 3+ times in a row"]),
        ([GOOD[0], ("assistant", "", ("Edit", [("pattern", "x")])), result, GOOD[3]], ["Edit tool call contains invalid 'pattern' arg", "Edit tool call missing required 'new_string'"]),
        ([GOOD[0], call, GOOD[3]], ["tool_call not followed by tool_result (got assistant)"]),
        # the message before the first is the last one
        ([("tool_result", "x", None), ("assistant", "a", None), ("user", "b", None)], ["Tool result must always be preceded by an assistant tool call.", "First message not from user"]),
    ]
    for (_, want), got in zip(cases, problems(spark, C.long_problems, *[c for c, _ in cases]), strict=True):
        assert got == want
    keys = F.array(F.lit("messages"), F.lit("extra"))
    assert frame(spark, GOOD).select(C.long_problems(F.col("messages"), keys)).first()[0] == ["Unexpected top-level key: extra"]


def test_restyle(spark):
    m = F.col("messages")
    new = C.replace_answers(m, F.array(F.lit("fine"), F.lit("bye")))
    row = frame(spark, GOOD).select(new.alias("n"), C.restyle_problems(m, new).alias("p"), C.restyle_problems(m, F.slice(m, 1, 3)).alias("q")).first()
    assert [x["content"] for x in row["n"]] == ["please", "fine", "    1→y", "bye"] and row["p"] == [] and row["q"] == ["message count changed: 4 -> 3"]


def test_system_and_completion(spark):
    df = frame(spark, [("system", "be kind", None), *GOOD])
    row = df.select(C.merge_system(F.col("messages")).alias("m"), C.without_last_answer(F.col("messages")).alias("w")).first()
    assert row["m"][0]["content"] == "be kind\n\nplease" and len(row["m"]) == 4 and len(row["w"]) == 4
    with pytest.raises(Exception, match="must be followed by a user"):
        frame(spark, [("system", "x", None), ("assistant", "y", None)]).select(C.merge_system(F.col("messages"))).collect()


CODE = "def add(a, b):\n    return a + b\n\nprint(add(1, 2))"


def test_rollouts(spark):
    chats = spark.createDataFrame([(0, [("user", "write add", None), ("assistant", f"Sure\n```python\n{CODE}\n```\nBye", None)]), (1, [("user", "x", None), ("assistant", "nothing", None)]), (2, [("user", "bad", None), ("assistant", "```\nthis is not python at all !!\n```", None)])], f"_source_idx int, messages {C.MESSAGES}")
    (r,) = R.from_chats(chats, "chat").collect()
    assert [m["role"] for m in r["messages"]] == ["user", "assistant", "tool_result", "assistant"] and r["messages"][1]["content"] == "sure"
    assert [tuple(a) for a in r["messages"][1]["tool_call"]["args"]] == [("file_path", "add.py"), ("new_string", CODE)]
    pairs = spark.createDataFrame([(5, "do", f"```\n{CODE}\n```"), (6, "", "x")], "_source_idx int, instruction string, response string")
    assert R.from_pairs(pairs, "p").select("_source_idx").collect()[0][0] == 5
    assert R.outcomes(R.from_pairs(pairs, "p")).first()["outcome"] == "valid"


def test_evolved(spark):
    body = "\n".join(f"line_{i} = {i}" for i in range(30))
    rows = [
        (0, f"fix\n```python\n{body}\n```", f"```python\n{body.replace('line_7 = 7', 'line_7 = 70')}\n```"),
        (1, f"fix\n```python\n{body}\n```", f"```python\n{body}\n```"),
        (2, "write it", f"```python\n{CODE}\n```"),
        (3, "é" * 40, "x"),
        (4, "write it", "no code"),
        (5, "write it", "```\nnot ( python at all\n```"),
        (6, None, "x"),
        (7, "two", f"```\n{CODE}\n```\nand\n```\ny = 2\n```"),
    ]
    df = spark.createDataFrame(rows, "_source_idx int, instruction string, output string")
    got = {r["_source_idx"]: r["outcome"] for r in R.evolved(df).collect()}
    assert got == {0: "code_both", 1: "identical", 2: "code_out_only", 3: "not_english", 4: "no_code_out", 5: "not_python_out", 6: "empty", 7: "code_out_only"}
    r = R.from_evolved(df, "e").filter("_source_idx = 0").withColumn("steps", R.add_search_steps(F.col("messages"), F.col("_original_code"), F.col("_source_idx"))).first()
    edit = dict(map(tuple, r["messages"][1]["tool_call"]["args"]))
    assert body.count(edit["old_string"]) == 1 and body.replace(edit["old_string"], edit["new_string"]) == body.replace("line_7 = 7", "line_7 = 70")
    assert [m["tool_call"]["name"] for m in r["steps"] if m["tool_call"]] == ["Read", "Edit"]  # nothing to grep for


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=25), st.lists(st.sampled_from("abcdef"), min_size=1, max_size=25))
def test_edit_pair_applies(a, b):
    a, b = "\n".join(a), "\n".join(b)
    old, new = R.edit_pair(a, b, compat=False)
    if old is not None:
        assert a.count(old) == 1 and a.replace(old, new) == b
    else:
        assert new == b
    assert difflib is not None


def test_attempts(spark):
    rows = [(1, 0, False, "tokenization"), (1, 1, False, "rules"), (1, 2, True, None), (1, 3, False, "late"), (2, 0, False, "rules"), (3, 0, True, None)]
    got = {r["id"]: (r["chosen_at"], r["rejected_at"], r["attempts"]) for r in R.resolve_attempts(spark.createDataFrame(rows, "id int, attempt int, passed boolean, kind string")).collect()}
    assert got == {1: (2, 1, 3), 2: (None, 0, 1), 3: (0, None, 1)}


def test_running_sums(spark):
    df = spark.range(0, 997).withColumn("v", F.col("id") % 7)
    got = Z.running_sum(df, "id", F.col("v"), "s").orderBy("id").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total
    assert Z.running_sum(df.limit(0), "id", F.col("v"), "s").count() == 0


def test_shuffle_is_a_permutation(spark):
    got = Z.shuffled(spark.range(500), 3, "id").collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 501)) and [r["id"] for r in sorted(got, key=lambda r: r["pos"])] != list(range(500))


def test_model_callable(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert {r["answer"] for r in R.with_model(df, lambda prompts: [p.upper() for p in prompts]).collect()} == {"A", "B"}


# ---- tokenizer


def test_merges_take_the_most_frequent_pair():
    assert K.learn_merges({b"abab": 5, b"ab": 1, b"bc": 3}, 2) == [(b"a", b"b"), (b"ab", b"ab")]
    assert K.learn_merges({b"aaaa": 1}, 3) == [(b"a", b"a"), (b"aa", b"aa")]


@pytest.mark.parametrize("named", [2, 512])
def test_merges_on_executors_are_those_of_the_driver(spark, monkeypatch, named):
    monkeypatch.setattr(K, "NAMED", named)
    rng = random.Random(5)
    for letters in ("ab", "abcde", "abcdefghijklmnopé"):
        words = {"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(80)}
        counts = {w: rng.randint(1, 6) for w in sorted(words)}
        df = spark.createDataFrame([*counts.items(), ("", 3)], "chunk string, n long")
        assert K.learn_merges_apart(df, 150) == K.learn_merges({w.encode(): n for w, n in counts.items()}, 150)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_merges_on_executors_are_those_of_the_driver_for_documents(spark):
    counts = K.chunk_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    local = {r["chunk"].encode(): r["n"] for r in counts.collect() if r["chunk"]}
    assert len(local) > 20_000 and K.learn_merges_apart(counts, 2000) == K.learn_merges(local, 2000)


def test_training_beyond_the_bound_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(K, "DRIVER_PIECES", 3)
    docs = spark.createDataFrame([("one two three four five six seven",), ("one three five",)], "text string")
    monkeypatch.setattr(K, "learn_merges", None)
    assert b" three" in K.train(docs, 300).ranks


def test_encoded_documents_may_be_empty_or_long_blanks(spark, tmp_path):
    """A text without tokens has no ratio, and a run of blanks beyond tiktoken's stack is one piece like any other."""
    from lodestone.plans.queries import QUERIES

    run = " " * 1_200_000
    rows = [(i, f"some words {i} here") for i in range(20)] + [(20, ""), (21, None), (22, run + "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_tokens"], r["ratio"]) for r in QUERIES["tok3_encode"](spark, str(tmp_path)).collect()}
    assert got[20] == (1, None) and got[21] == (None, None) and len(got) == 23
    assert all(got[i][1] == round(len(t.encode()) / (got[i][0] - 1), 6) for i, t in rows if t)

    t = K.Tokenizer({bytes([i]): i for i in range(256)} | {b" " * 2**k: 255 + k for k in range(1, 12)})
    for text in (run + "x", "a\n" + run, f"x.{run}\n{run} \u00e9"):
        assert t.decode(t.encode(text)) == text
    short = "it's  1234 a\n\n \t b\u3000c   "
    assert [i for p in K.split_python(short) for i in t.encoding._encode_single_piece(p)] == t.encode(short)
    assert t.encode("a\ud800b") == t.encode("a\ufffdb")


def test_registered_tokenizer_learns_from_documents(spark, tmp_path):
    from lodestone.plans.queries import QUERIES

    spark.createDataFrame([(1, "zyxwv " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "qqqq " * 9)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    learned = {bytes(r["bytes"]) for r in QUERIES["tok2_train"](spark, str(tmp_path)).collect()}
    assert b" zyxwv" in learned and b"qq" not in learned


@pytest.fixture(scope="module")
def tok(spark):
    return K.train(spark.createDataFrame([("hello world, hello there " * 4,), ("it's 1234 ok",), (None,)], "text string"), 300)


def test_round_trip_and_vocabulary(spark, tok):
    text = "hello world! it's 56 é🙂 <|bos|>"
    assert tok.decode(tok.encode(text)) == text and tok.bos not in tok.encode(text)
    v = {r["id"]: r for r in tok.vocabulary(spark).collect()}
    assert len(v) == tok.size <= 300 and v[tok.bos]["n_bytes"] == 0 and v[0xC3]["n_bytes"] == 3 and v[0xC3]["true_bytes"] == 1
    df = K.encoded(spark.createDataFrame([(text,), (None,), ("",)], "text string"), tok, prepend="<|bos|>", append="<|user_end|>")
    ids = [r["ids"] for r in df.collect()]
    assert ids[0] == [tok.bos, *tok.encode(text), tok.special["<|user_end|>"]] and ids[1] is None and len(ids[2]) == 2
    assert K.decoded(df, tok).collect()[0]["decoded"].startswith("<|bos|>hello")
    with pytest.raises(ValueError, match="256"):
        K.train(spark.createDataFrame([("a",)], "text string"), 200)


def test_render(spark, tok):
    sp = tok.special
    df = frame(spark, GOOD, [("robot", "x", None)], GOOD)
    got = K.rendered(df, tok, max_tokens=None).collect()
    want = [(tok.bos, 0)]
    plain = lambda t, m: [(i, m) for i in tok.encode(t)]
    want += [(sp["<|user_start|>"], 0), *plain("please", 0), (sp["<|user_end|>"], 0), (sp["<|assistant_start|>"], 0), *plain("ok", 1), (sp["<|tool_call_start|>"], 1), *plain("Edit", 1)]
    for k, v in EDIT[1]:
        want += [(sp["<|tool_arg|>"], 1), *plain(k, 1), (sp["<|tool_val|>"], 1), *plain(v, 1)]
    want += [(sp["<|tool_call_end|>"], 1), (sp["<|assistant_end|>"], 1), (sp["<|tool_result_start|>"], 0), *plain("    1→y", 0), (sp["<|tool_result_end|>"], 0), (sp["<|assistant_start|>"], 0), *plain("done", 1), (sp["<|assistant_end|>"], 1)]
    assert list(zip(got[0]["ids"], got[0]["mask"], strict=True)) == want and got[1]["ids"] is None
    (short,) = K.rendered(frame(spark, GOOD), tok, max_tokens=5).collect()
    assert short["ids"] == got[0]["ids"][:5]
    (done,) = K.rendered(frame(spark, GOOD), tok, completion=True).collect()
    assert done["ids"][-1] == sp["<|assistant_start|>"] and done["ids"][:-1] == got[0]["ids"][: len(done["ids"]) - 1]


# ---- packing


def test_registered_packer_holds_the_default_buffer(spark, monkeypatch):
    from lodestone.plans import queries

    held = []
    monkeypatch.setattr(P, "pack_cropped", lambda docs, capacity, buffer=1000, finish=True: held.append(buffer) or iter(()))
    monkeypatch.setattr(P, "_kernel", lambda df, pos, world, columns, schema, of: list(of(iter(()))))
    monkeypatch.setattr(queries.K, "encoded", lambda df, *a, **k: df.withColumnRenamed("text", "ids"))
    monkeypatch.setattr(queries, "tokenizer", lambda spark, d: None)
    monkeypatch.setattr(queries, "read", lambda spark, d, name: spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    queries.QUERIES["pck1_packed_rows"](spark, "")
    assert held == [1000]


def slow_crop(docs, capacity, buffer):
    docs, wait, rows = list(docs), [], []
    while True:
        row = []
        while len(row) < capacity:
            while docs and len(wait) < buffer:
                wait.append(docs.pop(0))
            if not wait:
                return rows
            room = capacity - len(row)
            fits = [i for i, d in enumerate(wait) if len(d) <= room]
            i = max(fits, key=lambda i: (len(wait[i]), -i)) if fits else min(range(len(wait)), key=lambda i: (len(wait[i]), i))
            row += wait.pop(i)[:room]
        rows.append(row)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 14), max_size=40), st.integers(1, 8), st.integers(2, 10))
def test_crop_packer(lengths, buffer, capacity):
    docs = [[i] * n for i, n in enumerate(lengths)]
    assert list(P.pack_cropped(docs, capacity, buffer)) == slow_crop(docs, capacity, buffer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=40), st.integers(1, 8))
def test_padded_packer_keeps_everything(lengths, buffer):
    rows = list(P.pack_padded([([i + 1] * n, [1] * n) for i, n in enumerate(lengths)], 9, 0, buffer))
    assert all(len(i) == len(m) == 9 for i, m in rows)
    assert sorted(x for i, m in rows for x, k in zip(i, m, strict=True) if k) == sorted(i + 1 for i, n in enumerate(lengths) for _ in range(n))


def test_packed_rows_by_rank(spark):
    df = spark.range(0, 60).select(F.col("id").alias("pos"), F.array_repeat(F.col("id").cast("int"), (F.col("id") % 9 + 1).cast("int")).alias("ids"))
    got = P.packed_rows(df, 12, world=3, buffer=5).collect()
    for rank in range(3):
        want = slow_crop([[i] * (i % 9 + 1) for i in range(rank, 60, 3)], 12, 5)
        assert [r["tokens"] for r in sorted((r for r in got if r["rank"] == rank), key=lambda r: r["row_id"])] == want
    assert P.utilisation(P.packed_rows(df, 12, world=3, buffer=5), 12).first()["used"] == 1.0


# ---- evaluation and logs


def test_prompts(spark):
    item = spark.createDataFrame([("q?", ["a", "b"], 1, ["c1", "c2"], "end", " ctx ")], "query string, choices array<string>, gold int, context_options array<string>, continuation string, context string")
    df = item.select(F.struct("*").alias("item"), F.array(F.struct("*")).alias("shots"))
    r = df.select(E.choice_prompts(F.col("item"), " ", F.col("shots")), E.schema_prompts(F.col("item"), " ", F.col("shots")), E.lm_prompts(F.col("item"), " ", F.col("shots"))).first()
    assert r[0] == ["q? b\nq? a", "q? b\nq? b"] and r[1] == ["c2 end\nc1 end", "c2 end\nc2 end"] and r[2] == ["ctx end\nctx", "ctx end\nctx end"]


def test_few_shot_leaves_out_the_item(spark):
    items = spark.createDataFrame([("t", i, f"q{i % 6}") for i in range(8)], "task string, pos long, query string")
    for r in E.few_shot(items, 3).collect():
        assert len(r["shots"]) == 3 and r["index"] == r["pos"] % 6 and r["index"] not in [s["pos"] for s in r["shots"]]


LOG = ["  batch_size: 4", "World size: 2", "\tfwe_bpb: 1.5 | sv2_bpb: 2.5 | avg_bpb: 2.0", "Step: 1/9 | Loss: 3.25 | dt: 1 | tkps: 100 | mfu: 40.5", "\t<|bos|>first", "more", "Step: 2/9 | Loss: 3.0 | dt: 1 | tkps: 120 | mfu: 41", "\tPeak bytes reserved/limit: 1.5/16.0", "\t<|bos|>second ", "", "\t<|bos|>third", "Evaluating: x", "tail", "Total training time: 12.5min"]


def test_logs(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(LOG)], "log string, line_no int, line string")
    got = {(r["series"], r["name"], r["step"]): r["value"] for r in L.metrics(df).collect()}
    assert got[("base_bpb", "sv2_bpb", 0)] == 2.5 and got[("train", "tkps", 2)] == 120 and got[("memory", "memory (GB)", 2)] == 1.5
    assert [r["text"] for r in L.generations(df).orderBy("n").collect()] == ["<|bos|>second\n", "<|bos|>third"]
    r = L.scalars(df).first()
    assert r["training_minutes"] == 12.5 and r["tokens_per_step"] is None
    s = {r["name"]: (r["first_value"], r["last_value"]) for r in L.summary(L.metrics(df, "train")).collect()}
    assert s["loss"] == (3.25, 3.0)
    assert "| train | tkps | 100 | 120 |" in [r["line"] for r in L.report(L.metrics(df)).collect()]


def test_eval_csv(spark):
    scores = spark.createDataFrame([("t", 0.5, 0.25)], "task string, accuracy double, centered double")
    lines = L.format_eval_csv(scores).orderBy("part")
    got = L.parse_eval_csv(lines).collect()
    assert [(r["task"], r["accuracy"], r["centered"]) for r in got] == [("t", 0.5, 0.25), ("CORE", None, 0.25)]
