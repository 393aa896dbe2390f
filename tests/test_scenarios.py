"""Scenario batches, request texts, judged and restyled attempts."""

import json

from lodestone.functions import json as J
from lodestone.operators import conversations as C
from lodestone.operators import packing as P
from lodestone.operators import rollouts as R
from lodestone.operators import scenarios as X
from pyspark.sql import functions as F

TALK = [("user", "hi", None), ("assistant", "Hello", None)]


def test_batches_are_samples(spark):
    rows = X.batches(spark, 20, list("abcdefgh"), list("stuvwxyz"), ["", "hard"], k=5).collect()
    assert all(len(set(r["tasks"])) == 5 and len(set(r["domains"])) == 5 for r in rows) and {r["notes"] for r in rows} == {"", "hard"}
    assert rows == X.batches(spark, 20, list("abcdefgh"), list("stuvwxyz"), ["", "hard"], k=5).collect()


def test_collected_and_stamped(spark):
    df = spark.createDataFrame([(3, "n", json.dumps({"scenarios": [{"id": 1, "prompt": "p"}, {"id": "x", "prompt": "q"}]})), (4, "", "broken")], "batch int, notes string, answer string")
    got = X.collected(df)
    assert sorted(r[:] for r in got.collect()) == [("b3_1", "p", "n"), ("b3_x", "q", "n")]
    (r,) = X.stamped(spark.createDataFrame([("b3_1", TALK)], f"id string, messages {C.MESSAGES}"), got).collect()
    assert r["_scenario_prompt"] == "p" and r["_generator_prompt"].endswith("request should be: 'p'. The following complexity should also be introduced when relevant: 'n'")


def test_answer_shapes(spark):
    cases = [('["a", "b"]', 2), ('"one"', 1), ('{"assistant_contents": ["c"]}', 1), ("just text", 1), ("just text", 2), ("[broken", 1), ("'quoted'", 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, n int")
    assert [r[0] for r in df.orderBy("i").select(J.answer_contents(F.col("a"), F.col("n"))).collect()] == [["a", "b"], ["one"], ["c"], ["just text"], None, None, ["quoted"]]


def test_keys_and_defaults(spark):
    df = spark.createDataFrame([('{"a": null}',), ("{}",), (None,)], "j string")
    assert [r[0] for r in df.select(J.has_key(F.col("j"), "a")).collect()] == [True, False, False]
    assert df.select(J.field(F.col("j"), "$.a", F.lit("d"))).first()[0] == "d"


def test_restyle_attempts(spark):
    rows = [(1, 0, TALK, "[broken", 10), (1, 1, TALK, '["a", "b"]', 10), (1, 2, TALK, '["hey"]', 5), (1, 3, TALK, '["hey"]', 9), (2, 0, TALK, '["x"]', None)]
    got = X.restyled(spark.createDataFrame(rows, f"id int, attempt int, messages {C.MESSAGES}, answer string, rating int"))
    assert [r["kind"] for r in got.orderBy("id", "attempt").collect()] == ["json_error", "wrong_count", "critique_score", None, "critique_score"]
    (p,) = X.preference_pairs(got).collect()
    assert p["id"] == 1 and p["chosen"][1]["content"] == "hey" and p["rejected"][1]["content"] == "Hello"
    s = X.attempt_statistics(R.resolve_attempts(got)).first()
    assert (s["kept"], s["failed"], s["mean_attempts"]) == (1, 1, 2.5)


def test_judged(spark):
    rows = [(TALK, 10, 9), (TALK, 5000, 9), (TALK, None, 9), (TALK[1:], 10, 9), (TALK, 10, 8)]
    got = X.judged(spark.createDataFrame(rows, f"messages {C.MESSAGES}, n_tokens int, rating int")).collect()
    assert [r["kind"] for r in got] == [None, "tokenization", "tokenization", "rules", "critique"]


def test_fixed_batch(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [0, 0, 1]), (1, [4, 5], [0, 1]), (2, [6], [0])], "pos int, ids array<int>, mask array<int>")
    assert [r[:] for r in P.fixed_batch(df, 2, 4, 9).orderBy("pos").collect()] == [(0, [1, 2, 9, 9], [-1, 3, -1, -1]), (1, [4, 9, 9, 9], [5, -1, -1, -1])]
