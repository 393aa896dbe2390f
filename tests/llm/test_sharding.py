"""The hash tree against a draw-by-draw version: shares, movement, slots, odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from lodestone.llm import sharding
from lodestone.llm.sharding import Tree
from pyspark.sql import functions as F


def walk(key, tree):
    kin, at = tree.children(), ""
    while at in kin:
        u = lambda node: (int(hashlib.md5(f"{key}@{node}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        at = min(kin[at], key=lambda c: -math.log(u(c[0])) / c[1])[0]
    return int(at.rpartition("/")[2])


UNEVEN = Tree((("a", "x", 0, 1.0), ("a", "x", 1, 3.0), ("a", "y", 2, 0.5), ("b", "x", 3, 2.0), ("c", "z", 7, 0.01)))


@pytest.mark.parametrize("tree", [Tree.even(), Tree.even().grown(), Tree.even(1, 1, 1), UNEVEN, UNEVEN.grown(2.5)])
def test_descends_as_written(spark, tree):
    got = sharding.assign(spark.range(3000), tree, "id").collect()
    assert all(r["shard"] == walk(r["id"], tree) for r in got)


def test_rows_come_in_proportion_to_weights(spark):
    n = 60_000
    got = Counter({r["shard"]: r["count"] for r in sharding.assign(spark.range(n), UNEVEN, "id").groupBy("shard").count().collect()})
    total = sum(w for *_, w in UNEVEN.shards)
    for *_, s, w in UNEVEN.shards:
        p = w / total
        assert abs(got[s] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def moved(spark, a, b):
    rows = sharding.assign(sharding.assign(spark.range(20_000), a, "id", "old"), b, "id", "new")
    return {(r["old"], r["new"]): r["count"] for r in rows.filter("old <> new").groupBy("old", "new").count().collect()}


def test_a_new_shard_takes_rows_only_into_itself(spark):
    tree = Tree.even()
    for _ in range(3):
        new = tree.grown()
        got = moved(spark, tree, new)
        n = len(new.shards)
        assert {to for _, to in got} == {n - 1} and len(got) == n - 1
        assert abs(sum(got.values()) - 20_000 / n) < 5 * math.sqrt(20_000 / n)
        tree = new


def test_a_changed_weight_moves_rows_only_about_its_subtree(spark):
    tree = Tree.even()
    more, less = moved(spark, tree, tree.weighted(5, 2.0)), moved(spark, tree, tree.weighted(5, 0.5))
    # shards 4 to 7 are the region of shard 5, and 4 and 5 its rack
    assert more and all(to >= 4 for _, to in more) and all(to in (4, 5) for a, to in more if a in (6, 7))
    assert less and all(a >= 4 for a, _ in less) and all(a in (4, 5) for a, to in less if to in (6, 7))
    assert {to for a, to in more if a == 4} == {5} and {a for a, to in less if to == 4} == {5}


def test_trees_are_checked():
    for bad in ((), (("a", "b", 1, 0.0),), (("a", "b", 1, 1.0), ("c", "d", 1, 1.0)), (("a", "b", 1, float("nan")),)):
        with pytest.raises(ValueError):
            Tree(bad)


@pytest.mark.parametrize("run", [4096, 7])
def test_shard(spark, monkeypatch, run):
    monkeypatch.setattr(sharding, "RUN", run)
    rows = [(i, f"text {i} é") for i in range(200)] + [(3, "other"), (3, "other"), (None, None), (None, ""), (-5, None), (8, "x" * 300_000)] + [(9, "copy")] * 50 + [(None, "copy")] * 30
    df = spark.createDataFrame([(i, t, "en", 1, "a", 2) for i, t in rows], "doc_id long, text string, shard string, size int, law string, slot int")
    got = sharding.shard(df).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", walk("null" if i is None else i, Tree.even()), walk("null" if i is None else i, Tree.even().grown())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    again = sharding.shard(df.repartition(5)).collect()
    assert Counter(got) == Counter(again)
    assert sharding.shard(df.limit(0)).count() == 0


def test_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a", "b")], "doc_id long, shard string, node string")
    out = sharding.assign(df, Tree.even())
    assert out.columns == df.columns and out.first()["shard"] == walk(1, Tree.even()) and out.first()["node"] == "b"


def test_main_path_is_columns(spark):
    plan = sharding.shard(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
