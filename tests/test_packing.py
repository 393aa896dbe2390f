"""Packing in segments and in streams against one loop over each rank, and what becomes of every id."""

import random
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.operators import packing as P
from lodestone.streaming import streams
from pyspark.sql import functions as F


def frame(spark, lengths, partitions=3):
    """Document i holds ids i * 1000, i * 1000 + 1, ..."""
    return spark.createDataFrame([(i, [i * 1000 + k for k in range(n)]) for i, n in enumerate(lengths)], "pos long, ids array<int>").repartition(partitions)


def held(rows):
    """(pos, taken, length) of all pieces; every piece is the head of its document."""
    out = []
    for r in rows:
        at = 0
        for pos, taken, length in r["pieces"]:
            assert r["tokens"][at : at + taken] == [pos * 1000 + k for k in range(taken)]
            out.append((pos, taken, length))
            at += taken
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 9), st.integers(1, 20), st.integers(0, 60))
def test_a_packer_goes_on_where_it_stopped(lengths, buffer, capacity, cut):
    docs = [[i] * n for i, n in enumerate(lengths)]
    first = P.Feed(enumerate(docs[:cut]))
    rows = [ids for ids, _ in P.pack_cropped(first, capacity, buffer, finish=False)]
    placed = [(tag, ids) for in_row, tag, ids in first.left if in_row]
    waiting = [(tag, ids) for in_row, tag, ids in first.left if not in_row]
    second = P.Feed([*waiting, *enumerate(docs[cut:], cut)], placed)
    rows += [ids for ids, _ in P.pack_cropped(second, capacity, buffer)]
    assert rows == list(P.pack_cropped(docs, capacity, buffer))
    assert all(len(r) == capacity for r in rows)


@pytest.mark.parametrize("segment, segments", [(16_384, 16), (8, 2), (5, 100)])
def test_nothing_is_lost_or_doubled(spark, monkeypatch, segment, segments):
    monkeypatch.setattr(P, "SEGMENT", segment)
    monkeypatch.setattr(P, "SEGMENTS", segments)
    rng = random.Random(segment)
    lengths = [rng.choice([0, 1, 2, 5, 9, 12, 13, 40]) for _ in range(160)]
    rows = P.packed_rows(frame(spark, lengths), 12, world=3, buffer=4, pieces=True).collect()
    assert all(len(r["tokens"]) == 12 == sum(p["taken"] for p in r["pieces"]) for r in rows)
    assert all(p["pos"] % 3 == r["rank"] for r in rows for p in r["pieces"])
    pieces = held(rows)
    assert max(Counter(p for p, *_ in pieces).values()) == 1 and all(n == lengths[p] for p, _, n in pieces)
    # what is in no row would not fill one
    for rank in range(3):
        left = sum(n for i, n in enumerate(lengths) if i % 3 == rank and i not in {p for p, *_ in pieces})
        groups = -(-len(range(rank, 160, 3)) // (segment * segments))
        assert left < 12 * groups
        ids = sorted(r["row_id"] for r in rows if r["rank"] == rank)
        assert ids == list(range(len(ids)))
    if segment > 160:
        for rank in range(3):
            want = list(P.pack_cropped([[i * 1000 + k for k in range(n)] for i, n in enumerate(lengths) if i % 3 == rank], 12, 4))
            assert [r["tokens"] for r in sorted((r for r in rows if r["rank"] == rank), key=lambda r: r["row_id"])] == want


@pytest.mark.parametrize("segment", [16_384, 6])
def test_padded_rows_keep_every_id(spark, monkeypatch, segment):
    monkeypatch.setattr(P, "SEGMENT", segment)
    monkeypatch.setattr(P, "SEGMENTS", 2)
    rng = random.Random(segment)
    lengths = [rng.choice([0, 1, 3, 8, 9, 10, 25]) for _ in range(120)]
    df = frame(spark, lengths).withColumn("mask", F.transform("ids", lambda x: (x % 2).cast("int")))
    rows = P.padded_rows(df, 9, -7, world=2, buffer=5, pieces=True).collect()
    got = Counter(p for r in rows for p, *_ in r["pieces"])
    assert got == Counter(i for i, n in enumerate(lengths) if n)
    for r in rows:
        at = sum(p["taken"] for p in r["pieces"])
        assert len(r["tokens"]) == len(r["mask"]) == 9 and r["tokens"][at:] == [-7] * (9 - at) and not any(r["mask"][at:])
        assert r["mask"][:at] == [x % 2 for x in r["tokens"][:at]]
        assert all(p["taken"] == min(p["length"], 9) for p in r["pieces"])
    held(rows)


def test_empty_tables_and_places(spark):
    assert P.packed_rows(frame(spark, []), 5).count() == 0
    assert P.padded_rows(frame(spark, []).withColumn("mask", F.col("ids")), 5, 0).count() == 0
    nulls = spark.createDataFrame([(None, [1, 2, 3]), (None, None), (0, [4, 5])], "pos long, ids array<int>")
    assert sorted(P.packed_rows(nulls, 5, world=2).first()["tokens"]) == [1, 2, 3, 4, 5]


def test_segments_crop_little_more_than_one_loop(spark, monkeypatch):
    """Rows are full by construction; what segments cost is what they crop and leave."""
    rng = random.Random(5)
    lengths = [min(400, int(rng.lognormvariate(3.5, 1))) + 1 for _ in range(6000)]
    cropped = lambda rows: sum(p["length"] - p["taken"] for r in rows for p in r["pieces"]) / sum(lengths)
    df = spark.createDataFrame([(i, [0] * n) for i, n in enumerate(lengths)], "pos long, ids array<int>")
    one = P.packed_rows(df, 129, world=1, buffer=200, pieces=True).collect()
    monkeypatch.setattr(P, "SEGMENT", 1000)
    many = P.packed_rows(df, 129, world=1, buffer=200, pieces=True).collect()
    assert len(many) > 0.98 * len(one) and cropped(many) < cropped(one) + 0.02


# ---- streams


def run(stream, at, name, **options):
    out = streams.packed(stream, 12, buffer=4, world=2, **options)
    return out.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-checkpoint").trigger(availableNow=True).start()


def files(spark, at, lengths, cuts):
    """One file for each run of places, and one with the end of each rank; their order is that of their times."""
    for lo, hi in zip(cuts, cuts[1:]):
        part = [(i, [i * 1000 + k for k in range(lengths[i])], False) for i in range(lo, hi)]
        spark.createDataFrame(part, "pos long, ids array<int>, last boolean").coalesce(1).write.mode("append").parquet(at)
        time.sleep(0.02)


SCHEMA = "pos long, ids array<int>, last boolean"


def wanted(lengths, rank):
    return list(P.pack_cropped([[i * 1000 + k for k in range(n)] for i, n in enumerate(lengths) if i % 2 == rank], 12, 4))


@pytest.mark.parametrize("cuts", [[0, 80], [0, 1, 30, 31, 55, 80]])
def test_a_stream_packs_as_a_loop(spark, tmp_path, cuts):
    rng = random.Random(3)
    lengths = [rng.choice([0, 1, 2, 5, 9, 12, 13, 40]) for _ in range(80)]
    src = str(tmp_path / "src")
    files(spark, src, lengths, cuts[:-1] if len(cuts) > 2 else cuts)
    run(streams.documents(spark, src, SCHEMA, 1), tmp_path, "out", end="last").awaitTermination()
    if len(cuts) > 2:  # started again from its checkpoint, with more to read
        files(spark, src, lengths, cuts[-2:])
        run(streams.documents(spark, src, SCHEMA, 1), tmp_path, "out", end="last").awaitTermination()
    spark.createDataFrame([(r, None, True) for r in range(2)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    run(streams.documents(spark, src, SCHEMA, 1), tmp_path, "out", end="last").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("rank", "row_id").collect()
    for rank in range(2):
        mine = [r for r in rows if r["rank"] == rank]
        assert [r["row_id"] for r in mine] == list(range(len(mine)))
        assert [r["tokens"] for r in mine] == wanted(lengths, rank)


def test_a_silent_stream_packs_what_waits(spark, tmp_path):
    lengths = [5, 7, 12, 3, 9, 4, 8]
    src = str(tmp_path / "src")
    files(spark, src, lengths, [0, len(lengths)])
    q = streams.packed(streams.documents(spark, src, SCHEMA), 12, buffer=4, world=2, idle_ms=500).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    want = sorted(map(tuple, wanted(lengths, 0) + wanted(lengths, 1)))
    try:
        for _ in range(100):
            got = sorted(tuple(r["tokens"]) for r in spark.sql("select * from silent").collect())
            if got == want:
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert got == want


# ---- appends


def test_appends_once(spark, tmp_path):
    """Keys that repeat in a batch, in a later one and in another run; a batch that ran without being committed."""
    import os

    src, out, c = (str(tmp_path / x) for x in ("src", "out", "c"))
    schema = "k long, part string, v string"
    add = lambda *rows: (spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src), time.sleep(0.02))
    go = lambda checkpoint: streams.resumable_append(streams.documents(spark, src, schema, 1), lambda s: s.filter("v <> 'no'"), out, checkpoint, ["k", "part"]).awaitTermination()
    key = lambda rows: sorted(rows, key=repr)
    got = lambda: key((r["k"], r["part"]) for r in streams.appended(spark, out, schema).collect())
    assert got() == []
    add((1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "a", "no"), (None, "a", "x"), (None, "a", "x"))
    add((1, "a", "x"), (2, "a", "yes"))
    go(c)
    assert got() == key([(1, "a"), (1, "b"), (2, "a"), (None, "a")])
    # the last batch is killed after its files were written: neither the sink nor the run knows of it
    (run,) = (tmp_path / "out").glob("run=*")
    for log in (run / "_spark_metadata", tmp_path / "c" / "commits"):
        last = max(int(p.name) for p in log.iterdir() if p.name.isdigit())
        os.remove(log / str(last))
        (log / f".{last}.crc").unlink(missing_ok=True)
    assert got() == key([(1, "a"), (1, "b"), (None, "a")])
    go(c)
    assert got() == key([(1, "a"), (1, "b"), (2, "a"), (None, "a")])
    assert spark.read.schema(schema).parquet(*[str(p) for p in run.glob("*.parquet")]).count() > len(got())  # files of no batch
    add((3, "a", "x"), (1, "a", "z"))
    go(str(tmp_path / "another"))  # another checkpoint: it reads all of the source again
    assert got() == key([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (None, "a")])


def test_packing_and_encoding_keep_few_ids_in_python(spark, monkeypatch):
    """A batch of many documents is mapped by slices, and what waits are arrays that keep no batch in memory."""
    import pyarrow as pa
    from lodestone.operators import tokenizer as K

    b = pa.RecordBatch.from_pydict({"pos": [1, 2, 3, 4], "tokens": pa.array([[1, 2], None, [], [3, None]], pa.list_(pa.int64()))})
    rows = list(P._rows(b.slice(0), ["tokens"]))
    assert [None if r["tokens"] is None else r["tokens"].tolist() for r in rows] == [[1, 2], None, [], [3, None]]
    assert all(r["tokens"].base is None for r in rows if r["tokens"] is not None)
    assert [r["tokens"].tolist() for r in P._rows(b.slice(2, 2), ["tokens"])] == [[], [3, None]]

    t = K.Tokenizer({bytes([i]): i for i in range(256)})
    monkeypatch.setattr(K, "SLICE", 64)
    docs = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("id") != 7, F.col("text")))
    sizes = K._mapped(docs, t, "text", {"n": pa.int64()}, "id long, text string, n long", lambda t, v: (None if v is None else len(v),))
    seen = sizes.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"rows": [b.num_rows]}) for b in bs), "rows long").collect()
    assert sizes.select(F.sum("n")).first()[0] == 4950 - 7
    back = K.decoded(K.encoded(docs, t), t)
    assert back.filter(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and back.count() == 100 and seen
    got = P.packed_rows(K.encoded(docs, t).select(F.col("id").alias("pos"), "ids"), 10, world=2)
    assert {tuple(r["tokens"]) for r in got.collect()} == {(120,) * 10}


def test_ids_are_cells_until_rows_are_done(spark):
    """Neither the shuffles nor the tables of packing hold lists of numbers, and its rows are not shuffled to be numbered."""
    import numpy as np
    import pyarrow as pa

    some = [np.arange(-3, 700, dtype=np.int32), np.zeros(0, np.int32), np.array([2**31 - 1, -(2**31)], np.int32), np.array([3, None, 0], object), np.array([None], object)]
    assert [P._uncell(P._cell(a)).tolist() for a in some] == [a.tolist() for a in some]
    assert len(P._cell(np.ones(4096, np.int32))) < 100
    assert P._lists([np.array([1, 2], np.int32), None, np.array([None, 4], object)]).to_pylist() == [[1, 2], None, [None, 4]]

    df = frame(spark, [3, 0, 700, 5]).withColumn("ids", F.when(F.col("pos") != 3, F.col("ids")))
    cells = P.pressed(df, "ids")
    assert dict(cells.dtypes)["ids"] == "binary" and dict(P.loosened(cells, "ids").dtypes) == dict(df.dtypes)
    assert sorted(P.loosened(cells, "ids").collect()) == sorted(df.collect())
    long = spark.createDataFrame([(None, [1, None]), (1, [2**31 - 1])], "pos long, ids array<bigint>")
    assert sorted(r["ids"] for r in P.loosened(P.pressed(long, "ids"), "ids").collect() if r["pos"]) == [[2**31 - 1]]

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = P.padded_rows(frame(spark, [3, 9, 700, 5] * 9).withColumn("mask", F.col("ids")), 9, 0, world=2, buffer=3)
        assert rows.count() and dict(rows.dtypes)["mask"] == "array<int>"
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "tokens:binary,mask:binary" in plan
    assert pa.types.is_binary(P._cells([None]).type)
