"""Readers, sinks and streams round trip through files."""

import gzip
import json

import pytest
from lodestone.operators import conversations as C
from lodestone.operators.tokenizer import Tokenizer
from lodestone.sources import readers, sinks
from lodestone.streaming import streams
from pyspark.sql import functions as F


def test_conversations(spark, tmp_path):
    lines = [json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "tool_call": {"name": "Edit", "args": {"z": "1", "a": 2}}}], "_source": "s", "_source_idx": 4}), "", "{broken", json.dumps({"messages": [{"role": "user", "content": "c", "tool_call": None}]})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    df = readers.conversations(spark, str(tmp_path / "x.jsonl"), system_prompt="be good")
    rows = {r["_source_idx"]: r for r in df.collect()}
    assert df.count() == 3 and rows[4]["messages"][0]["role"] == "system"
    assert [tuple(a) for a in rows[4]["messages"][2]["tool_call"]["args"]] == [("z", "1"), ("a", "2")]  # order stays
    assert readers.conversations(spark, str(tmp_path / "x.jsonl"), mode="DROPMALFORMED").count() == 2
    with pytest.raises(Exception):
        readers.conversations(spark, str(tmp_path / "x.jsonl"), mode="FAILFAST").collect()
    assert sorted(r["pos"] for r in readers.conversations(spark, str(tmp_path / "x.jsonl"), seed=1).collect()) == [1, 2, 3]


def test_preferences(spark, tmp_path):
    side = lambda t: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": t}]}
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"chosen": side(f"c{i}"), "rejected": side("" if i == 3 else "r")}) for i in range(8)))
    path = str(tmp_path / "p.jsonl")
    assert readers.preferences(spark, path, 1).count() == 8 and readers.preferences(spark, path, 1, frac=0.5, answered=True).count() == 3


def test_shards(spark, tmp_path):
    df = spark.range(0, 1000).select("id", F.repeat(F.lit("x"), F.pmod("id", F.lit(5)).cast("int") + 1).alias("text"))
    out = str(tmp_path / "corpus")
    sinks.write_shards(df, out, "id", shard_chars=500, row_group=64)
    back = spark.read.parquet(out)
    assert back.count() == 1000 and back.select("shard").distinct().count() > 2
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, p in enumerate(sorted((tmp_path / "corpus").glob("shard=*/*.parquet"), key=lambda p: int(p.parent.name[6:]))):
        (flat / f"shard_{i:05d}.parquet").write_bytes(p.read_bytes())
    train, val = (readers.corpus(spark, str(flat), s, row_group=64) for s in ("train", "val"))
    assert train.count() + val.count() == 1000 and val.select("file").distinct().count() == 1
    assert {r["rg"] % 2 for r in readers.corpus(spark, str(flat), "train", row_group=64, start=1, step=2).select("rg").distinct().collect()} == {1}
    assert [r["split"] for r in readers.shards(spark, str(flat)).orderBy("pos").collect()][-1] == "val"


def test_one_shard_has_no_train_split(spark, tmp_path):
    spark.createDataFrame([("a",)], "text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    with pytest.raises(ValueError, match="one shard"):
        readers.corpus(spark, str(tmp_path / "one"), "train")


def test_bundle(spark, tmp_path):
    config = "icl_tasks:\n- label: copa\n  icl_task_type: multiple_choice\n  dataset_uri: a.jsonl\n  num_fewshot: [10]\n  continuation_delimiter: \"\\nAnswer: \"\n-\n  label: lambada\n".replace("-\n  label: lambada\n", "- label: lambada\n  icl_task_type: language_modeling\n  dataset_uri: b.jsonl\n  num_fewshot:\n  - 0\n")
    rows = readers.bundle_tasks(spark, config).collect()
    assert [(r["label"], r["num_fewshot"], r["delimiter"]) for r in rows] == [("copa", 10, "\nAnswer: "), ("lambada", 0, " ")]
    (tmp_path / "m.csv").write_text("Eval Task,Random baseline,x\ncopa,50.0,1\n")
    assert readers.baselines(spark, str(tmp_path / "m.csv")).collect()[0][:] == ("copa", 50.0)


def test_blobs_logs_repositories(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "1.gz").write_bytes(gzip.compress(b"ok \xff"))
    (tmp_path / "b" / "2.gz").write_bytes(b"junk")
    assert sorted((r["content"] is None, r["content"]) for r in readers.blobs(spark, str(tmp_path / "b")).collect()) == [(False, "ok �"), (True, None)]
    (tmp_path / "l.txt").write_text("a\n\nb")
    assert [(r["line_no"], r["line"]) for r in readers.log_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a"), (1, ""), (2, "b")]
    f = lambda i, n, **k: {"blob_id": str(i), "language": "Python", "is_vendor": False, "is_generated": None, "length_bytes": n, "src_encoding": "utf-8"} | k
    repos = spark.createDataFrame([(0, 5, [f(1, 100), f(2, 5), f(3, 90, language="C")]), (1, None, [f(4, 100)]), (2, 9, [f(5, 80)]), (3, 9, [f(6, 80)])], "pos int, star_events_count int, files array<struct<blob_id:string,language:string,is_vendor:boolean,is_generated:boolean,length_bytes:int,src_encoding:string>>")
    assert [r["blob_id"] for r in readers.repository_files(repos, 1, 10, 1000, budget=100).orderBy("pos").collect()] == ["1", "5"]


def test_places(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).withColumnRenamed("id", "x").coalesce(1).write.parquet(str(tmp_path / "t" / f"{i}"))
        next((tmp_path / "t" / f"{i}").glob("*.parquet")).rename(tmp_path / "t" / f"{i}.parquet")
    files = str(tmp_path / "t" / "*.parquet")
    assert all(r["x"] == r["_source_idx"] for r in readers.instructions(spark, files).collect()) and readers.instructions(spark, files, 17).count() == 17
    assert readers.percent_slice(readers.instructions(spark, files), 40).count() == 12
    (tmp_path / "i.jsonl").write_text('{"query": "a", "choices": ["x"], "gold": 0}\n\n{"context": "c", "continuation": "d"}\n')
    assert [(r["pos"], r["query"], r["context"]) for r in readers.eval_items(spark, str(tmp_path / "i.jsonl")).orderBy("pos").collect()] == [(0, "a", None), (1, None, "c")]
    assert sorted(r["_source_idx"] for r in readers.instructions(spark, str(tmp_path / "i.jsonl"), fmt="json").collect()) == [0, 1]


def test_tokenizer_tables(spark, tmp_path):
    t = Tokenizer({bytes([i]): i for i in range(256)} | {b"ab": 256})
    sinks.write_tokenizer(t, spark, str(tmp_path / "t"))
    assert sinks.read_tokenizer(spark, str(tmp_path / "t")).encode("abc") == t.encode("abc") == [256, 99]


def test_jsonl_and_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string")
    sinks.write_split(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s_test")).collect()[0]["id"] == 2
    sinks.write_jsonl(df, str(tmp_path / "j"))
    sinks.write_jsonl(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 4


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    df = spark.range(0, 40).select(F.col("id").alias("pos"), F.array_repeat(F.lit(1), (F.col("id") % 5 + 1).cast("int")).alias("ids"))
    df.repartition(3).write.parquet(str(src))
    stream = streams.documents(spark, str(src), df.schema, 1)
    for _ in range(2):  # a second run with a fresh checkpoint adds nothing
        streams.resumable_append(stream, lambda b: b.select("pos"), str(out), str(tmp_path / f"c{_}"), ["pos"]).awaitTermination()
        assert spark.read.parquet(str(out)).count() == 40
    q = streams.packed(stream, 6, buffer=4, world=2).writeStream.format("memory").queryName("packed_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "p")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from packed_rows").collect()
    assert rows and all(len(r["tokens"]) == 6 for r in rows)
    assert C.MESSAGES


def test_event_counts(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp'2024-01-01 00:20:00', 'a', 2.0D union all select timestamp'2024-01-01 02:00:00', 'b', 3.0D").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = streams.event_counts(stream).writeStream.format("memory").queryName("event_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event_type"], r["n"], r["total"]) for r in spark.sql("select * from event_counts").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}
