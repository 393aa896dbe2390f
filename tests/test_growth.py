"""What must not grow with the tables: rows of one task, tasks of small shards, sequences that a task holds."""

import random
from pathlib import Path

import pandas as pd
import pyarrow as pa
from lodestone.functions import arrays
from lodestone.operators import evals, tokenizer
from lodestone.plans import derived
from lodestone.sources import sinks
from lodestone.streaming import streams
from pyspark.sql import functions as F


def test_instructions_are_written_by_as_many_tasks_as_the_table_needs(spark, tmp_path, monkeypatch):
    path = tmp_path / "instructions"
    monkeypatch.setattr(derived.O, "scratch", lambda *_: f"file://{path}")
    monkeypatch.setattr(derived, "read", lambda *_: spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = derived.src7_instructions(spark, "")
        assert len(list(path.glob("*.parquet"))) == 16
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(160)]


def test_small_shards_share_tasks(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    sinks.write_shards(rows, f"{tmp_path}/s", "doc_id", shard_chars=1, row_group=8)
    files = list(Path(tmp_path, "s").glob("*/*.parquet"))
    assert len(files) == 50 and len({f.name.split("-")[1] for f in files}) <= 4


def test_sequences_are_collated_without_a_sort(spark):
    rows = spark.createDataFrame([(0, 3), (1, 130), (2, 5), (3, 4000), (4, 9), (None, 600)], "seq int, n int")
    got = evals.collated(rows.select("seq", F.array_repeat(F.lit(7), F.col("n")).alias("ids"), F.array_repeat(F.lit(1), F.col("n")).alias("mask")), 2, -1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "ShuffledHashJoin" in plan
    sizes = {r["seq"]: (len(r["ids"]), len(r["mask"]), sum(r["mask"])) for r in got.collect()}
    assert sizes == {0: (256, 256, 3), 1: (256, 256, 130), 2: (4096, 4096, 5), 3: (4096, 4096, 4000), 4: (128, 128, 9), None: (1024, 1024, 600)}


def test_training_holds_runs_of_the_best_pairs_alone(spark, monkeypatch):
    """Pieces stay on the executors whatever their number; a round cuts them at all but the best pairs, and learns many merges."""
    rng = random.Random(3)
    parts = ["th", "he", "an", "in", "er", "qu", "ié", "zo"]
    counts = {"".join(rng.choices(parts, k=rng.randint(2, 7))): rng.randint(1, 50) for _ in range(3000)}
    held, learned = [], tokenizer._learned
    want = learned([[bytes([b]) for b in w.encode()] for w in counts], list(counts.values()), 400)
    monkeypatch.setattr(tokenizer, "_learned", lambda words, *a: held.append(len(words)) or learned(words, *a))
    monkeypatch.setattr(tokenizer, "DRIVER_PIECES", 600)
    monkeypatch.setattr(tokenizer, "NAMED", 8)
    assert tokenizer.learn_merges_apart(spark.createDataFrame([*counts.items()], "chunk string, n long"), 400) == want
    assert max(held) <= 600 and len(held) < 40


def test_training_writes_words_as_blocks(spark, monkeypatch):
    """Each round reads and writes some rows of many words, and widens while few runs are left."""
    rng = random.Random(4)
    counts = {"".join(rng.choices("abcdeé", k=rng.randint(2, 12))): rng.randint(1, 50) for _ in range(3000)} | {"x" * 5000: 2, "": 9, "y": 1}
    want = tokenizer.learn_merges({w.encode(): n for w, n in counts.items() if w}, 300)
    written, rounds, learned, write = [], [], tokenizer._learned, tokenizer.Tables.__call__
    monkeypatch.setattr(tokenizer.Tables, "__call__", lambda self, df, name: written.append(write(self, df, name)) or written[-1])
    monkeypatch.setattr(tokenizer.Tables, "drop", lambda *_: None)
    monkeypatch.setattr(tokenizer, "_learned", lambda *a: rounds.append(1) or learned(*a))
    monkeypatch.setattr(tokenizer, "NAMED", 2)
    assert tokenizer.learn_merges_apart(spark.createDataFrame([*counts.items()], "chunk string, n long").repartition(4), 300) == want
    assert len(written) > 2 and max(t.count() for t in written) <= 4 and len(rounds) < 8


def test_a_merge_is_certain_above_all_pairs_that_were_cut():
    best = [(b"a", b"b"), (b"c", b"d")]
    certain = tokenizer.Certain(best, 5, {b"a", b"b", b"c", b"d", b"cd"})
    assert not certain(4, (b"a", b"b"), [])  # a pair that was cut may count more
    assert certain(5, (b"a", b"b"), []) and not certain(5, (b"c", b"e"), [])  # beyond the last of the best
    assert not certain(5, (b"b", b"a"), [])  # (ab, y) may tie with a pair (b, y) that was cut
    assert certain(6, (b"c", b"d"), []) and not certain(9, (b"a", b"c"), [])  # cd is there already


def test_ids_are_mapped_without_numbers_of_python(spark, monkeypatch):
    texts = ["hello <|bos|> é🙂", None, "", "hello " * 50, "é"]
    t = tokenizer.Tokenizer({bytes([i]): i for i in range(256)} | {b"he": 256, b"ll": 257})
    ids = [None if v is None else t.encode(v, "<|bos|>", "<|user_end|>") for v in texts]
    cut = [[t.bos, 0xC3], None, [], [0xF0, 0x9F, 256], [t.bos]]
    back = [[None if v is None else t.decode(v) for v in x] for x in (ids, cut)]
    monkeypatch.setattr(tokenizer.Tokenizer, "encode", None)
    monkeypatch.setattr(tokenizer.Tokenizer, "decode", None)
    got = tokenizer._ids(t, pa.array(["x", *texts], pa.string()).slice(1), "<|bos|>", "<|user_end|>")
    assert got.to_pylist() == ids
    for lists, want in zip((ids, cut), back, strict=True):
        assert tokenizer._texts(t, pa.array([[1], *lists], pa.list_(pa.int32())).slice(1)).to_pylist() == want
    assert tokenizer._texts(t, pa.array([], pa.list_(pa.int32()))).to_pylist() == []


def test_common_length_makes_its_sequences_once(spark):
    rows = [[[1, 2, 3], [1, 2, 4]], [[1, None, 3], [1, None, 3, 4]], [[1], [1, None]], [[], [1]], [[1, 2], None], [None, [1]], [None, None], [[1, 2]], [], None, [[1, 2], [1, 2]], [[None], [None]], [[9, 2, 3], [8, 2, 3], [2, 3]]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<array<int>>")
    got = df.select("i", arrays.common_length(F.col("r")).alias("a"), arrays.common_length(F.col("r"), from_right=True).alias("b")).orderBy("i").collect()
    assert [g["a"] for g in got] == [2, 3, 1, 0, 0, 0, None, 2, None, None, 2, 1, 0]
    assert [g["b"] for g in got] == [0, 0, 0, 0, 0, 0, None, 2, None, None, 2, 1, 2]
    made = arrays.common_length(F.array(F.concat(F.col("r")[0], F.array(F.lit(-77))), F.col("r")[1]))
    assert df.select(made)._jdf.queryExecution().logical().toString().count("-77") == 1


class _State:
    """Map and value state in memory, which counts what is asked of it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, name, *_):  # noqa: N802
        return self

    def getValueState(self, name, *_):  # noqa: N802
        return _State()

    def _called(self):
        self.calls += 1
        return self.held

    def containsKey(self, k):  # noqa: N802
        return k in self._called()

    def getValue(self, k):  # noqa: N802
        return self._called()[k]

    def updateValue(self, k, v):  # noqa: N802
        self._called()[k] = v

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, v):
        self.held[()] = v


def test_keys_of_a_sink_are_asked_for_by_shelves():
    """Batches of keys that repeat in them, before and in the sink: the first row of each new key, with few calls to the
    state for a batch of many keys and few keys handled for a batch of one."""
    rng, state = random.Random(6), _State()
    u = streams.Unseen(["key_", "at"])
    u.init(state)
    key = lambda i: f'{{"k":"é\\\\n{i}"}}'
    seen = {key(i) for i in range(0, 3000, 3)}
    u.handleInitialState((0,), pd.DataFrame({"key_": sorted(seen)}), None)
    n = len(seen)
    for size in (1, 40, 0, 9000, 1, 20_000, 500):
        keys = [key(rng.randrange(30_000)) for _ in range(size)]
        got = [tuple(r) for b in u.handleInputRows((0,), iter([pd.DataFrame({"key_": keys, "at": range(size)}, columns=["key_", "at"])]), None) for r in b.itertuples(index=False)]
        first = {k: at for at, k in reversed(list(enumerate(keys)))}
        assert got == sorted(((k, at) for k, at in first.items() if k not in seen), key=lambda r: r[1])
        seen |= set(keys)
        n += size
    assert state.calls < n // 10
    state.calls = 0
    assert [len(b) for b in u.handleInputRows((0,), iter([pd.DataFrame({"key_": [key(-1)], "at": [0]})]), None)] == [1]
    assert state.calls <= 2 and max(len(str(v)) for v in state.held.values()) < 40 * 4 * streams.SHELF
