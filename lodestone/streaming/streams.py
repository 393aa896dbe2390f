"""Structured Streaming: cycling sources, resumable appends, packing with carried-over state."""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lodestone.operators import packing
from lodestone.operators.packing import Cropped

# the process that starts a stateful operator has none of the files that are sent to executors: what it runs goes with it
for _module in (packing, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    """New parquet files of a folder, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Keys of a shelf, at most on average.
SHELF = 128


class Unseen(StatefulProcessor):
    """Rows whose key has not been seen, in buckets of keys. What a sink holds when a run begins is put into the state
    once, as initial state.

    A bucket keeps its keys on shelves, by hash: a batch reads and writes the shelves of its own keys alone, and asks
    the state once for each shelf, not for each key. A bucket of more than SHELF keys a shelf has each shelf dealt to
    two, one after the other. So a batch of few keys handles some SHELF for each of them, and one of many keys each
    shelf once, however large the sink is.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle) -> None:
        self.shelves = handle.getMapState("shelves", "shelf int", "keys string")
        self.size = handle.getValueState("size", "n long, shelves int")

    def close(self) -> None:
        pass

    def _shelf(self, i: int) -> list[str]:
        return self.shelves.getValue((i,))[0].split("\n")[1:]

    def _keep(self, i: int, keys: Iterable[str]) -> None:
        self.shelves.updateValue((i,), ("".join(f"\n{k}" for k in keys),))  # a key is JSON, so no line ends in it

    def add(self, keys: list[str]) -> list[bool]:
        """Whether each key is new; from now on none is."""
        n, shelves = self.size.get() if self.size.exists() else (0, 0)
        before, fresh = (n, shelves), not shelves
        if fresh:
            shelves = 1 << max(0, -(-len(keys) // SHELF) - 1).bit_length()
        met = defaultdict(list)
        for at, k in enumerate(keys):
            met[zlib.crc32(k.encode()) & (shelves - 1)].append(at)
        new = [False] * len(keys)
        for i in range(shelves) if fresh else met:
            held = dict.fromkeys(() if fresh else self._shelf(i))
            had = len(held)
            for at in met.get(i, ()):
                new[at] = keys[at] not in held
                held[keys[at]] = None
            n += len(held) - had
            if fresh or len(held) > had:
                self._keep(i, held)
        while n > SHELF * shelves:
            for i in range(shelves):
                halves = [], []
                for k in self._shelf(i):
                    halves[bool(zlib.crc32(k.encode()) & shelves)].append(k)
                self._keep(i, halves[0])
                self._keep(i + shelves, halves[1])
            shelves *= 2
        if (n, shelves) != before:
            self.size.update((n, shelves))
        return new

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  Spark's names
        self.add(initialState["key_"].tolist())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            yield b.loc[self.add(b["key_"].tolist()), self.columns]


#: Buckets of keys of a sink: a task of a batch holds some of them at a time.
BUCKETS = 1024


def unseen(stream: DataFrame, keys: list[str], done: DataFrame | None = None) -> DataFrame:
    """The first row of each key of a stream, of those keys that are not in done. Null is a key like others."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    keyed = lambda df: df.withColumn("key_", F.to_json(F.struct(*keys))).withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(BUCKETS)).cast("int"))
    first = keyed(done).select("bucket_", "key_").distinct().groupBy("bucket_") if done is not None else None
    return keyed(stream).groupBy("bucket_").transformWithStateInPandas(Unseen(stream.columns), stream.schema, "append", "none", first)


def _runs(spark: SparkSession, path: str) -> list[str]:
    """Folders of the runs that have appended to a sink."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or ())


def appended(spark: SparkSession, path: str, schema) -> DataFrame:
    """What the runs of `resumable_append` have committed: each run's folder keeps a log of its batches, and files
    that no batch has committed are not read."""
    parts = [spark.read.schema(schema).parquet(p) for p in _runs(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def resumable_append(stream: DataFrame, transform, path: str, checkpoint: str, keys: list[str]):
    """Appends transform(stream) to a sink of parquet files, each key once, whatever was appended before.

    A run is told by its checkpoint and has a folder of its own below path, to which Spark's file sink appends with a
    log by batch: a batch that is killed before its entry is written, and run again, adds nothing twice. A run that goes
    on from its checkpoint knows its keys from its state; a new one takes those of all earlier runs in when it begins.
    After that no batch reads the sink, so of two checkpoints only the one that began last may go on.
    """
    spark = stream.sparkSession
    rows = transform(stream)
    run = f"{path}/run={hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"
    done = appended(spark, path, rows.schema).select(*keys)
    sink = unseen(rows, keys, done).writeStream.format("parquet").option("path", run)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Packing(StatefulProcessor):
    """Best-fit packing of one rank whose buffer lives in state from batch to batch.

    A waiting document is an entry of a map of its own, under its length and its number: a batch reads the keys, and
    the documents that it packs; it writes those that it adds and takes away those that it has packed. The row that is
    not full is a value. A rank packs while its buffer is full; a row that says `end`, or no row for `idle`, has it
    pack all that waits, as the end of a table does.
    """

    def __init__(self, capacity: int, buffer: int, idle_ms: int | None):
        self.capacity, self.buffer, self.idle_ms = capacity, buffer, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "length int, seq long", "ids array<int>")
        self.row = handle.getValueState("row", "ids array<int>, seq long, row_id long")

    def close(self) -> None:
        pass

    def _pack(self, key: tuple, rows: list[list[int]], finish: bool) -> pd.DataFrame:
        ids, seq, row_id = self.row.get() if self.row.exists() else ([], 0, 0)
        packer = Cropped(self.capacity, self.buffer)
        if len(ids):
            packer.resume(None, list(ids))
        for length, n in sorted(map(tuple, self.waiting.keys()), key=lambda k: k[1]):
            packer.wait(length, _Waiting(self, length, n))
        out = []
        for d in rows:
            new = _Waiting(self, len(d), seq, d)
            seq += 1
            out += [row for row, _ in packer.add(None, new)]
        if finish:
            out += [row for row, _ in packer.finish()]
        for _, _, item in packer.rest():
            if isinstance(item, _Waiting):
                item.keep()
        self.row.update(([int(x) for x in packer.ids], seq, row_id + len(out)))
        return pd.DataFrame({"rank": pd.Series([key[0]] * len(out), dtype="int32"), "row_id": pd.Series(range(row_id, row_id + len(out)), dtype="int64"), "tokens": pd.Series(out, dtype="object")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        b = pd.concat(list(rows)).sort_values("pos_", kind="stable")
        docs = [list(map(int, d)) for d in b["ids_"] if d is not None and len(d)]
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._pack(key, docs, bool(b["end_"].any()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._pack(key, [], True)


class _Waiting:
    """A document of the state: its length is known, its ids are read when it is packed."""

    def __init__(self, owner: Packing, length: int, seq: int, ids: list[int] | None = None):
        self.owner, self.length, self.seq, self.ids = owner, length, seq, ids

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> list[int]:
        """The ids of a document that leaves the buffer."""
        if self.ids is None:
            self.ids = [int(x) for x in self.owner.waiting.getValue((self.length, self.seq))[0]]
            self.owner.waiting.removeKey((self.length, self.seq))
        return self.ids[part]

    def keep(self) -> None:
        if self.ids is not None:
            self.owner.waiting.updateValue((self.length, self.seq), (self.ids,))


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def packed(stream: DataFrame, capacity: int, buffer: int = 1000, world: int = 4, pos: str = "pos", ids: str = "ids", end: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """rank, row_id, tokens: best-fit packing whose buffer is carried from batch to batch in state (see `Packing`).

    Over any batches that follow the places, and with a last row of each rank whose column `end` is true, the rows are
    those that `pack_cropped` makes of each rank's documents. Such a row may have no ids. State of this kind needs
    RocksDB, which is set as the session's state store.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    last = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    ranked = stream.select(F.pmod(F.col(pos), F.lit(world)).cast("int").alias("rank"), F.col(pos).cast("long").alias("pos_"), F.col(ids).alias("ids_"), last.alias("end_"))
    mode = "none" if idle_ms is None else "ProcessingTime"
    return ranked.groupBy("rank").transformWithStateInPandas(Packing(capacity, buffer, idle_ms), "rank int, row_id long, tokens array<int>", "append", mode)


def event_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time, late ones dropped after the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
