"""An endless source of one or two corpora: row groups by row group, epoch after epoch, mixed by a ratio.

    batches = endless.steps(spark, [plan, other], ratio=0.2, seed=7, per_trigger=64)
    endless.texts(batches)            # step, source, epoch, file_pos, rg, pos, text

The stream is of steps: at each one the hash of seed and step picks the source, and the source gives its next row group
of those that the rank reads. After its last one its next epoch begins, in an order of its own where a seed says so: the
place in an epoch goes through x -> (a x + b) mod n with a and b from seed and epoch, which meets every row group once
and needs no shuffle and no list. An offset is a step and how many of the steps before it went to the second source, so
a stream that was stopped anywhere goes on with the same row groups, at no cost that grows with what it has read.

Steps are a few numbers each; texts are read by the tasks that the steps are dealt to.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from math import gcd

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from lodestone.sources.row_groups import BATCH_ROWS, located

STEPS = "step bigint, source int, epoch bigint, file string, file_pos int, rg int"


def _hash(*parts) -> int:
    """32 bits of the parts."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def permuted(x: int, n: int, seed: str, epoch: int) -> int:
    """The place that comes x-th in an epoch of n."""
    a = _hash(seed, epoch, "a") % n or 1
    while gcd(a, n) != 1:
        a += 1
    return (a * x + _hash(seed, epoch, "b")) % n


class StepReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.ratio, self.seed = float(options.get("ratio", 0)), options.get("seed", "")
        self.shuffle = options.get("shuffle", "false") == "true"
        self.each, self.last = int(options.get("per_trigger", 64)), int(options["steps"]) if "steps" in options else None
        start, step, split = int(options.get("start", 0)), int(options.get("step", 1)), options.get("split")
        self.sources: list[list[tuple]] = []
        for plan in json.loads(options["plans"]):
            store, at = located(plan)
            rows = pq.read_table(at, filesystem=store, columns=["file", "file_pos", "split", "rg", "n"]).to_pylist()
            own = [(r["file"], r["file_pos"], r["rg"]) for r in rows if r["n"] and r["rg"] >= start and (r["rg"] - start) % step == 0 and split in (None, r["split"])]
            self.sources.append(sorted(own, key=lambda r: r[1:]))
            if not own:
                raise ValueError("a source without row groups never ends")
        if not 1 <= len(self.sources) <= 2:
            raise ValueError("one source, or two and a ratio")

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {"step": 0, "second": 0}

    def _rows(self, start: dict, until: int) -> tuple[list[tuple], dict]:
        out, second = [], start["second"]
        for step in range(start["step"], until):
            source = int(len(self.sources) == 2 and _hash(self.seed, step) / 2**32 < self.ratio)
            own = self.sources[source]
            epoch, x = divmod(second if source else step - second, len(own))
            out.append((step, source, epoch, *own[permuted(x, len(own), self.seed, epoch) if self.shuffle else x]))
            second += source
        return out, {"step": max(until, start["step"]), "second": second}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        until = start["step"] + self.each
        rows, end = self._rows(start, until if self.last is None else max(start["step"], min(until, self.last)))
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start, end["step"])[0])


class Steps(DataSource):
    @classmethod
    def name(cls) -> str:
        return "endless_row_groups"

    def schema(self) -> str:
        return STEPS

    def simpleStreamReader(self, schema) -> StepReader:  # noqa: N802
        return StepReader(self.options)


def steps(spark: SparkSession, plans: list[str], ratio: float = 0.0, seed: str | int = "", shuffle: bool = False, split: str | None = None, start: int = 0, step: int = 1, per_trigger: int = 64, last: int | None = None) -> DataFrame:
    """The stream of steps over one or two plans of `row_groups.plan`: per_trigger of them a batch, without an end or
    up to `last`. Of each file it reads the row groups start, start + step, ..."""
    spark.dataSource.register(Steps)
    options = {"plans": json.dumps(plans), "ratio": ratio, "seed": seed, "shuffle": str(shuffle).lower(), "start": start, "step": step, "per_trigger": per_trigger}
    options |= {k: v for k, v in (("split", split), ("steps", last)) if v is not None}
    return spark.readStream.format("endless_row_groups").options(**options).load()


def texts(batches: DataFrame, text: str = "text") -> DataFrame:
    """step, source, epoch, file_pos, rg, pos, text of the row groups of a stream of steps."""
    schema = pa.schema([("step", pa.int64()), ("source", pa.int32()), ("epoch", pa.int64()), ("file_pos", pa.int32()), ("rg", pa.int32()), ("pos", pa.int64()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, at = located(r["file"])
                with store.open_input_file(at) as f:
                    pos = 0
                    for part in pq.ParquetFile(f).iter_batches(BATCH_ROWS, row_groups=[r["rg"]], columns=[text]):
                        n = part.num_rows
                        own = {**{c: [r[c]] * n for c in ("step", "source", "epoch", "file_pos", "rg")}, "pos": range(pos, pos + n)}
                        yield pa.RecordBatch.from_arrays([part.column(0).cast(c.type) if c.name == "text" else pa.array(own[c.name], c.type) for c in schema], schema=schema)
                        pos += n

    n = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batches.repartition(n, "step").mapInArrow(read, "step bigint, source int, epoch bigint, file_pos int, rg int, pos bigint, text string")
