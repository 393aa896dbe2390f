"""A parquet corpus as a data source whose partitions are row groups.

    plan = row_groups.plan(spark, path)                      # footers, read in a job
    spark.read.format("row_groups").schema("text string, file string, rg int, pos bigint")
        .option("plan", plan).option("split", "train").option("start", rank).option("step", world).load()

`plan` lists the files of a corpus with Spark and reads their footers in tasks; the table it writes has one row for each
row group: file, place and split of the file, rg, first (its first row in the file), n, bytes of the columns. The source
chooses among these rows when it deals out partitions, so that row groups of the other split, or of other ranks, are in
no partition and no byte of them is read; of those chosen only the columns of the given schema are. A partition holds
adjacent row groups of one file up to `bytes` of them, at least one.

file, file_pos (its place among the files), rg, pos (the row's place in its group) and row (its place in the file) are
columns of the source; all others are
the files' own, cast to the types asked for. Files are opened by pyarrow, so the store has to be one that it knows: local
or mounted disks, HDFS, S3, GCS, Azure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.sources.shared import scratch

#: Bytes of row groups that a partition holds at most, unless one group has more; rows of a batch.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 1024
_OWN = ("file", "file_pos", "rg", "pos", "row")


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI as Spark writes it, and the path there."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def files(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, split of the parquet files below path: in lexicographic order, the last one is val."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    w = Window.orderBy("file")  # one row a file
    out = names.withColumns({"pos": F.row_number().over(w) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    return out.select("file", "pos", F.when(F.col("pos") == F.col("n_") - 1, "val").otherwise("train").alias("split"))


def footers(listed: DataFrame) -> DataFrame:
    """A row for each row group of (file, pos, split): the footer of each file is read in the task that has its row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, pos, split in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                store, at = located(file)
                with store.open_input_file(at) as f:
                    meta = pq.read_metadata(f)
                first = 0
                for rg in range(meta.num_row_groups):
                    g = meta.row_group(rg)
                    sizes = {}
                    for i in range(g.num_columns):
                        c = g.column(i)
                        name = c.path_in_schema.split(".")[0]
                        sizes[name] = sizes.get(name, 0) + c.total_uncompressed_size
                    out.append({"file": file, "file_pos": pos, "split": split, "rg": rg, "first": first, "n": g.num_rows, "bytes": g.total_byte_size, "column_bytes": list(sizes.items())})
                    first += g.num_rows
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("file", pa.string()), ("file_pos", pa.int32()), ("split", pa.string()), ("rg", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("bytes", pa.int64()), ("column_bytes", pa.map_(pa.string(), pa.int64()))])
    n = max(1, min(listed.count() // 8, 10_000))
    ddl = "file string, file_pos int, split string, rg int, first bigint, n bigint, bytes bigint, column_bytes map<string, bigint>"
    return listed.select("file", "pos", "split").repartition(n, "file").mapInArrow(read, ddl)


def plan(spark: SparkSession, path: str) -> str:
    """The path of a table of all row groups below path."""
    out = scratch(spark, "row-groups")
    footers(files(spark, path)).write.parquet(out)
    return out


def chosen(spark: SparkSession, plan: str) -> DataFrame:
    """The rows of a plan."""
    return spark.read.schema("file string, file_pos int, split string, rg int, first bigint, n bigint, bytes bigint, column_bytes map<string, bigint>").parquet(plan)


@dataclass
class Groups(InputPartition):
    """Row groups of one file, with the first row of each."""

    file: str
    file_pos: int
    groups: list[tuple[int, int]]


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.schema, self.plan = schema, options["plan"]
        self.split = options.get("split")
        self.start, self.step = int(options.get("start", 0)), int(options.get("step", 1))
        self.after, self.until = (tuple(map(int, options[o].split(","))) if o in options else None for o in ("after", "until"))
        self.bytes = int(options.get("bytes", PARTITION_BYTES))
        if self.split not in (None, "train", "val") or self.step < 1:
            raise ValueError("split is train or val, step at least 1")

    def partitions(self) -> list[Groups]:
        """Only the plan is read here, one small row for each row group."""
        store, at = located(self.plan)
        rows = pq.read_table(at, filesystem=store, columns=["file", "file_pos", "split", "rg", "first", "n", "bytes"]).to_pylist()
        out: list[Groups] = []
        size = 0
        for r in sorted(rows, key=lambda r: (r["file_pos"], r["rg"])):
            if r["rg"] < self.start or (r["rg"] - self.start) % self.step or not r["n"] or (self.split and r["split"] != self.split):
                continue
            at = r["file_pos"], r["rg"]
            if (self.after and at <= self.after) or (self.until and at > self.until):
                continue
            if not out or out[-1].file != r["file"] or size + r["bytes"] > self.bytes:
                out.append(Groups(r["file"], r["file_pos"], []))
                size = 0
            out[-1].groups.append((r["rg"], r["first"]))
            size += r["bytes"]
        return out

    def read(self, partition: Groups | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions
            return
        target = to_arrow_schema(self.schema)
        wanted = [f.name for f in target if f.name not in _OWN]
        store, at = located(partition.file)
        with store.open_input_file(at) as f:
            file = pq.ParquetFile(f)
            for rg, first in partition.groups:
                pos = 0
                # a group without columns of its own still has rows
                for b in file.iter_batches(BATCH_ROWS, row_groups=[rg], columns=wanted) if wanted else self._bare(file, rg):
                    n = b.num_rows
                    own = {"file": lambda n=n: pa.array([partition.file] * n, pa.string()), "file_pos": lambda n=n: pa.array([partition.file_pos] * n, pa.int32()), "rg": lambda n=n, rg=rg: pa.array([rg] * n, pa.int32()), "pos": lambda n=n, at=pos: pa.array(range(at, at + n), pa.int64()), "row": lambda n=n, at=first + pos: pa.array(range(at, at + n), pa.int64())}
                    yield pa.RecordBatch.from_arrays([own[c.name]().cast(c.type) if c.name in own else b.column(wanted.index(c.name)).cast(c.type) for c in target], schema=target)
                    pos += n

    @staticmethod
    def _bare(file: pq.ParquetFile, rg: int) -> Iterator[pa.RecordBatch]:
        left = file.metadata.row_group(rg).num_rows
        while left:
            n = min(left, BATCH_ROWS)
            yield pa.RecordBatch.from_arrays([pa.nulls(n)], names=["none"])
            left -= n


class RowGroups(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> str:
        return "text string, file string, rg int, pos bigint"

    def reader(self, schema) -> RowGroupReader:
        return RowGroupReader(self.options, schema)


def scan(spark: SparkSession, plan: str, schema: str = "text string, file string, rg int, pos bigint", split: str | None = None, start: int = 0, step: int = 1, after: tuple[int, int] | None = None, until: tuple[int, int] | None = None) -> DataFrame:
    """The chosen row groups of a plan: of one split, of each file the groups start, start + step, ..., and of those
    only the ones behind `after` and up to `until`, each a (place of the file, row group)."""
    spark.dataSource.register(RowGroups)
    reader = spark.read.format("row_groups").schema(schema).option("plan", plan).option("start", start).option("step", step)
    for name, value in (("split", split), ("after", after and f"{after[0]},{after[1]}"), ("until", until and f"{until[0]},{until[1]}")):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()
