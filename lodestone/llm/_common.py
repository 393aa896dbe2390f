"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.sources.shared import Tables, scratch, shared_dir, table  # noqa: F401

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it

_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def _split(ddl: str) -> list[str]:
    """Parts between the commas outside of angle brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [x.strip() for x in [*out, ddl[at:]]]


def _arrow_type(kind: str) -> pa.DataType:
    if kind.startswith("array<"):
        return pa.list_(_arrow_type(kind[6:-1].strip()))
    if kind.startswith("struct<"):
        return pa.struct([(n.strip(), _arrow_type(k.strip())) for n, k in (x.split(":", 1) for x in _split(kind[7:-1]))])
    return _ARROW[kind]


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    """The Arrow schema of a Spark one, or of a DDL string; the latter needs no session, so it works on executors."""
    if isinstance(schema, str):
        return pa.schema([(n, _arrow_type(k.strip())) for n, k in (x.split(" ", 1) for x in _split(schema))])
    return to_arrow_schema(schema)


def batch(schema: pa.Schema, **columns: Iterable) -> pa.RecordBatch:
    """A record batch of the named columns in the schema's order."""
    out = []
    for f in schema:
        c = columns[f.name]
        out.append(c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def starts_of(b: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the rows whose keys differ from those of the row before, and 0."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = b.column(b.schema.get_field_index(k))
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(new)


def keyed_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of adjacent rows with equal keys, none null; the input is sorted by keys within its partition."""
    held: list[pa.RecordBatch] = []
    current: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        at = [*starts_of(b, keys).tolist(), b.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            key = tuple(b.column(b.schema.get_field_index(k))[lo].as_py() for k in keys)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups, about a batch of rows each; the input is sorted by keys within its partition."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = int(starts_of(b, keys)[-1])  # of the last group, which may go on
        if held and cut == 0:
            both = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)])
            if len(starts_of(both, keys)) > 1:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def release() -> None:
    """Hands free memory of this worker back to the machine: idle workers share it with the JVM and with each other."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(column: pa.Array, most: int = 2 << 20, rows: int = 512) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `rows` rows and about `most` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and (held + n > most or i - lo >= rows):
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


def grouped_arrow(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterable[pa.RecordBatch]], schema: str, done: Callable[[], None] = lambda: None) -> DataFrame:
    """fn for each group of bounded size: one exchange by the keys, a sort, and no per-group round trip. done is
    called when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for key, group in keyed_groups(batches, keys):
                yield from fn(key, group)
        finally:
            done()
            release()

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _length(x: str | int) -> int:
    return len(x) if isinstance(x, str) else x.bit_length() // 8


class Bounded(dict):
    """A memo of make(key), a small value, for strings, or tuples of strings and numbers, of at most `longest`
    characters; it starts anew at `most` entries. Longer keys are made each time, so its bytes are bounded too."""

    def __init__(self, make: Callable, most: int = 100_000, longest: int = 32):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if (sum(map(_length, key)) if isinstance(key, tuple) else len(key)) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that grows with the table: never broadcast, as files that are small by their encoding, or
    rows that compress well, are many times as large in the driver."""
    return df.hint("merge")


def free(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
