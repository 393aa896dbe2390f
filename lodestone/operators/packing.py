"""Packing token sequences into fixed rows: best fit with cropping, best fit with padding, preference batches.

Packing is a loop over a bounded buffer. The documents of a rank are cut into segments of consecutive places, which are
packed side by side, each by a kernel that holds its buffer and one row; what the buffers of neighbouring segments still
hold at their ends is packed together in a second round. So tasks grow with the table, whatever the number of ranks, and
a rank of one segment gets the rows that one loop over it gives. Until then ids are compressed cells, on disk and on their way.
"""

from __future__ import annotations

import bisect
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import arrays as A

#: Places of a rank that make a segment, and segments whose rests are packed together.
SEGMENT, SEGMENTS = 16_384, 16
#: Rows of a batch of cells or lists.
BATCH = 256


class _Buffer:
    """Waiting sequences by length, of equal lengths the first come goes first. Lengths up to `limit` that are present
    are bits of one number, so that the longest that fits is its highest bit below the room; longer ones never fit and
    stand in a list, as only the shortest of them is ever asked for."""

    def __init__(self, limit: int):
        self.limit, self.bits, self.n = limit, 0, 0
        self.by: dict[int, deque] = {}
        self.longer: list[tuple[int, int]] = []
        self.held: dict[int, object] = {}

    def add(self, length: int, item) -> None:
        if length <= self.limit:
            self.by.setdefault(length, deque()).append((self.n, item))
            self.bits |= 1 << length
        else:
            bisect.insort(self.longer, (length, self.n))
            self.held[self.n] = item
        self.n += 1

    def __len__(self) -> int:
        return sum(map(len, self.by.values())) + len(self.longer)

    def best(self, room: int):
        """The longest that fits, or None."""
        n = (self.bits & ((1 << (min(room, self.limit) + 1)) - 1)).bit_length() - 1
        return self._pop(n) if n > 0 else None

    def shortest(self):
        if self.bits:
            return self._pop((self.bits & -self.bits).bit_length() - 1)
        return self.held.pop(self.longer.pop(0)[1])

    def _pop(self, length: int):
        queue = self.by[length]
        item = queue.popleft()[1]
        if not queue:
            del self.by[length]
            self.bits ^= 1 << length
        return item

    def rest(self) -> list:
        """All that waits, in the order in which it came."""
        every = [x for q in self.by.values() for x in q] + list(self.held.items())
        return [item for _, item in sorted(every, key=lambda x: x[0])]


def _joined(parts: list):
    """Parts of a row as one: lists as a list, arrays as an array."""
    return np.concatenate(parts) if parts and isinstance(parts[0], np.ndarray) else list(chain.from_iterable(parts))


class Cropped:
    """Best fit with cropping, fed one document at a time: rows of exactly capacity ids, and the pieces that they are
    made of, (tag, ids taken, ids that the document has). If no waiting document fits, the shortest fills the row and
    the rest of it is discarded."""

    def __init__(self, capacity: int, buffer: int = 1000):
        self.capacity, self.buffer = capacity, buffer
        self.waiting, self.n = _Buffer(capacity), 0
        self.parts, self.used = [], 0
        self.pieces: list[tuple] = []

    @property
    def ids(self):
        """The row that is not full."""
        return _joined(self.parts)

    def _take(self, tag, ids) -> Iterator[tuple[list[int], list[tuple]]]:
        part = ids[: self.capacity - self.used]
        self.parts.append(part)
        self.used += len(part)
        self.pieces.append((tag, len(part), len(ids)))
        if self.used == self.capacity:
            yield self.ids, self.pieces
            self.parts, self.used, self.pieces = [], 0, []

    def _step(self) -> Iterator[tuple[list[int], list[tuple]]]:
        got = self.waiting.best(self.capacity - self.used)
        self.n -= 1
        yield from self._take(*(self.waiting.shortest() if got is None else got))

    def resume(self, tag, ids) -> None:
        """A document that an earlier round had placed in a row that was not full."""
        for _ in self._take(tag, ids):
            raise AssertionError("the row was full")

    def wait(self, length: int, ids, tag=None) -> None:
        self.waiting.add(length, (tag, ids))
        self.n += 1

    def add(self, tag, ids) -> Iterator[tuple[list[int], list[tuple]]]:
        """Rows that are full once this document waits too; they are packed while the buffer is full."""
        if len(ids):
            self.wait(len(ids), ids, tag)
        while self.n >= self.buffer:
            yield from self._step()

    def finish(self) -> Iterator[tuple[list[int], list[tuple]]]:
        """Rows that what waits still fills."""
        while self.n:
            yield from self._step()

    def rest(self) -> list[tuple[bool, object, list[int]]]:
        """(whether it stands in the row that is not full, tag, ids) of what no row has."""
        out = [(True, tag, part) for (tag, _, _), part in zip(self.pieces, self.parts, strict=True)]
        return out + [(False, *x) for x in self.waiting.rest()]


class Padded:
    """Best fit with padding, fed one conversation (ids, mask) at a time: rows of capacity ids and mask, padded with
    mask 0 once nothing that waits fits, and their pieces. Only what is longer than a row is cut."""

    def __init__(self, capacity: int, pad: int, buffer: int = 100):
        self.capacity, self.pad, self.buffer = capacity, pad, buffer
        self.waiting, self.n = _Buffer(capacity), 0
        self.parts, self.used = [], 0
        self.pieces: list[tuple] = []

    def _close(self) -> Iterator[tuple[list[int], list[int], list[tuple]]]:
        room, (ids, mask) = self.capacity - self.used, zip(*self.parts, strict=True)
        filled = lambda parts, value: _joined([*parts, np.full(room, value, np.int32) if isinstance(parts[0], np.ndarray) else [value] * room])
        yield filled(ids, self.pad), filled(mask, 0), self.pieces
        self.parts, self.used, self.pieces = [], 0, []

    def _take(self, tag, item) -> Iterator[tuple[list[int], list[int], list[tuple]]]:
        ids, mask = item[0][: self.capacity], item[1][: self.capacity]
        self.parts.append((ids, mask))
        self.used += len(ids)
        self.pieces.append((tag, len(ids), len(item[0])))
        if self.used == self.capacity:
            yield from self._close()

    def _step(self) -> Iterator[tuple[list[int], list[int], list[tuple]]]:
        got = self.waiting.best(self.capacity - self.used)
        if got is None:
            yield from self._close()
        else:
            self.n -= 1
            yield from self._take(*got)

    def resume(self, tag, item) -> None:
        for _ in self._take(tag, item):
            raise AssertionError("the row was full")

    def add(self, tag, item) -> Iterator[tuple[list[int], list[int], list[tuple]]]:
        if len(item[0]):
            self.waiting.add(min(len(item[0]), self.capacity), (tag, item))
            self.n += 1
        while self.n >= self.buffer:
            yield from self._step()

    def finish(self) -> Iterator[tuple[list[int], list[int], list[tuple]]]:
        while self.n:
            yield from self._step()
        if self.used:
            yield from self._close()

    def rest(self) -> list[tuple[bool, object, tuple]]:
        out = [(True, tag, part) for (tag, _, _), part in zip(self.pieces, self.parts, strict=True)]
        return out + [(False, *x) for x in self.waiting.rest()]


class Feed:
    """What a packer is fed in one round: (tag, document) of each, what an earlier round had placed in a row that was
    not full, and afterwards `left`, what this round has not packed."""

    def __init__(self, documents: Iterable[tuple], placed: Iterable[tuple] = ()):
        self.documents, self.placed, self.left = documents, placed, []


def _packed(packer: Cropped | Padded, docs: Iterable | Feed, finish: bool) -> Iterator[tuple]:
    feed = docs if isinstance(docs, Feed) else Feed(enumerate(docs))
    for tag, item in feed.placed:
        packer.resume(tag, item)
    for tag, item in feed.documents:
        yield from packer.add(tag, item)
    if finish:
        yield from packer.finish()
    feed.left = packer.rest()


def pack_cropped(docs: Iterable[list[int]] | Feed, capacity: int, buffer: int = 1000, finish: bool = True) -> Iterator:
    """Rows of exactly capacity ids. If no waiting document fits, the shortest fills the row and the rest of it
    is discarded. finish goes on when the input has ended, as long as rows can be filled. A Feed gives rows with their
    pieces."""
    rows = _packed(Cropped(capacity, buffer), docs, finish)
    return rows if isinstance(docs, Feed) else (ids for ids, _ in rows)


def pack_padded(conversations: Iterable[tuple[list[int], list[int]]] | Feed, capacity: int, pad: int, buffer: int = 100, finish: bool = True) -> Iterator:
    """Rows of capacity (ids, mask): best fit, and padding with mask 0 once nothing fits. Nothing is cropped."""
    rows = _packed(Padded(capacity, pad, buffer), conversations, finish)
    return rows if isinstance(conversations, Feed) else ((ids, mask) for ids, mask, _ in rows)


def _cell(a: np.ndarray) -> bytes:
    """Numbers of 32 bits as compressed bytes: their first bytes, their second ones and so on, then which are not null."""
    fine = np.array([x is not None for x in a], np.uint8) if a.dtype == object else np.zeros(0, np.uint8)
    a = np.array([x or 0 for x in a], np.int32) if a.dtype == object else np.ascontiguousarray(a, np.int32)
    body = a.view(np.uint8).reshape(-1, 4).T.tobytes() + fine.tobytes()
    return len(a).to_bytes(4, "little") + len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def _uncell(cell: bytes) -> np.ndarray:
    n, size = int.from_bytes(cell[:4], "little"), int.from_bytes(cell[4:12], "little")
    body = np.frombuffer(pa.decompress(cell[12:], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    a = body[: 4 * n].reshape(4, n).T.copy().view(np.int32).reshape(n)
    return a if size == 4 * n else np.where(body[4 * n :] == 1, a.astype(object), None)


def _values(c: pa.Array) -> Iterator[np.ndarray | None]:
    """Of a column of lists or cells an array of 32 bits each, of its own, which keeps no batch in memory."""
    if pa.types.is_binary(c.type):
        yield from (None if x is None else _uncell(x) for x in (v.as_py() for v in c))
        return
    c = c.cast(pa.list_(pa.int32()))
    flat = c.values.to_numpy(zero_copy_only=False) if not c.values.null_count else np.array(c.values.to_pylist(), object)
    ends = c.offsets.to_pylist()
    yield from (flat[lo:hi].copy() if fine else None for fine, lo, hi in zip(c.is_valid().to_pylist(), ends, ends[1:], strict=False))


def _rows(b: pa.RecordBatch, fields: list[str]) -> Iterator[dict]:
    """The rows of a batch, with arrays for the lists or cells of the fields."""
    plain = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n not in fields}
    for i, own in enumerate(zip(*(_values(b.column(b.schema.get_field_index(f))) for f in fields), strict=True)):
        yield {n: v[i] for n, v in plain.items()} | dict(zip(fields, own, strict=True))


def _cells(rows: Iterable) -> pa.Array:
    return pa.array([None if r is None else _cell(r) for r in rows], pa.binary())


def _lists(rows: Iterable) -> pa.Array:
    """Arrays as a column of lists."""
    rows = list(rows)
    held = [r for r in rows if r is not None]
    ends = pa.array(np.cumsum([0, *(0 if r is None else len(r) for r in rows)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(held) if held else np.zeros(0, np.int32), pa.int32()), mask=pa.array([r is None for r in rows], pa.bool_()))


def _recoded(df: DataFrame, columns: tuple[str, ...], kind: str, of) -> DataFrame:
    schema = df.withColumns({c: F.lit(None).cast(kind) for c in columns}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, BATCH) for lo in range(0, whole.num_rows, BATCH)):
                yield pa.RecordBatch.from_arrays([of(_values(v)) if n in columns else v for n, v in zip(b.schema.names, b.columns, strict=True)], names=b.schema.names)

    return df.mapInArrow(run, schema)


def pressed(df: DataFrame, *columns: str) -> DataFrame:
    """df with its columns of ids as cells, which take about a quarter of what lists take on disk and in a shuffle."""
    return _recoded(df, columns, "binary", _cells)


def loosened(df: DataFrame, *columns: str) -> DataFrame:
    """df with cells as array<int> again."""
    return _recoded(df, columns, "array<int>", _lists)


def _kernel(df: DataFrame, pos: str, world: int, columns: list[str], schema: str, of) -> DataFrame:
    """The columns of schema, whose last may be pieces; of(rows, finish, placed) -> (feed, rows) of a packer for rows
    in order."""
    from lodestone.sources.shared import table

    schema, wanted, _ = schema.partition(", pieces")
    place = F.coalesce(F.col(pos), F.lit(0)).cast("bigint")
    inner = "rank int, segment bigint, n bigint, seq bigint, placed boolean, " + schema.partition("row_id bigint, ")[2].replace("array<int>", "binary") + ", pieces array<struct<pos:bigint,taken:int,length:int>>"
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names = [c.split()[0] for c in inner.split(", ")]
    target = pa.schema([(c.split()[0], kinds.get(c.split()[1], pa.list_(pa.struct([("pos", pa.int64()), ("taken", pa.int32()), ("length", pa.int32())])))) for c in inner.split(", ")])
    fields = names[5:-1]

    def kernel(finish: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = dict(zip(names, map(list, zip(*held, strict=True)), strict=True))
            made = pa.RecordBatch.from_pydict(made | {f: _cells(made[f]) for f in fields}, schema=target)
            held.clear()
            return made

        each = (r for b in batches for r in _rows(b, fields))
        for (rank, segment), rows in groupby(each, lambda r: (r["rank"], r["segment"])):
            # of what segments had placed in rows, that of the first goes on as a row
            first = next(rows)
            placed = []
            while first is not None and first["placed"] and (not placed or first["of"] == placed[0]["of"]):
                placed.append(first)
                first = next(rows, None)
            feed, out = of(rows if first is None else chain([first], rows), finish, placed)
            for n, (*row, pieces) in enumerate(out):
                held.append((rank, segment, n, None, None, *row, pieces))
                if len(held) == 64:
                    yield batch()
            for seq, (in_row, tag, item) in enumerate(feed.left):
                item = item if isinstance(item, tuple) else (item,)
                held.append((rank, segment, None, seq, in_row, *item, [(tag, 0, len(item[0]))]))
                if len(held) == 64:
                    yield batch()
        if held:
            yield batch()

    of_segment = F.floor(place / (world * SEGMENT)).cast("bigint")
    ranked = df.select(F.pmod(place, F.lit(world)).cast("int").alias("rank"), of_segment.alias("segment"), F.lit(False).alias("placed"), of_segment.alias("of"), place.alias("pos_"), *[F.col(c).alias(f) for c, f in zip(columns, fields, strict=True)])
    first = pressed(ranked, *fields).repartition("rank", "segment").sortWithinPartitions("rank", "segment", "pos_").mapInArrow(lambda b: kernel(False, b), inner)
    first = table(first, "packed")
    rest = first.filter("seq is not null").select("rank", F.floor(F.col("segment") / SEGMENTS).cast("bigint").alias("segment"), "placed", F.col("segment").alias("of"), F.col("pieces")[0]["pos"].alias("pos_"), "seq", *fields)
    second = rest.repartition("rank", "segment").sortWithinPartitions("rank", "segment", F.desc("placed"), "of", "seq").drop("seq").mapInArrow(lambda b: kernel(True, b), inner)
    second = table(second.filter("n is not null"), "rests")
    # numbers of a rank: rows of its segments, then those of their rests
    rounds = first.filter("n is not null").withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    before = Window.partitionBy("rank").orderBy("round", "segment").rowsBetween(Window.unboundedPreceding, -1)  # a row a segment
    starts = rounds.groupBy("rank", "round", "segment").agg(F.count(F.lit(1)).alias("rows_")).withColumn("start_", F.coalesce(F.sum("rows_").over(before), F.lit(0))).drop("rows_")
    # a row a segment is broadcast, or all rows of ids would be shuffled once more to meet it
    numbered = rounds.join(F.broadcast(starts), ["rank", "round", "segment"]).select("rank", (F.col("start_") + F.col("n")).alias("row_id"), *fields, *(["pieces"] if wanted else []))
    return loosened(numbered, *fields)


def packed_rows(df: DataFrame, capacity: int, pos: str = "pos", ids: str = "ids", world: int = 8, buffer: int = 1000, pieces: bool = False) -> DataFrame:
    """rank, row_id, tokens of length capacity: best fit with cropping in each rank. With pieces also the documents
    that a row is made of, in order: (pos, ids taken, ids it has)."""

    def of(rows, finish: bool = True, placed: Iterable = ()):
        tagged = lambda xs: ((x["pos_"], x["tokens"]) for x in xs if x["tokens"] is not None and len(x["tokens"]))
        feed = Feed(tagged(rows), tagged(placed))
        return feed, pack_cropped(feed, capacity, buffer, finish)

    return _kernel(df, pos, world, [ids], "rank int, row_id bigint, tokens array<int>" + ", pieces" * pieces, of)


def padded_rows(df: DataFrame, capacity: int, pad: int, pos: str = "pos", world: int = 8, buffer: int = 100, pieces: bool = False) -> DataFrame:
    """rank, row_id, tokens, mask of length capacity: best fit with padding in each rank, with pieces as above."""

    def of(rows, finish: bool = True, placed: Iterable = ()):
        tagged = lambda xs: ((x["pos_"], (x["tokens"], x["mask"])) for x in xs if x["tokens"] is not None and len(x["tokens"]))
        feed = Feed(tagged(rows), tagged(placed))
        return feed, pack_padded(feed, capacity, pad, buffer, finish)

    return _kernel(df, pos, world, ["ids", "mask"], "rank int, row_id bigint, tokens array<int>, mask array<int>" + ", pieces" * pieces, of)


def preference_batches(df: DataFrame, batch: int, minibatch: int, devices: int = 1, pos: str = "pos", epochs: int = 1) -> DataFrame:
    """Places of (chosen, rejected) pairs in batches: step, minibatch_id, device, slot, side, and with several epochs
    the epoch of each.

    A minibatch takes minibatch * devices pairs; each device gets its chosen ones, then its rejected ones. Pairs are
    taken epoch after epoch, and what an epoch leaves of a minibatch or batch goes on in the next; only what does not
    fill a batch after the last is left.
    """
    per, steps = minibatch * devices, batch // minibatch
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    rows = df.join(F.broadcast(n)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("at_", F.col("epoch") * F.col("n_") + F.col(pos))
    rows = rows.withColumns({"mini_": F.floor(F.col("at_") / per), "in_": F.pmod(F.col("at_"), F.lit(per))})
    rows = rows.withColumn("step", F.floor(F.col("mini_") / steps)).filter(F.col("step") < F.floor(F.floor(F.col("n_") * epochs / per) / steps))
    rows = rows.withColumns({"minibatch_id": F.pmod("mini_", F.lit(steps)), "device": F.floor(F.col("in_") / minibatch), "place_": F.pmod(F.col("in_"), F.lit(minibatch))})
    sides = rows.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    out = sides.withColumn("slot", F.col("place_") + F.when(F.col("side") == "rejected", minibatch).otherwise(0)).drop("mini_", "in_", "at_", "place_", "n_")
    return out if epochs > 1 else out.drop("epoch")


def fixed_batch(df: DataFrame, size: int, length: int, pad: int, pos: str = "pos") -> DataFrame:
    """(inputs, targets) of the first `size` conversations by place, padded; the batch that every step evaluates."""
    rows = df.filter(F.col(pos) < size).withColumn("s_", A.shift(F.slice("ids", 1, length + 1), F.slice("mask", 1, length + 1)))
    return rows.select(pos, A.pad(F.col("s_.inputs"), F.lit(length), pad).alias("inputs"), A.pad(F.col("s_.targets"), F.lit(length), A.IGNORE).alias("targets"))


def global_rows(df: DataFrame, per_device: int, devices: int, world: int, rank: str = "rank", row: str = "row_id") -> DataFrame:
    """df with step, and device of each packed row: the assembly of a global batch from its ranks' rows."""
    own = per_device * devices
    return df.withColumns({"step": F.floor(F.col(row) / own), "device": F.col(rank) * devices + F.floor(F.pmod(F.col(row), F.lit(own)) / per_device)})


def utilisation(df: DataFrame, capacity: int, tokens: str = "tokens") -> DataFrame:
    """rows and the share of their capacity in use."""
    return df.agg(F.count(F.lit(1)).alias("rows"), (F.sum(F.size(tokens)) / (F.count(F.lit(1)) * capacity)).alias("used"))


def epochs(df: DataFrame, n: int, pos: str = "pos") -> DataFrame:
    """n bounded passes over a source, in place of an endless one."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("n_ = 1").drop("n_")
