"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are compared as sets of shingles of five words (lower-cased runs without white space, stripped of
punctuation at both ends; a text of fewer words is one shingle). Pairs whose sets have a Jaccard
similarity of at least `threshold` are linked.

1. Texts with equal word sequences form a class; from here on a class is one row with its MinHash values.
2. Bands of MinHash values give buckets. Within a bucket, pairs are compared a few MinHash values at a
   time and dropped as soon as the posterior probability that their similarity reaches the threshold
   (uniform prior) is below `tolerance`. A pair that met in an earlier band is not compared again. What
   survives leaves the bucket as a spanning forest and, for each class, a mask of the places of those that it
   was met with, never as a list of pairs.
3. Connected survivors form groups, dealt into units of bounded size (`components.units`). A class comes to the
   units that hold a survivor of its own, as its compressed text: a third of what its shingles take. There the pairs
   that survive, found again by their MinHash values, are verified exactly on their shingle sets, each pair once; the
   sums of links and a spanning forest come out.

Buckets and groups above a fixed size are dealt into blocks by hash, and each pair of blocks is a task
unit of bounded size, so no bucket, group or class is held by one task. Nothing is capped or dropped.

The words of a text of nothing but punctuation are its tokens as they are, so that exact copies link. Null,
empty and blank texts have no shingles: they link with nothing and are their own component.
Rows with a null id are returned unlinked with a null component; rows that repeat an id and text count as one;
rows that repeat an id with another text are rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Bounded, Tables, arrow_schema, batch, grouped_arrow, release, slices
from lodestone.llm.components import connected, forest, met_places, place, units
from lodestone.llm.vectors import blocked

BANDS, BAND = 30, 4
HASHES = BANDS * BAND
STEP = 8
#: Members of one block of a bucket; members and shingles of one block of a group.
BUCKET_MEMBERS, BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1024, 500_000
#: Bits of a filter on keys before a shuffle, at most: 16 MB.
FILTER_BITS = 1 << 27
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "¡§«·»¿‘’“”„–—…"

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _word(token: str) -> int:
    """Hash of a token as a word; 0 if nothing but punctuation is in it."""
    w = token.lower().strip(PUNCTUATION)
    return xxhash.xxh3_64_intdigest(w) | 1 if w else 0


_words = Bounded(_word)


def _shingled(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words and the start of each text's; all shingles and the start of each text's."""
    each = []
    for t in texts:
        tokens = t.split() if t else []
        each.append(list(filter(None, map(_words.__getitem__, tokens))) or [xxhash.xxh3_64_intdigest(x) | 1 for x in tokens])
    counts = np.array([len(e) for e in each], np.int64)
    starts = np.concatenate(([0], np.cumsum(counts)))
    words = np.fromiter((w for e in each for w in e), np.uint64, int(starts[-1]))
    made = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    at = np.concatenate(([0], np.cumsum(made)))
    first = np.repeat(starts[:-1] - at[:-1], made) + np.arange(at[-1])  # of each shingle's words
    end = np.repeat(starts[1:], made)
    h = np.zeros(len(first), np.uint64)
    for j in range(width):
        i = first + j
        w = words[np.minimum(i, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
        h += np.where(i < end, w, np.uint64(0)) * _PLACE[j]
    h ^= h >> np.uint64(29)
    h *= _FOLD
    h ^= h >> np.uint64(32)
    return words, starts, h, at


def _parts(batches: Iterator[pa.RecordBatch], text: int | str) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes of text; the memo of words goes when the task ends."""
    try:
        for b in batches:
            for lo, hi in slices(b.column(text)):
                yield b.slice(lo, hi - lo)
    finally:
        _words.clear()
        release()


def _class_keys(words: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """A key of each text's words; None without any."""
    return [xxhash.xxh3_128_digest(words[i:j].tobytes()) if j > i else None for i, j in zip(starts, starts[1:], strict=False)]


def _minhash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """HASHES values of 16 bits for each text that has shingles."""
    out = np.empty((len(at) - 1, HASHES), np.uint16)
    if len(at) > 1:
        for k in range(HASHES):
            low = np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], at[:-1])
            out[:, k] = (low * _FOLD) >> np.uint64(48)
    return out


def signatures(docs: DataFrame, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_key (null without words), sig, weight (number of shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = arrow_schema(schema)
        for part in _parts(batches, 1):
            words, starts, h, at = _shingled(part.column(1).to_pylist(), width)
            some = np.flatnonzero(np.diff(starts) > 0)
            sigs = _minhash(h, np.append(at[:-1][some], at[-1]))
            packed = [None] * part.num_rows
            for i, s in zip(some.tolist(), sigs, strict=True):
                packed[i] = s.tobytes()
            yield batch(out, doc_id=part.column(0), class_key=_class_keys(words, starts), sig=packed, weight=np.diff(at).astype("i4"))

    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, class_key binary, sig binary, weight int"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones to go on): with a uniform prior the posterior of the similarity
    after m of n is Beta(m + 1, n - m + 1), whose mass above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, 0
        while (mass := mass + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def surviving(a: np.ndarray, b: np.ndarray, band: int | None, rules: list[tuple[int, int]], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures that pass every rule and agree on this band and on no earlier one, or, with
    band None, on any band."""
    left, right = [], []
    at = slice(band * BAND, band * BAND + BAND) if band is not None else slice(0, STEP)
    least = BAND if band is not None else rules[0][1]
    for lo in range(0, len(a), 64):
        rows = a[lo : lo + 64]
        # 16 bits stand for a value
        i, j = np.nonzero((rows[:, None, at] == b[None, :, at]).sum(2, dtype=np.int8) >= least)
        if same:
            i, j = i[keep := j > i + lo], j[keep]
        for part in range(0, len(i), 65536):
            pi, pj = i[part : part + 65536], j[part : part + 65536]
            hits = np.zeros(len(pi), np.int16)
            for n, m in rules:
                hits += (rows[pi, n - STEP : n] == b[pj, n - STEP : n]).sum(1, dtype=np.int16)
                go = hits >= m
                pi, pj, hits = pi[go], pj[go], hits[go]
                if not len(pi):
                    break
            if len(pi) and band != 0:
                until = BANDS if band is None else band
                seen = (rows[pi, : until * BAND] == b[pj, : until * BAND]).reshape(len(pi), until, BAND).all(2).any(1)
                go = seen if band is None else ~seen
                pi, pj = pi[go], pj[go]
            left.append((pi + lo).astype(np.int32))  # a block has few members
            right.append(pj.astype(np.int32))
    none = np.zeros(0, np.int32)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of sets[i] with sets[j] for each of these pairs; i is sorted."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, out = np.zeros(len(known), np.uint8), np.zeros(len(i), np.int64)
    first = np.flatnonzero(np.diff(i, prepend=-1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
        own = flat[starts[i[lo]] : starts[i[lo] + 1]]
        mark[own] = 1
        while lo < hi:  # some partners at a time
            ends = np.cumsum(sizes[j[lo:hi]])
            n = max(1, int(np.searchsorted(ends, most)))
            with_, ends = j[lo : lo + n], ends[:n]
            begin = ends - sizes[with_]
            got = mark[flat[np.repeat(starts[with_] - begin, sizes[with_]) + np.arange(ends[-1])]]
            out[lo : lo + n] = np.add.reduceat(got, begin, dtype=np.int64)
            lo += n
        mark[own] = 0
    return out


def _buckets(classes: DataFrame, threshold: float, tolerance: float, table: Tables) -> DataFrame:
    """The pairs of each bucket that survive pruning: edges (a, b) of a spanning forest of them, and for each class
    (a) a mask of the places of those that it was met with."""
    rules = least_matches(threshold, tolerance)

    def bands(batches):
        out = arrow_schema("class_key binary, band int, bucket bigint")
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)
                for k in range(BANDS):
                    v = np.ascontiguousarray(sig[:, k * BAND : (k + 1) * BAND]).view(np.uint64)[:, 0]
                    h = (v ^ np.uint64((k + 1) * 0x9E3779B97F4A7)) * _FOLD  # a bijection of the band's four values
                    h = (h ^ (h >> np.uint64(31))).view(np.int64)
                    yield batch(out, class_key=part.column(0), band=np.full(len(h), k, "i4"), bucket=h)

    rows = classes.select("class_key", "sig").mapInArrow(bands, "class_key binary, band int, bucket bigint")
    full = rows.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # a table of its own, so that the join below has plain exchanges and AQE may split a hot bucket
    full = table(full.withColumn("blocks", F.ceil(F.col("n") / BUCKET_MEMBERS).cast("int")), "buckets")
    met = table(blocked(_likely(rows, full, "band", "bucket").join(full, ["band", "bucket"]), "blocks", "class_key"), "met")
    met = met.join(_likely(classes.select("class_key", "sig"), met, "class_key"), "class_key").select("band", "bucket", "lo", "hi", "own", "class_key", place("class_key").alias("place"), "sig")

    def prune(key, rows):
        band, _, lo, hi = key
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        if lo == hi:
            i, j = surviving(sig, sig, band, rules, True)
        else:
            own = rows.column("own").to_numpy()
            x, y = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            i, j = surviving(sig[x], sig[y], band, rules, False)
            i, j = x[i], y[j]
        if len(i):
            yield met_rows(rows.column("class_key").to_pylist(), rows.column("place").to_numpy(), i, j, "binary")

    return grouped_arrow(met, ["band", "bucket", "lo", "hi"], prune, "a binary, b binary, mask bigint")


def met_rows(nodes: list, places: np.ndarray, i: np.ndarray, j: np.ndarray, kind: str) -> pa.RecordBatch:
    """What `components.units` takes of the candidate pairs (i, j) of these nodes."""
    tree, some = forest(len(nodes), i, j), np.unique(np.concatenate((i, j)))
    masks = met_places(len(nodes), i, j, places)[some]
    out = arrow_schema(f"a {kind}, b {kind}, mask bigint")
    return batch(out, a=[nodes[p] for p, _ in tree] + [nodes[p] for p in some.tolist()], b=[nodes[q] for _, q in tree] + [None] * len(some), mask=[None] * len(tree) + masks.tolist())


def _likely(rows: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """rows without most of those that wanted has no equal of, so that they are not shuffled for the join with it: a
    bitmap of hashes of the wanted keys is broadcast, 16 to 32 bits a row of wanted and FILTER_BITS at most. Where
    wanted outgrows that it lets more and more others through, which the join after it leaves out."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * wanted.count()).bit_length()))
    place = lambda: F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    # dealt by part before they are put together, as a whole bitmap from each task would be more to shuffle
    marks = wanted.select(F.bitmap_bucket_number(place()).alias("part_"), F.bitmap_bit_position(place()).alias("bit_")).repartition("part_")
    bitmap = marks.groupBy("part_").agg(F.bitmap_construct_agg("bit_").alias("bits_"))
    met = rows.withColumn("at_", place()).join(F.broadcast(bitmap), F.bitmap_bucket_number("at_") == F.col("part_"))
    bit = F.bitmap_bit_position("at_")
    byte = F.conv(F.hex(F.substring("bits_", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.filter(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def _verified(docs: DataFrame, classes: DataFrame, found: DataFrame, threshold: float, tolerance: float, width: int, table: Tables) -> DataFrame:
    """Rows (a, null, links) with links of the class a, summed elsewhere, and edges (a, b, null) of a spanning
    forest of all links."""
    rules = least_matches(threshold, tolerance)
    dealt = table(units(found, classes.select(F.col("class_key").alias("node"), "weight"), BLOCK_MEMBERS, BLOCK_SHINGLES, table), "units").withColumnRenamed("node", "class_key")
    wanted = dealt.select("class_key").distinct().join(_likely(classes.select("class_key", F.col("min_doc").alias("doc_id"), "copies", "sig"), dealt, "class_key"), "class_key")
    wanted = table(wanted, "wanted")

    def pack(batches):
        out = arrow_schema(schema)
        squeeze = zstandard.ZstdCompressor().compress
        for part in _parts(batches, 1):
            words, starts, _, _ = _shingled(part.column(1).to_pylist(), 1)
            packed = [squeeze(t) for t in part.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
            yield batch(out, doc_id=part.column(0), class_key=_class_keys(words, starts), packed=packed)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, class_key binary, packed binary"
    # the smallest id stands for its class; rows that repeat it may hold another text, so the key decides. One exchange by
    # both serves the rows that repeat both, the join with what is wanted and the join with the units
    both = ["doc_id", "class_key"]
    own = _likely(docs.select("doc_id", "text"), wanted, "doc_id").mapInArrow(pack, schema).filter("class_key is not null").dropDuplicates(both)
    placed = dealt.join(wanted.select(*both), "class_key")
    met = own.join(wanted, both).join(placed, both).select("component", "lo", "hi", "own", "class_key", "copies", "sig", "packed")
    result = "a binary, b binary, links bigint"

    def sets(packed):
        """The shingles of each text, some texts at a time."""
        expand = zstandard.ZstdDecompressor().decompress
        texts = pa.array(map(expand, packed.to_pylist()), pa.binary()).cast(pa.string())
        for lo, hi in slices(texts):
            _, _, h, at = _shingled(texts.slice(lo, hi - lo).to_pylist(), width)
            yield from (np.unique(h[p:q]) for p, q in zip(at, at[1:], strict=False))

    def verify(key, rows):
        _, lo, hi = key
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        own = rows.column("own").to_numpy()
        x, y = (np.arange(len(sig)),) * 2 if lo == hi else (np.flatnonzero(own == lo), np.flatnonzero(own == hi))
        i, j = surviving(sig[x], sig[y], None, rules, lo == hi)
        if not len(i):
            return
        i, j = x[i], y[j]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        each = list(sets(rows.column("packed")))
        n = np.array([len(e) for e in each])
        both = intersections(each, i, j)
        linked = both >= threshold * (n[i] + n[j] - both) - 1e-9
        i, j = i[linked], j[linked]
        keys, copies = rows.column("class_key").to_pylist(), rows.column("copies").to_numpy()
        links = np.bincount(i, copies[j], len(keys)) + np.bincount(j, copies[i], len(keys))
        tree, some = forest(len(keys), i, j), np.flatnonzero(links).tolist()
        out = arrow_schema(result)
        yield batch(out, a=[keys[k] for k in some] + [keys[p] for p, _ in tree], b=[None] * len(some) + [keys[q] for _, q in tree], links=links[some].astype(np.int64).tolist() + [None] * len(tree))

    return grouped_arrow(met, ["component", "lo", "hi"], verify, result, _words.clear)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5, tolerance: float = 1e-5, doc_id: str = "doc_id", text: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, class_id, n_links, component_id, kept of every row of docs; with keys also class_key and component_key,
    which tell rows apart that share an id.

    class_id is the smallest id with the same words, n_links the number of other documents that are
    linked directly (copies included), component_id the smallest id that links reach, and kept says
    that a document is the one of its component that stays.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = Tables(docs.sparkSession)
    rows = table(signatures(docs, width), "signatures")
    distinct = rows.filter("doc_id is not null and class_key is not null").dropDuplicates(["class_key", "doc_id"])
    classes = table(distinct.groupBy("class_key").agg(F.min("doc_id").alias("min_doc"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("weight").alias("weight")), "classes")
    found = table(_buckets(classes, threshold, tolerance, table), "found")
    verified = table(_verified(docs, classes, found, threshold, tolerance, width, table), "verified")
    links = verified.filter("b is null").groupBy(F.col("a").alias("class_key")).agg(F.sum("links").alias("links"))
    reached = connected(verified.filter("b is not null").select("a", "b"))
    ids = reached.join(classes.select(F.col("class_key").alias("node"), "min_doc"), "node")
    ids = ids.join(ids.groupBy("component").agg(F.min("min_doc").alias("component_id")), "component").select(F.col("node").alias("class_key"), "component_id", F.col("component").alias("component_key"))
    info = classes.select("class_key", "min_doc", "copies").join(links, "class_key", "left").join(ids, "class_key", "left")
    info = info.select("class_key", "min_doc", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "min_doc").alias("component_id"), F.coalesce("component_key", "class_key").alias("component_key"))
    info = table(info, "info")  # so that AQE may split a class of very many copies
    table.drop_but(rows, info)
    out = rows.drop("sig", "weight").withColumn("class_key", F.when(F.col("doc_id").isNotNull(), F.col("class_key"))).join(info, "class_key", "left")
    return out.select(
        "doc_id",
        F.coalesce("min_doc", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
        *(["class_key", "component_key"] if keys else []),
    )


def with_class_key(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the class_key of each row: equal for texts with equal words, null without words."""

    def run(batches):
        out = arrow_schema(schema)
        for part in _parts(batches, text):
            words, starts, _, _ = _shingled(part.column(text).to_pylist(), 1)
            yield batch(out, **dict(zip(part.schema.names, part.columns, strict=True)), class_key=_class_keys(words, starts))

    schema = docs.withColumn("class_key", F.lit(None).cast("binary")).schema
    return docs.mapInArrow(run, schema)
