"""Byte-pair tokenizer: training from chunk counts, encoding, decoding, conversation rendering."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import Tables

#: Up to so many distinct pieces, or runs of the best pairs, the driver learns the merges; more stay on the executors.
DRIVER_PIECES = 100_000
#: Bytes of a batch that are mapped at a time, about.
SLICE = 1 << 20
#: Pairs that learn_merges_apart takes at least in its first round; the next ones take up to twice as many each, or WIDER
#: times as many while they leave few runs.
NAMED, WIDER = 32, 4
#: Pieces of a task of learn_merges_apart, about, and symbols of a block, of which it holds one at a time.
TASK_PIECES = 250_000
SYMBOLS = 1 << 20

# The pre-split pattern and the special tokens, in the order of their ids after the ranks.
SPLIT_PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
SPECIAL_TOKENS = (
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|tool_call_start|>",
    "<|tool_arg|>",
    "<|tool_val|>",
    "<|tool_call_end|>",
    "<|tool_result_start|>",
    "<|tool_result_end|>",
)


def chunks(text: Column) -> Column:
    """Pre-split pieces of a text. Classes are Unicode ones, or white space beyond ASCII would split otherwise."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each piece occurs in all texts; summed on the map side first."""
    return docs.select(F.explode(chunks(F.col(text))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def learn_merges(counts: dict[bytes, int], n_merges: int) -> list[tuple[bytes, bytes]]:
    """Byte-pair merges of weighted pieces: the most frequent pair first, the smallest of equals."""
    return _learned([[bytes([b]) for b in w] for w in counts], list(counts.values()), n_merges)


def _learned(words: list[list[bytes]], weight: list[int], n_merges: int, certain=None) -> list[tuple[bytes, bytes]]:
    """learn_merges of words, which are merged in place, up to the first merge that is not certain(n, pair, merges so far)."""
    pairs: Counter = Counter()
    where = defaultdict(set)
    for i, w in enumerate(words):
        for p in zip(w, w[1:], strict=False):
            pairs[p] += weight[i]
            where[p].add(i)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    out: list[tuple[bytes, bytes]] = []
    while heap and len(out) < n_merges:
        n, p = heapq.heappop(heap)
        if pairs[p] != -n or not n:
            continue  # superseded
        if certain is not None and not certain(-n, p, out):
            break
        out.append(p)
        changed = set()
        for i in where.pop(p):
            w, new, k = words[i], [], 0
            for q in zip(w, w[1:], strict=False):
                pairs[q] -= weight[i]
                changed.add(q)
                where[q].discard(i) if q != p else None
            while k < len(w):
                if k + 1 < len(w) and (w[k], w[k + 1]) == p:
                    new.append(w[k] + w[k + 1])
                    k += 2
                else:
                    new.append(w[k])
                    k += 1
            words[i] = new
            for q in zip(new, new[1:], strict=False):
                pairs[q] += weight[i]
                where[q].add(i)
                changed.add(q)
        for q in changed:
            if pairs[q] > 0:
                heapq.heappush(heap, (-pairs[q], q))
    return out


class Certain:
    """Whether a merge learned from runs of the best pairs alone is the next one of the whole table, too.

    best are the table's best pairs, after each of which words are not cut; the other pairs count `beyond` at most, and so
    does every pair that a merge makes of one of them. A pair that counts more is certain. One that counts as much is so
    if it is among the best, and if no merge has made a token below its first one, as (ab, y) may tie with (b, y). Equal
    tokens from two merges would join counts of both kinds, so a token that is there already is the last.
    """

    def __init__(self, best: list[tuple[bytes, bytes]], beyond: int | None, known: set[bytes]):
        self.last, self.beyond, self.known = best[-1], beyond, known
        self.least: bytes | None = None
        self.ended = False

    def __call__(self, n: int, p: tuple[bytes, bytes], out: list) -> bool:
        if self.beyond is not None and (self.ended or n < self.beyond or (n == self.beyond and (p > self.last or (self.least is not None and p[0] >= self.least)))):
            return False
        new = p[0] + p[1]
        self.ended = new in self.known
        self.known.add(new)
        self.least = new if self.least is None else min(self.least, new)
        return True


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows of _block: all symbols, how many each word has, the weights."""
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(np.array(np.frombuffer(b.column(k)[i].as_buffer(), t)) for k, t in enumerate((np.int32, np.int32, np.int64)))


def _block(s: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Words as one row of three arrays, which Spark moves as bytes and not number by number."""
    cells = s.astype(np.int32, copy=False), lengths.astype(np.int32, copy=False), n.astype(np.int64, copy=False)
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["symbols", "lengths", "n"])


def _adjacent(s: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word of each symbol; pairs of neighbours, as one number each; whether they are of one word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    return word, (s[:-1].astype(np.int64) << 32) | s[1:], word[1:] == word[:-1]


def _runs(s: np.ndarray, lengths: np.ndarray, best: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words cut between neighbours that are none of the best pairs (sorted): the parts in their order, as bytes of their
    symbols; the word of each; how many symbols it has."""
    word, codes, inside = _adjacent(s, lengths)
    joined = inside & (best[np.minimum(np.searchsorted(best, codes), len(best) - 1)] == codes)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), ~joined]))
    ends = np.append(start, len(s))
    parts = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(s)])
    return parts, word[start], np.diff(ends)


def _summed(keys: pa.Array | np.ndarray, n: np.ndarray, name: str) -> list[pa.RecordBatch]:
    t = pa.table({name: keys, "n": n}).group_by(name, use_threads=False).aggregate([("n", "sum")])
    return t.select([name, "n_sum"]).rename_columns([name, "n"]).to_batches()


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces as the numbers of their bytes, in blocks of about SYMBOLS."""
    held, size = [], 0
    for b in batches:
        pieces = b.column(0)
        lengths = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
        held.append((np.frombuffer(b"".join(pieces.to_pylist()), np.uint8), lengths, b.column(1).to_numpy()))
        size += len(held[-1][0])
        if size >= SYMBOLS:
            yield _block(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield _block(*map(np.concatenate, zip(*held, strict=True)))


def _pair_counts(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Weights of pairs, whose symbols are told by their places in the order of tokens."""
    for s, lengths, n in _blocks(batches):
        word, codes, inside = _adjacent(place[s], lengths)
        yield from _summed(codes[inside], n[word[:-1][inside]], "pair")


def _cut(batches: Iterator[pa.RecordBatch], best: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of two symbols and more whose neighbours all are among the best pairs, and their weights."""
    for s, lengths, n in _blocks(batches):
        parts, word, size = _runs(s, lengths, best)
        yield from _summed(parts.filter(pa.array(size > 1)), n[word[size > 1]], "symbols")


def _put(batches: Iterator[pa.RecordBatch], best: np.ndarray, runs: pa.Array, merged: pa.Array) -> Iterator[pa.RecordBatch]:
    """Words with their runs as they are merged; a word of one symbol has no pair and goes."""
    for s, lengths, n in _blocks(batches):
        parts, word, size = _runs(s, lengths, best)
        at = np.full(len(parts), -1)
        at[size > 1] = pc.index_in(parts.filter(pa.array(size > 1)), value_set=runs).fill_null(-1).to_numpy(zero_copy_only=False)
        new = pc.coalesce(merged.take(pa.array(at, mask=at < 0)), parts)
        left = np.bincount(word, pc.binary_length(new).to_numpy(zero_copy_only=False) // 4, len(lengths)).astype(np.int64)
        held = np.frombuffer(new.buffers()[2] or b"", np.int32, left.sum())  # a new array holds its values one after the other
        if (left > 1).any():
            yield _block(held[np.repeat(left > 1, left)], left[left > 1], n[left > 1])


def learn_merges_apart(counts: DataFrame, n_merges: int) -> list[tuple[bytes, bytes]]:
    """learn_merges of a table (chunk, n) that stays on the executors, in rounds of three jobs.

    A round counts all pairs and takes the best ones, cuts the words between all other neighbours, and sums what is
    equal then: at most DRIVER_PIECES distinct runs, from which the driver learns the merges that are certain of the
    whole table. Then the words are written anew, merged. How many pairs are taken follows the number of runs. A row of
    the words' table is a block of them, so what a round costs is what its symbols cost in numpy and Arrow.
    """
    spark = counts.sparkSession
    counts = counts.filter(F.octet_length("chunk") > 1).select(F.col("chunk").cast("binary").alias("chunk"), "n")
    tasks = max(spark.sparkContext.defaultParallelism, -(-counts.count() // TASK_PIECES))
    tables, tokens, take, wider, block = Tables(spark), [bytes([i]) for i in range(256)], NAMED, 2, "symbols binary, lengths binary, n binary"
    number = {t: i for i, t in enumerate(tokens)}
    words = tables(counts.repartition(tasks, "chunk").mapInArrow(_bytes_of, block), "words")
    out: list[tuple[bytes, bytes]] = []
    while len(out) < n_merges:
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        shared = spark.sparkContext.broadcast(place)
        pairs = words.mapInArrow(lambda b, shared=shared: _pair_counts(b, shared.value), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.orderBy(F.desc("n"), "pair").limit(wider * take + 1).collect()
        if not top:
            break
        take = min(wider * take, len(top))
        while True:
            best = [(order[r["pair"] >> 32], order[r["pair"] & 0xFFFFFFFF]) for r in top[:take]]
            codes = np.sort(np.array([(a << 32) | b for a, b in best], np.int64))
            cut = words.mapInArrow(lambda b, codes=codes: _cut(b, codes), "symbols binary, n long").groupBy("symbols").agg(F.sum("n").alias("n"))
            # of one pair there are runs of (a, a) alone, one for each length
            runs = (cut if take == 1 else cut.limit(DRIVER_PIECES + 1)).toArrow()
            if len(runs) <= DRIVER_PIECES or take == 1:
                break
            take //= 2
        wider = WIDER if len(runs) < DRIVER_PIECES // 8 else 2
        ids = [np.frombuffer(r, np.int32).tolist() for r in runs["symbols"].to_pylist()]
        parts = [[tokens[i] for i in r] for r in ids]
        certain = Certain([(tokens[a], tokens[b]) for a, b in best], top[take]["n"] if take < len(top) else None, set(tokens))
        merges = _learned(parts, runs["n"].to_pylist(), n_merges - len(out), certain)
        out += merges
        for a, b in merges:
            if a + b not in number:
                number[a + b] = len(tokens)
                tokens.append(a + b)
        changed = [i for i, (r, p) in enumerate(zip(ids, parts, strict=True)) if len(p) < len(r)]
        packed = lambda rows: pa.array([np.array(r, np.int32).tobytes() for r in rows], pa.binary())
        merged = spark.sparkContext.broadcast((packed(ids[i] for i in changed), packed([number[t] for t in parts[i]] for i in changed)))
        if len(out) < n_merges:
            last, words = words, tables(words.mapInArrow(lambda b, codes=codes, merged=merged: _put(b, codes, *merged.value), block), "words")
            tables.drop(last)
        shared.unpersist()
        merged.unpersist()
    tables.drop(words)
    return out


@dataclass
class Tokenizer:
    """Ranks of byte strings, with the special tokens after them."""

    ranks: dict[bytes, int]
    pattern: str = SPLIT_PATTERN
    specials: tuple[str, ...] = SPECIAL_TOKENS
    special: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.special = {name: len(self.ranks) + i for i, name in enumerate(self.specials)}
        self._encoding = self._token_bytes = None

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None, "_token_bytes": None}

    @property
    def encoding(self) -> tiktoken.Encoding:
        if self._encoding is None:
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens=self.special)
        return self._encoding

    @property
    def token_bytes(self) -> pa.Array:
        """Bytes of each id, special tokens included."""
        if self._token_bytes is None:
            of = {i: b for b, i in self.ranks.items()} | {i: name.encode() for name, i in self.special.items()}
            self._token_bytes = pa.array([of.get(i) for i in range(max(of) + 1)], pa.binary())
        return self._token_bytes

    @property
    def size(self) -> int:
        return len(self.ranks) + len(self.special)

    @property
    def bos(self) -> int:
        return self.special[self.specials[0]]

    def encode(self, text: str, prepend: int | str | None = None, append: int | str | None = None) -> list[int]:
        """Ids of a text; names of special tokens in it are ordinary text."""
        own = lambda t: [] if t is None else [t if isinstance(t, int) else self.special[t]]
        return own(prepend) + self.ids(text).tolist() + own(append)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text alone. tiktoken's expressions have no stack for a run of a million blanks, and it takes no halves
        of characters; such a text is split by the other engine and, as there, a half becomes a replacement."""
        try:
            return self.encoding.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            whole = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            return np.array([i for p in regex.findall(self.pattern, whole) for i in self.encoding._encode_single_piece(p)], np.uint32)

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """id, bytes, is_special, n_bytes (of the token decoded alone; 0 for special ones), true_bytes.

        n_bytes counts a byte that is no character of its own as the three bytes of its replacement.
        """
        rows = [(i, bytearray(b), False, len(b.decode("utf-8", "replace").encode()), len(b)) for b, i in self.ranks.items()]
        rows += [(i, bytearray(n.encode()), True, 0, 0) for n, i in self.special.items()]
        return spark.createDataFrame(rows, "id int, bytes binary, is_special boolean, n_bytes int, true_bytes int")


def train(docs: DataFrame, vocab_size: int, text: str = "text", doc_cap: int | None = None, specials: tuple[str, ...] = SPECIAL_TOKENS) -> Tokenizer:
    """A tokenizer of vocab_size tokens, special ones included, or fewer once no pair is left. Pieces are counted
    on the cluster; the driver holds DRIVER_PIECES distinct ones at most, beyond that the executors learn the merges."""
    n = vocab_size - len(specials)
    if n < 256:
        raise ValueError(f"a vocabulary without special tokens needs 256 tokens at least, not {n}")
    if doc_cap is not None:
        docs = docs.withColumn(text, F.substring(text, 1, doc_cap))
    counts = chunk_counts(docs, text).persist(StorageLevel.DISK_ONLY)
    try:
        if counts.count() <= DRIVER_PIECES:
            merges = learn_merges({r["chunk"].encode(): r["n"] for r in counts.orderBy("chunk").toLocalIterator() if r["chunk"]}, n - 256)
        else:
            merges = learn_merges_apart(counts, n - 256)
    finally:
        counts.unpersist()
    ranks = {bytes([i]): i for i in range(256)}
    for a, b in merges:
        ranks.setdefault(a + b, len(ranks))
    return Tokenizer(ranks, specials=specials)


def _sliced(df: DataFrame, tokenizer: Tokenizer, column: str, columns: dict[str, pa.DataType], schema, of) -> DataFrame:
    """df with columns made from an array of values of a column by of(tokenizer, array) -> arrays. Ids in Python are many
    times as large as in a batch, so a batch is mapped by slices of about SLICE bytes."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            n = max(1, SLICE * whole.num_rows // max(1, whole.nbytes))
            for b in (whole.slice(lo, n) for lo in range(0, whole.num_rows, n)):
                arrays = of(shared.value, b.column(b.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, *columns])

    return df.mapInArrow(run, schema)


def _mapped(df: DataFrame, tokenizer: Tokenizer, column: str, columns: dict[str, pa.DataType], schema, of) -> DataFrame:
    """_sliced by of(tokenizer, value) -> tuple, one value at a time."""

    def each(t: Tokenizer, values: pa.Array) -> list[pa.Array]:
        made = [of(t, v.as_py()) for v in values]
        return [pa.array([m[i] for m in made], type=kind) for i, kind in enumerate(columns.values())]

    return _sliced(df, tokenizer, column, columns, schema, each)


def _ids(tokenizer: Tokenizer, texts: pa.Array, prepend: str | None, append: str | None) -> pa.Array:
    """Tokenizer.encode of each text, as arrays that never become numbers of Python."""
    head, tail = (np.array([] if t is None else [tokenizer.special[t]], np.int32) for t in (prepend, append))
    parts, sizes = [], [0]
    for v in texts.to_pylist():
        own = () if v is None else (head, tokenizer.ids(v), tail)
        parts += own
        sizes.append(sum(map(len, own)))
    ids = np.concatenate(parts).astype(np.int32) if parts else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(ids), mask=texts.is_null())


def encoded(df: DataFrame, tokenizer: Tokenizer, text: str = "text", prepend: str | None = None, append: str | None = None, name: str = "ids") -> DataFrame:
    """df with the ids of its texts; null texts have null ids."""
    schema = df.drop(name).withColumn(name, F.lit(None).cast("array<int>")).schema
    return _sliced(df.drop(name), tokenizer, text, {name: pa.list_(pa.int32())}, schema, lambda t, v: [_ids(t, v, prepend, append)])


def _texts(tokenizer: Tokenizer, lists: pa.Array) -> pa.Array:
    """Tokenizer.decode of each list: the bytes of all tokens of the slice, cut where the lists end."""
    ids = lists.flatten()
    if ids.null_count:
        raise ValueError("an id is null")
    tokens = tokenizer.token_bytes.take(ids)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    whole, ends = memoryview(tokens.buffers()[2] or b""), ends[at].tolist()  # a taken array holds its values one after the other
    return pa.array([str(whole[lo:hi], "utf-8", "replace") if ok else None for lo, hi, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)], pa.string())


def decoded(df: DataFrame, tokenizer: Tokenizer, ids: str = "ids", name: str = "decoded") -> DataFrame:
    schema = df.drop(name).withColumn(name, F.lit(None).cast("string")).schema
    return _sliced(df.drop(name), tokenizer, ids, {name: pa.string()}, schema, lambda t, v: [_texts(t, v)])


def segments(messages: Column) -> Column:
    """What a conversation is made of: array of (text, is_special, mask). The assistant learns its own words,
    its calls, and its end; a first system message has been merged before."""
    part = lambda t, special, mask: F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), F.lit(special).alias("is_special"), F.lit(mask).alias("mask"))
    sp = lambda name, mask: part(name, True, mask)
    wrap = lambda start, c, end: F.array(sp(start, 0), part(c, False, 0), sp(end, 0))

    def one(m: Column) -> Column:
        call = m["tool_call"]
        pairs = F.flatten(F.transform(call["args"], lambda a: F.array(sp("<|tool_arg|>", 1), part(a["arg"], False, 1), sp("<|tool_val|>", 1), part(F.coalesce(a["val"], F.lit("None")), False, 1))))
        called = F.concat(F.array(sp("<|tool_call_start|>", 1), part(call["name"], False, 1)), pairs, F.array(sp("<|tool_call_end|>", 1)))
        said = F.when(m["content"].isNotNull(), F.array(part(m["content"], False, 1)))
        own = F.when(call.isNotNull(), F.when(said.isNotNull(), F.concat(said, called)).otherwise(called)).otherwise(said)
        answer = F.concat(F.array(sp("<|assistant_start|>", 0)), own, F.array(sp("<|assistant_end|>", 1)))
        return F.when(m["role"] == "user", wrap("<|user_start|>", m["content"], "<|user_end|>")).when(m["role"] == "assistant", answer).when(m["role"] == "tool_result", wrap("<|tool_result_start|>", m["content"], "<|tool_result_end|>"))

    return F.concat(F.array(sp("<|bos|>", 0)), F.flatten(F.transform(messages, one)))


def rendered(df: DataFrame, tokenizer: Tokenizer, messages: str = "messages", max_tokens: int | None = 2048, completion: bool = False) -> DataFrame:
    """df with ids and mask of its conversations, kept to their first max_tokens.

    A message that cannot be rendered (another role, no content) gives null ids. For a completion the last
    answer is dropped and the start of another is put at the end, after the cut.
    """
    from lodestone.operators.conversations import merge_system, without_last_answer

    m = without_last_answer(F.col(messages)) if completion else F.col(messages)
    rows = df.withColumn("segments_", segments(merge_system(m)))
    rows = rows.drop("ids", "mask")
    schema = rows.withColumns({"ids": F.lit(None).cast("array<int>"), "mask": F.lit(None).cast("array<int>")}).schema

    def of(t: Tokenizer, segments: list | None) -> tuple:
        if segments is None or any(s is None or s["text"] is None for s in segments):
            return None, None
        ids, mask = [], []
        for s in segments:
            got = [t.special[s["text"]]] if s["is_special"] else t.encode(s["text"])
            ids += got
            mask += [s["mask"]] * len(got)
        if max_tokens is not None:
            ids, mask = ids[:max_tokens], mask[:max_tokens]
        return (ids + [t.special["<|assistant_start|>"]], mask + [0]) if completion else (ids, mask)

    out = _mapped(rows, tokenizer, "segments_", {"ids": pa.list_(pa.int32()), "mask": pa.list_(pa.int32())}, schema, of)
    return out.drop("segments_")


def shown(tokenizer: Tokenizer, ids: list[int], mask: list[int]) -> str:
    """Tokens apart from each other, with a colour for those that are learned."""
    return "|".join(f"\033[9{2 if m else 1}m{tokenizer.decode([i])}\033[0m" for i, m in zip(ids, mask, strict=True))


def split_python(text: str) -> list[str]:
    """chunks() in Python."""
    return regex.findall(SPLIT_PATTERN, text)
