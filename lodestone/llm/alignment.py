"""Cross-tokenizer alignment by a dictionary of groups.

A text is encoded twice, by a byte-level BPE (A, of space + text) and by a sentence-piece BPE with byte fallback (B, of
the text, which gets its space from the library). Byte offsets at which tokens of both end cut the two sequences into
groups; the tokens of a group are linked, each of A with each of B. The count of an id pair is the number of documents
of the corpus that hold it linked.

Links are never listed by document. A group is interned by its ids, `a1,a2|b1`: a document is a list of groups with
frequencies, a block of documents a dictionary of their distinct groups. Each distinct group of the corpus expands its
links once; documents by pair are the documents of its groups, less those in which the pair stands in several groups,
which the block that holds them takes off. What a group adds to a document, the counts of its links and how many of
them are best for their A id, goes back to the blocks by the group's key, and is summed there by frequency.

Texts are cut before a space or line's end that follows a character other than white space, as neither tokenizer has a
token across such a place (checked when they are loaded; else a text is one unit). Units repeat, so what is known of them is
kept, as arrays by their numbers: sums and counts of some hundred documents are made at once, without a step of Python for
each group. A text of any length needs memory for its units only. A text that is null or empty, or that A or B does not give back
byte by byte (B: one with U+2581), has no tokens: zeros, and '' as its digest. Repeated rows are documents of their own
each; ids may be null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm._common import arrow_schema, batch, release, slices, table

#: A block closes at so many documents, distinct groups, or entries of documents' lists.
BLOCK_DOCS, BLOCK_GROUPS, BLOCK_ENTRIES = 4096, 32_768, 500_000
#: Units whose groups a task remembers from block to block, and their longest; characters of longer ones and their
#: groups that close a block; units that are encoded, and units whose groups are counted, at a time; longest group that is its own key.
MEMO, LONGEST, LONG, LEARN, EXPAND, KEY = 200_000, 48, 64 << 20, 1024, 1 << 20, 48


def _letters_of_bytes() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself where it prints, else one from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: White space that keeps a text from being cut at each space and line's end: other characters, and two in a row.
_ODD = ("  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"))


def _unit(key: str) -> str:
    """A unit from its key, which leaves out the space before a word."""
    return key if key[0] in " \n" else " " + key


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of runs that begin at first and have so many entries."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Units(NamedTuple):
    """What is known of some units: their tokens, links and groups in number, their groups as text, and one by one."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_links: np.ndarray
    n_groups: np.ndarray
    texts: list[str]
    groups: list[int]


class Coded(NamedTuple):
    """Some documents: their figures and digests, and, in order of the documents, how often each holds which group."""

    numbers: dict[str, np.ndarray]
    digests: list[str]
    doc: np.ndarray
    group: np.ndarray
    times: np.ndarray


class Aligner:
    """Groups of texts under two tokenizers: a file of `tokenizers` and a model of `sentencepiece`. Units, groups and
    pairs that were met have numbers, and what is known of them stands in arrays by these; trim() deals new ones."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letters = _letters_of_bytes()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: ids as groups write them, each within its side of a group and at its end: those of A, then those of B
        self.written = [f"{i}{c}" for x, cs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for i in range(len(x)) for c in cs]
        self.written_size = np.array(list(map(len, self.written)), np.int64)
        self.space = self.b.piece_to_id("▁")
        first = json.loads(self.a.to_str())["pre_tokenizer"]
        words = first == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not any("▁" in p.lstrip("▁") for p in pieces)
        self.lines = words and self.b.is_byte(self.b.piece_to_id("<0x0A>")) and not any("\n" in p for p in pieces)
        #: where a text is cut: before a space, or a line's end, that follows other than white space and precedes a word
        self.cut = re.compile(r"(?<=\S)(?=[ \n]\s*\S)" if self.lines else r"(?<=\S)(?= \s*\S)") if words else None
        self.forget()

    def forget(self) -> None:
        """Empties the memos."""
        none = np.zeros(0, np.int64)
        self.numbers: dict[str, int] = {}  # of units, by key
        self.n_a = self.n_b = self.n_links = self.n_groups = self.first = self.groups = self.used = none
        self.texts: list[str] = []
        self.names: dict[str, int] = {}  # numbers of groups
        self.n_pairs = self.first_pair = self.pairs = none
        self.pair_names: dict[str, int] = {}
        self.groups_of_pair = none  # in how many groups each pair stands
        self.met: list[list[int]] = []  # pairs of the groups that are not in the arrays yet
        self.clock = self.long = 0

    def units(self, text: str) -> list[str]:
        """The keys of the units of space + text."""
        if self.lines and not (text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, _ODD))):
            return text.replace("\n", " \n").split(" ")
        text = " " + text
        units = [text] if self.cut is None else self.cut.split(text)
        return [u if u[0] == "\n" or u[1:2].isspace() else u[1:] or u for u in units]

    def _group(self, name: str) -> int:
        """The number of a group that is new."""
        pairs = _pairs(name)
        if len(name) > LONGEST:
            self.long += len(name) + 64 * len(pairs)
        number = self.pair_names
        self.met.append([number.setdefault(p, len(number)) for p in pairs])
        return self.names.setdefault(name, len(self.names))

    def _aligned(self, units: list[str], a: list[int], b: list[int]) -> Units | None:
        """The units' groups from the tokens of all of them, or None unless bytes and ends of units agree."""
        raw = "".join(units).encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        in_a, in_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
        in_a[ends_a] = in_b[ends_b] = True
        both_a, both_b = in_b[ends_a], in_a[ends_b]
        i, j = np.flatnonzero(both_a), np.flatnonzero(both_b)
        ends, stops = ends_a[i], np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in units])
        last = np.searchsorted(ends, stops)
        if not np.array_equal(ends[last], stops):
            return None
        size_a, size_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(j + 1 - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(i + 1, size_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a] = 2 * a + both_a
        order[place_b] = 2 * (len(self.a_bytes) + b) + both_b
        text, written = "".join([self.written[k] for k in order.tolist()]), np.cumsum(self.written_size[order])[place_b[j]]
        known, new, at = self.names, self._group, [0, *written.tolist()]
        names = [text[lo : hi - 1] for lo, hi in zip(at, at[1:], strict=False)]
        groups = [known[g] if g in known else new(g) for g in names]
        at = [0, *written[last].tolist()]
        texts = [text[lo : hi - 1] for lo, hi in zip(at, at[1:], strict=False)]
        n_links = np.diff(np.cumsum(size_a * size_b)[last], prepend=0)
        return Units(np.diff(i[last], prepend=-1), np.diff(j[last], prepend=-1), n_links, np.diff(last, prepend=-1), texts, groups)

    def _one(self, unit: str) -> Units:
        """One unit; it has no groups if it does not come back byte by byte."""
        a, b = self.a.encode(unit, add_special_tokens=False).ids, self.b.encode(unit[unit[0] == " " :])
        if unit[0] != " " and b[:1] == [self.space]:  # the space that the library adds is a token of its own before a line's end
            b = b[1:]
        zero = np.zeros(1, np.int64)
        return self._aligned([unit], a, b) or Units(zero, zero, zero, zero, [""], [])

    def _encoded(self, keys: list[str]) -> Iterator[tuple[list[str], Units]]:
        """Units encoded together, behind a unit of their own: they do not meet. If they disagree, by halves."""
        units = [" a", *map(_unit, keys)]
        text = "".join(units)
        got = self._aligned(units, self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]))
        if got:
            yield keys, Units(*(x[1:] for x in got[:5]), got.groups[int(got.n_groups[0]) :])
        elif len(keys) == 1:
            yield keys, self._one(units[1])
        else:
            yield from self._encoded(keys[: len(keys) // 2])
            yield from self._encoded(keys[len(keys) // 2 :])

    def _learn(self, keys: Iterable[str]) -> None:
        """Numbers units that have none."""
        together, alone = [], []
        for k in keys:
            (alone if self.cut is None or k[-1].isspace() else together).append(k)
            if len(k) > LONGEST:
                self.long += 4 * len(k)
        parts = [x for lo in range(0, len(together), LEARN) for x in self._encoded(together[lo : lo + LEARN])]
        parts += [([k], self._one(_unit(k))) for k in alone]
        if not parts:
            return
        for ks, got in parts:
            self.numbers.update(zip(ks, range(len(self.numbers), len(self.numbers) + len(ks)), strict=True))
            self.texts += got.texts
        for c in ("n_a", "n_b", "n_links", "n_groups"):
            setattr(self, c, np.concatenate([getattr(self, c), *(getattr(got, c) for _, got in parts)]))
        self.groups = np.concatenate([self.groups, *(np.array(got.groups, np.int64) for _, got in parts)])
        self.first = np.cumsum(self.n_groups) - self.n_groups
        self.used = np.r_[self.used, np.zeros(len(self.n_a) - len(self.used), np.int64)]
        self.n_pairs = np.r_[self.n_pairs, np.array(list(map(len, self.met)), np.int64)]
        self.first_pair = np.cumsum(self.n_pairs) - self.n_pairs
        self.pairs = np.r_[self.pairs, np.fromiter(chain.from_iterable(self.met), np.int64)]
        self.groups_of_pair = np.bincount(self.pairs, minlength=len(self.pair_names))
        self.met = []

    def full(self, most: float = 2) -> bool:
        return len(self.texts) > most * MEMO or self.long > LONG

    def trim(self) -> None:
        """Keeps the MEMO units that were met last, but no long ones, with their groups. All numbers change."""
        keys, texts, names, pair_names = list(self.numbers), self.texts, list(self.names), list(self.pair_names)
        last = np.sort(np.argsort(-self.used, kind="stable")[:MEMO])
        kept = last[np.array([len(keys[k]) <= LONGEST for k in last.tolist()], bool)]
        self.numbers, self.texts = {keys[k]: n for n, k in enumerate(kept.tolist())}, [texts[k] for k in kept.tolist()]
        groups, self.groups = np.unique(self.groups[_ragged(self.first[kept], self.n_groups[kept])], return_inverse=True)
        for c in ("n_a", "n_b", "n_links", "n_groups", "used"):
            setattr(self, c, getattr(self, c)[kept])
        self.first = np.cumsum(self.n_groups) - self.n_groups
        self.names = {names[g]: n for n, g in enumerate(groups.tolist())}
        pairs, self.pairs = np.unique(self.pairs[_ragged(self.first_pair[groups], self.n_pairs[groups])], return_inverse=True)
        self.n_pairs = self.n_pairs[groups]
        self.first_pair = np.cumsum(self.n_pairs) - self.n_pairs
        self.pair_names = {pair_names[p]: n for n, p in enumerate(pairs.tolist())}
        self.groups_of_pair = np.bincount(self.pairs, minlength=len(pairs))
        self.long = 0

    def coded(self, texts: list[str | None]) -> Coded:
        """The documents of these texts."""
        cut = [self.units(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        self._learn(set(flat).difference(self.numbers))
        units = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        self.clock += 1
        self.used[units] = self.clock
        size = np.array(list(map(len, cut)), np.int64)
        doc = np.repeat(np.arange(len(texts)), size)
        lost = np.zeros(len(texts), bool)
        lost[doc[self.n_groups[units] == 0]] = True
        if lost.any():
            units, doc, size = units[~lost[doc]], doc[~lost[doc]], np.where(lost, 0, size)
        ends = np.cumsum(size)
        numbers = {}
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            run = np.r_[0, np.cumsum(getattr(self, c)[units])]
            numbers[c] = run[ends] - run[ends - size]
        text, digests = self.texts.__getitem__, []
        for n, hi in zip(size.tolist(), ends.tolist(), strict=True):
            digests.append(hashlib.sha256(";".join(map(text, units[hi - n : hi].tolist())).encode()).hexdigest() if n else "")
        several, parts = len(self.names) or 1, []
        for lo in range(0, len(units), EXPAND):
            some = units[lo : lo + EXPAND]
            n = self.n_groups[some]
            parts.append(np.unique(np.repeat(doc[lo : lo + EXPAND], n) * several + self.groups[_ragged(self.first[some], n)], return_counts=True))
        key, times = parts[0] if parts else (np.zeros(0, np.int64),) * 2
        if len(parts) > 1:
            key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, at, np.concatenate([n for _, n in parts]))
        return Coded(numbers, digests, key // several, key % several, times)

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, str, Counter]]:
        """n_a, n_b, n_groups, n_links, digest of the groups, and how often each group stands in the text, by text."""
        if self.full():
            self.trim()
        got = self.coded(texts)
        names, at = list(self.names), np.searchsorted(got.doc, np.arange(len(texts) + 1)).tolist()
        for k, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            numbers = (int(got.numbers[c][k]) for c in ("n_a", "n_b", "n_groups", "n_links"))
            yield *numbers, got.digests[k], Counter({names[g]: n for g, n in zip(got.group[lo:hi].tolist(), got.times[lo:hi].tolist(), strict=True)})

    def again(self, got: Coded) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that stand in several distinct groups of a document, and in how many beyond the first."""
        n, several = self.n_pairs[got.group], len(self.pair_names) or 1
        doc, pair = np.repeat(got.doc, n), self.pairs[_ragged(self.first_pair[got.group], n)]
        some = self.groups_of_pair[pair] > 1
        key, times = np.unique(doc[some] * several + pair[some], return_counts=True)
        return key[times > 1] % several, times[times > 1] - 1


@lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    """A worker's tokenizers stay from task to task, their memos do not."""
    return Aligner(a_path, b_path)


def ids(group: str) -> tuple[list[int], list[int]]:
    a, _, b = group.partition("|")
    return list(map(int, a.split(","))), list(map(int, b.split(",")))


def _pairs(group: str) -> list[str]:
    """The distinct pairs of a group."""
    if "," not in group:
        return [group]
    a, b = ids(group)
    return [f"{x}|{y}" for x in set(a) for y in set(b)]


def key_of(group: str, longest: int) -> str:
    return group if len(group) <= longest else "#" + hashlib.blake2b(group.encode(), digest_size=16).hexdigest()


#: Kinds of rows that a task writes: documents, groups of a block, pairs counted too often.
DOC, GROUP, AGAIN = 0, 1, 2
_FIELDS = "block bigint, kind int, idx int, item string, body string, docs bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, times array<int>"


class Limits(NamedTuple):
    """At what a block closes, and the longest group that is its own key."""

    docs: int
    groups: int
    entries: int
    key: int


def _wider(x: np.ndarray, n: int, value: int) -> np.ndarray:
    return np.r_[x, np.full(n - len(x), value, np.int64)]


def _blocks(batches: Iterator[pa.RecordBatch], out: pa.Schema, a_path: str, b_path: str, limits: Limits) -> Iterator[pa.RecordBatch]:
    aligner, number = _aligner(a_path, b_path), TaskContext.get().partitionId() << 32
    collecting = gc.isenabled()
    gc.disable()  # nothing here refers to itself, and there is much to walk
    none = np.zeros(0, np.int64)
    docs: list[tuple[pa.Array, Coded, np.ndarray]] = []
    place, held, again = none, none, none  # of groups in the block, documents by group, pairs counted too often
    order: list[int] = []  # groups by place
    n_docs = entries = 0

    def rows(n: int, kind: int, **columns) -> pa.RecordBatch:
        full = {f.name: pa.nulls(n, f.type) for f in out} | {"block": [number] * n, "kind": [kind] * n}
        return batch(out, **(full | columns))

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal number, place, held, again, n_docs, entries
        for doc_id, got, at in docs:
            offsets = pa.array(np.searchsorted(got.doc, np.arange(len(doc_id) + 1)).astype(np.int32))
            lists = {c: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for c, x in (("at", at), ("times", got.times))}
            yield rows(len(doc_id), DOC, doc_id=doc_id, groups_sha256=got.digests, **got.numbers, **lists)
        names = list(aligner.names)
        for lo in range(0, len(order), 10_000):
            some = order[lo : lo + 10_000]
            groups = [names[g] for g in some]
            yield rows(len(some), GROUP, idx=list(range(lo, lo + len(some))), item=[key_of(g, limits.key) for g in groups], body=[g if len(g) > limits.key else None for g in groups], docs=held[some])
        names, pairs = list(aligner.pair_names), np.flatnonzero(again)
        for lo in range(0, len(pairs), 10_000):
            some = pairs[lo : lo + 10_000]
            yield rows(len(some), AGAIN, item=[names[p] for p in some.tolist()], docs=-again[some])
        docs.clear()
        order.clear()
        place = held = again = none
        number, n_docs, entries = number + 1, 0, 0
        if aligner.full(1.5):
            aligner.trim()

    try:
        for b in batches:
            doc_id, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            for lo, hi in slices(text, rows=min(512, limits.docs)):
                got = aligner.coded(text.slice(lo, hi - lo).to_pylist())
                place, held = _wider(place, len(aligner.names), -1), _wider(held, len(aligner.names), 0)
                again = _wider(again, len(aligner.pair_names), 0)
                more = np.bincount(got.group, minlength=len(held))
                new = np.flatnonzero((more > 0) & (place < 0))
                place[new] = np.arange(len(order), len(order) + len(new))
                order.extend(new.tolist())
                held += more
                np.add.at(again, *aligner.again(got))
                docs.append((doc_id.slice(lo, hi - lo), got, place[got.group]))
                n_docs, entries = n_docs + hi - lo, entries + len(got.group)
                if n_docs >= limits.docs or len(order) >= limits.groups or entries >= limits.entries or aligner.full():
                    yield from close()
        yield from close()
    finally:
        aligner.forget()
        release()
        if collecting:
            gc.enable()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, a, b, times, docs of the links of each distinct group."""
    schema = arrow_schema("item string, a int, b int, times bigint, docs bigint")
    held: tuple[list, ...] = ([], [], [], [], [])

    def out() -> pa.RecordBatch:
        made = batch(schema, **dict(zip(schema.names, held, strict=True)))
        for c in held:
            c.clear()
        return made

    for rows in batches:
        for item, body, docs in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("item", "body", "docs")), strict=True):
            a, b = map(Counter, ids(body or item))
            for x, n in a.items():
                for y, m in b.items():
                    for c, v in zip(held, (item, x, y, n * m, docs), strict=True):
                        c.append(v)
                if len(held[0]) >= 50_000:
                    yield out()
    if held[0]:
        yield out()


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document (see the module)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(_FIELDS).fields])
    arrow, limits = arrow_schema(schema), Limits(BLOCK_DOCS, BLOCK_GROUPS, BLOCK_ENTRIES, KEY)
    rows = table(docs.mapInArrow(lambda b: _blocks(b, arrow, a_path, b_path, limits), schema), "aligned")
    dictionary = rows.filter(F.col("kind") == GROUP).select("block", "idx", "item", "body", "docs")
    groups = dictionary.groupBy("item").agg(F.max("body").alias("body"), F.sum("docs").alias("docs"))
    links = table(groups.mapInArrow(_links, "item string, a int, b int, times bigint, docs bigint"), "links")
    pair = F.split("item", r"\|")
    again = rows.filter(F.col("kind") == AGAIN).select(pair[0].cast("int").alias("a"), pair[1].cast("int").alias("b"), "docs")
    pairs = links.select("a", "b", "docs").unionByName(again).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    pairs = table(pairs, "pairs")
    best = pairs.groupBy(F.col("a").alias("a_")).agg(F.max("count").alias("most"))  # as many rows as A has ids
    pairs = pairs.join(F.broadcast(best), F.col("a") == F.col("a_")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    worth = links.join(pairs, ["a", "b"]).groupBy("item").agg(F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    known = dictionary.select("block", "idx", "item").join(worth, "item").select(F.col("block").alias("of_block"), "idx", "count_sum", "n_best")
    result = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string").fields])
    result_arrow = arrow_schema(result)

    def summed(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        """Rows of a block's documents, from what its groups are worth."""
        n = theirs.num_rows
        worth = {c: np.zeros(n, np.int64) for c in ("count_sum", "n_best")}
        for c, w in worth.items():
            w[theirs.column("idx").to_numpy()] = theirs.column(c).to_numpy()
        at, times = (ours.column(c).combine_chunks() for c in ("at", "times"))
        sizes = np.asarray(at.value_lengths().fill_null(0)).astype(np.int64)
        flat_at, flat_times = at.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        total = {}
        for c, w in worth.items():
            run = np.r_[0, np.cumsum(w[flat_at] * flat_times)]
            total[c] = run[ends] - run[ends - sizes]
        return pa.Table.from_arrays([pa.array(total[f.name], f.type) if f.name in total else ours.column(f.name).combine_chunks().cast(f.type) for f in result_arrow], schema=result_arrow)

    ours = rows.filter(F.col("kind") == DOC).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    return ours.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(summed, result)
