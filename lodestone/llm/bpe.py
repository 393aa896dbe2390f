"""Byte-level BPE by rank file: encoding and decoding.

Each match of the pre-split pattern is merged on its own. A segment tree over the byte positions of a
piece holds at each leaf the rank of the pair that starts there, and at its root the leftmost pair of
the lowest rank. A merge removes one leaf and renews two, so a piece of n bytes takes O(n log n).

Null text counts as empty text and has no ids; any length of text is taken whole; equal rows give
equal results; other columns are kept whatever their names, and the result columns replace theirs.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._common import Bounded, arrow_schema, batch, release, slices

_NONE = 1 << 62
_POS = 32
_MASK = (1 << _POS) - 1
#: Bytes of a piece that is merged in a row of an array, and characters of a word that is remembered, at most.
_ROW_BYTES, _WORD = 33, 48


#: A space that white space or nothing follows.
_SPACES = re.compile(r" (?:\s|\Z)")
# Fixed value: the pattern of the public rank files. After a space every character that is no white space
# is taken, with the space, by one of its three runs, and no run goes on over a space.
_SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Ranks of a tiktoken-style file, with the memos of one Python worker: words holds the ids of a space and the
    word after it, memo those of pieces that start otherwise."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 100_000):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.split = regex.compile(pattern).findall
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.table = self.single = None
        self.words = Bounded(lambda word: self.pieces(" " + word), 2 * memo, _WORD) if pattern == _SPACED else None
        self.memo = Bounded(lambda piece: self.known(piece) or np.array(self.merge(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes(), memo, _WORD)
        self.flat = b"".join(self.vocabulary.get(i, b"") for i in range(max(self.vocabulary, default=-1) + 1))
        self.flat = np.frombuffer(self.flat, np.uint8)
        self.ends = np.cumsum([0] + [len(self.vocabulary.get(i, b"")) for i in range(max(self.vocabulary, default=-1) + 1)])

    def forget(self) -> None:
        """Empties the memos, whose entries are bounded in number and length."""
        self.memo.clear()
        if self.words is not None:
            self.words.clear()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n, longest = len(piece), self.longest
        if n < 2:
            raise ValueError(f"no rank for byte {piece!r}")
        size = 1 << (n - 2).bit_length()  # leaves: n - 1 pairs
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << _POS | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n - 1))  # where the token before it starts

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    return
                tree[i] = low
                i >>= 1

        def pair(i: int) -> int:
            j = after[i]
            if j >= n or after[j] - i > longest:
                return _NONE
            r = ranks.get(piece[i : after[j]])
            return _NONE if r is None else r << _POS | i

        while tree[1] != _NONE:
            i = tree[1] & _MASK
            j = after[i]
            end = after[i] = after[j]
            if end < n:
                before[end] = i
            if j < n - 1:
                put(j, _NONE)
            if i < n - 1:
                put(i, pair(i))
            if i:
                k = before[i]
                put(k, pair(k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys (left id << 32 | right id) of all pairs that make a token, and the tokens' ids."""
        get, found = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        keys = np.array(sorted(found) or [0], np.int64)
        return keys, np.array([found.get(k, _NONE) for k in keys.tolist()], np.int64)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """merge() of many pieces, as packed ids. Those of like length have their trees in the rows of one array,
        and each step merges once in every piece that still can."""
        out: list[bytes | None] = [None] * len(pieces)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > _ROW_BYTES or len(p) < 2:
                out[i] = np.array(self.merge(p), "<u4").tobytes()
            else:
                sizes.setdefault(1 << (len(p) - 2).bit_length(), []).append(i)
        for size, at in sizes.items():
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], size: int) -> list[bytes]:
        """merge_many() of pieces of 2 to size + 1 bytes: one tree of `size` leaves a row."""
        if self.table is None:
            self.table = self._pairs()
            self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        keys, ids = self.table

        def rank(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[i] == key, ids[i] << _POS | at, _NONE)

        count, depth = len(pieces), size.bit_length() - 1
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size + 1, b"\0") for p in pieces), np.uint8).reshape(count, size + 1)
        token = self.single[raw]
        if (token < 0).any():
            return [np.array(self.merge(p), "<u4").tobytes() for p in pieces]
        places = np.arange(size + 2)
        after, before = np.tile(places + 1, (count, 1)), np.tile(places - 1, (count, 1))
        live = places[None, : size + 1] < n[:, None]
        tree = np.full((count, 2 * size), _NONE)
        tree[:, size:] = np.where(live[:, 1:], rank(token[:, :-1], token[:, 1:], places[None, :size]), _NONE)
        for level in range(depth - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & _MASK
            j = after[rows, i]
            end = after[rows, j]
            after[rows, i], before[rows, end] = end, i
            token[rows, i], live[rows, j] = top >> _POS, False
            k = before[rows, i]
            ends, first = end >= n[rows], k < 0
            k = np.where(first, i, k)
            own = np.where(ends, _NONE, rank(token[rows, i], token[rows, np.minimum(end, size)], i))
            tree[rows, size + np.minimum(j, size - 1)] = _NONE  # a piece's last byte starts no pair
            tree[rows, size + np.minimum(k, size - 1)] = rank(token[rows, k], token[rows, i], k)
            tree[rows, size + np.minimum(i, size - 1)] = own
            for leaf in (j, k, i):
                node = (size + np.minimum(leaf, size - 1)) >> 1
                for _ in range(depth):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            rows = rows[tree[rows, 1] != _NONE]
        flat, ends = token[live].astype("<u4").tobytes(), np.cumsum(live.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def known(self, piece: str) -> bytes | None:
        """The ids of a piece that the memos hold: one that starts with a space is a word."""
        if self.words is not None and piece[:1] == " ":
            return self.words.get(piece[1:])
        return self.memo.get(piece)

    def prepare(self, texts: list[str]) -> None:
        """Merges all pieces of the texts that the memos lack, together. Words that the texts have stay known when
        the memo is full, the others go; a slice of more words than it holds leaves some to be made when met."""
        if self.words is None:
            return
        words, memo, split, known = self.words, self.memo, self.split, self.known
        met: set[str] = set()
        for t in texts:
            met.update(t.split(" "))
        new = [w for w in met if w not in words and len(w) <= _WORD][: words.most]
        if not new:
            return
        parts, lack = {}, set()  # words of several pieces, and what is to be merged
        for w in new:
            if w.isascii() and w.isalpha():
                lack.add(" " + w)
                continue
            ps = split(" " + w)
            if len(ps) > 1:
                parts[w] = ps
            else:
                lack.add(ps[0])
        lack.update(p for ps in parts.values() for p in ps if known(p) is None)
        lacking = list(lack)
        got = dict(zip(lacking, self.merge_many([p.encode("utf-8", "surrogatepass") for p in lacking]), strict=True))
        made = {w: b"".join([got.get(p) or known(p) for p in ps]) for w, ps in parts.items()}
        if len(words) + len(lacking) + len(made) > words.most:
            still = {w: words[w] for w in met if w in words}
            words.clear()
            words.update(still)
        if len(memo) + len(lacking) > memo.most:
            memo.clear()
        words.update((p[1:], ids) for p, ids in got.items() if p[0] == " ")
        memo.update((p, ids) for p, ids in got.items() if p[0] != " ")
        words.update(made)

    def pieces(self, text: str) -> bytes:
        memo = self.memo
        return b"".join([memo[p] for p in self.split(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        With a pattern whose matches start anew at a space before a non-space, words are looked up whole: only
        those not seen before are split. Runs of white space at a space need their context and go the long way.
        """
        if self.words is None or _SPACES.search(text):
            return self.pieces(text)
        first, *rest = text.split(" ")
        return self.pieces(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's end; an id that the vocabulary lacks is an error."""
        sizes = np.diff(self.ends)[ids]
        if not sizes.all():
            raise KeyError("an id without bytes")
        ends = np.cumsum(sizes)
        begin = ends - sizes
        return self.flat[np.repeat(self.ends[ids] - begin, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


@lru_cache(maxsize=4)
def _codec(digest: str, pattern: str, load) -> Codec:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in load().splitlines() if line.strip())}
    return Codec(ranks, pattern)


class _Load:
    """The broadcast rank file; all loads are alike to the cache, whose key is the file's digest."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self) -> bytes:
        return self.shared.value

    def __eq__(self, other):
        return isinstance(other, _Load)

    def __hash__(self):
        return 0


def _factory(df: DataFrame, ranks_path: str, pattern: str):
    """The rank file's size is that of a vocabulary, whatever the corpus, so it is broadcast."""
    with open(ranks_path, "rb") as f:
        raw = f.read()
    load, digest = _Load(df.sparkSession.sparkContext.broadcast(raw)), hashlib.sha256(raw).hexdigest()
    return lambda: _codec(digest, pattern, load)


def _with(df: DataFrame, **more: str) -> tuple[list[str], str]:
    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if f.name not in more]
    schema = T.StructType([*kept, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items())])
    return [f.name for f in kept], schema


def _coded(df: DataFrame, ranks_path: str, pattern: str, text: str, made: dict[str, str], columns) -> DataFrame:
    """df with the columns (codec, lengths, ids of all texts of a slice) -> arrays in place of or beside its own."""
    codec_of = _factory(df, ranks_path, pattern)
    kept, schema = _with(df, **made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, out = codec_of(), arrow_schema(schema)
        try:
            for b in batches:
                for lo, hi in slices(b.column(text), 2 << 20, 1 << 20):
                    part = b.slice(lo, hi - lo)
                    texts = [t or "" for t in part.column(text).to_pylist()]
                    codec.prepare(texts)
                    coded = [codec.encode(t) for t in texts]
                    lengths, ids = np.array([len(c) // 4 for c in coded]), np.frombuffer(b"".join(coded), "<i4")
                    yield batch(out, **{n: part.column(n) for n in kept}, **columns(codec, lengths, ids))
        finally:
            codec.forget()
            release()

    return df.mapInArrow(run, schema)


def _offsets(ends: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.concatenate(([0], ends)).astype("<i4").tobytes())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids, an array of int, of every whole text."""

    def columns(codec, lengths, flat):
        return {ids: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype("i4")), pa.array(flat))}

    return _coded(df, ranks_path, pattern, text, {ids: "array<int>"}, columns)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", packed: str = "packed", decoded: str = "decoded") -> DataFrame:
    """Encodes every whole text and decodes its ids again in one pass: adds packed, the ids as little-endian
    unsigned 32-bit integers, and decoded, the bytes that these ids stand for."""

    def columns(codec, lengths, flat):
        raw, ends = codec.decode_all(flat)
        per_row = np.cumsum(lengths)
        last = np.concatenate(([0], ends))[per_row]
        ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, _offsets(per_row * 4), pa.py_buffer(flat)])
        return {packed: ids, decoded: pa.Array.from_buffers(pa.binary(), len(lengths), [None, _offsets(last), pa.py_buffer(raw)])}

    return _coded(df, ranks_path, pattern, text, {packed: "binary", decoded: "binary"}, columns)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids; null ids decode to no bytes."""
    codec_of = _factory(df, ranks_path, pattern)
    kept, schema = _with(df, **{decoded: "binary"})

    def run(batches):
        codec, out = codec_of(), arrow_schema(schema)
        for b in batches:
            got = [codec.decode(x.values.to_numpy().tolist()) if x.is_valid else b"" for x in b.column(b.schema.get_field_index(ids))]
            yield batch(out, **{n: b.column(b.schema.get_field_index(n)) for n in kept}, **{decoded: got})

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, packed: str = "packed", decoded: str = "decoded") -> DataFrame:
    """The count and SHA-256 of packed ids, and that of the bytes they decode to, in place of both."""
    made = {"n_tokens": F.floor(F.octet_length(packed) / 4).cast("bigint"), "ids_sha256": F.sha2(packed, 256), "decoded_sha256": F.sha2(decoded, 256)}
    return df.withColumns(made).drop(packed, decoded)
