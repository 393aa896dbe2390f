"""Cross-tokenizer alignment against whole texts, token by token, and on odd inputs."""

import hashlib
import itertools
import sys
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import alignment
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
TOKENIZER, MODEL = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
TOKENIZER.encode_special_tokens = True
ALIGNER = alignment.Aligner(A, B)


def a_bytes(i):
    return ALIGNER.a_bytes[i]  # checked by the round trip below


def b_bytes(i):
    p = MODEL.id_to_piece(i)
    return bytes.fromhex(p[3:5]) if MODEL.is_byte(i) else p.replace("▁", " ").encode()


def groups_of(text):
    """Groups of a whole text, or none."""
    if not text:
        return []
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)
    if not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == (" " + text).encode():
        return []
    ends = [list(itertools.accumulate(len(f(i)) for i in x)) for f, x in ((a_bytes, a), (b_bytes, b))]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, lo = [], 0
    for hi in cuts:
        out.append(tuple([i for i, e in zip(x, es, strict=True) if lo < e <= hi] for x, es in zip((a, b), ends, strict=True)))
        lo = hi
    return out


def brute(docs):
    """Rows of all documents, each link listed."""
    held = [(i, groups_of(t)) for i, t in docs]
    count = Counter(p for _, gs in held for p in {(x, y) for a, b in gs for x in a for y in b})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for i, gs in held:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return Counter(out)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_token_bytes():
    for i in range(TOKENIZER.get_vocab_size() - 1):
        want = TOKENIZER.decode([i])
        if "�" not in want:
            assert ALIGNER.a_bytes[i].decode() == want
    assert len({*ALIGNER.a_bytes}) == len(ALIGNER.a_bytes)


ODD = ["a", "B", "the", " ", "  ", "\n", "\n\n", "\t", "\r", "\xa0", "　", " ", "\x1c", "\x00", "▁", "é", "é", "東京", "🙂", "'s", "'", ",", "...", "1234", "<s>", "<0x0A>", "<|endoftext|>", "</s>", "====", "Ω", "﻿", "zyxwvq"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=3)), max_size=14).map("".join))
def test_units_are_the_whole_text(text):
    (got,) = ALIGNER.documents([text])
    gs = groups_of(text)
    names = [",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs]
    want = (sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), sum(len(a) * len(b) for a, b in gs), hashlib.sha256(";".join(names).encode()).hexdigest() if gs else "", Counter(names))
    assert got == want


def test_small_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 5)
    monkeypatch.setattr(alignment, "LEARN", 3)
    small = alignment.Aligner(A, B)
    texts = [f"words {i} of\nsome ▁text" if i % 9 == 0 else f"words {i} of\nsome  text {i % 4}, and {'x' * (i * 7)} ends. " for i in range(60)] + [None, ""]
    assert [list(small.documents(texts[i : i + 7])) for i in range(0, 62, 7)] == [list(ALIGNER.documents(texts[i : i + 7])) for i in range(0, 62, 7)]


SCHEMA = "doc_id long, text string, block int, item string, docs int, a string"
DOCS = [(i, f"The {w} of the {w}s, {w.upper()} and {i * 7} more ====== {'-' * (i % 11)} naïve {w}") for i, w in enumerate(["house", "Straße", "東京タワー", "unanswerable", "antidisestablishment", "don't", "zq"] * 6)]
DOCS += [(100, None), (101, ""), (102, "with a ▁ in it"), (103, " "), (104, "\n"), (None, "no id"), (None, "no id"), (1, "the same id"), (105, "x" * 5000), (106, "ends with spaces   "), (107, "\x00nul")] + [(200, "one text of many copies, copies")] * 40


@pytest.mark.parametrize("small", [False, True])
def test_align(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK_DOCS", 3), ("BLOCK_GROUPS", 20), ("BLOCK_ENTRIES", 50), ("KEY", 9)):
            monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in DOCS], SCHEMA)
    got = alignment.align(df.repartition(3), A, B)
    assert sorted(got.columns) == sorted(COLUMNS) and rows(got) == brute(DOCS)


def test_empty(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None, 1, "", 1, "")], SCHEMA), A, B)
    assert rows(got) == Counter([(1, 0, 0, 0, 0, 0, 0, "")])


WORDS = ["".join(p) for p in itertools.product(["an", "the", "ion", "é", "ou"], ["re", "ing", "ß", "st", "er"], ["ha", "ly", "ti", "que", "ea"], ["th", "nd", "on", "ai", "en"])]


def calls(f):
    """How many functions f calls, of Python and of C."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        f()
    finally:
        sys.setprofile(None)
    return n


def test_units_and_groups_cost_few_calls():
    # projected to 30 GB, 1400 CPU seconds a GB: objects and calls for each unit, group and pair of a document
    aligner = alignment.Aligner(A, B)
    texts = [" ".join(WORDS[i::5]) for i in range(5)]
    assert calls(lambda: list(aligner.documents(texts))) < 11 * len(WORDS)  # was 13.9


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.n = tokenizer, 0

    def encode(self, *a, **k):
        self.n += 1
        return self.tokenizer.encode(*a, **k)


def test_a_unit_that_is_lost_leaves_the_others_together():
    aligner = alignment.Aligner(A, B)
    aligner.a = Counting(aligner.a)
    texts = [" ".join(WORDS), "with a▁b in it"]
    got = list(aligner.documents(texts))
    assert aligner.a.n < 40 and got[1] == (0, 0, 0, 0, "", Counter())
    assert got[0] == next(ALIGNER.documents(texts[:1])) and got[0][2] == len(groups_of(texts[0]))


def test_counts_in_parts(monkeypatch):
    texts = [" ".join(WORDS[:40] * 2), None, "a ▁", " ".join(WORDS[30:90])]
    want = list(ALIGNER.documents(texts))
    monkeypatch.setattr(alignment, "EXPAND", 7)
    assert list(ALIGNER.documents(texts)) == want


def test_long_units_are_not_kept(monkeypatch):
    aligner = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "LONG", 1000)
    texts = ["short " + "ab" * 400]
    first = list(aligner.documents(texts))
    assert aligner.full()
    assert list(aligner.documents(["short"])) and max(map(len, aligner.numbers)) < 10 and not aligner.full()
    assert list(aligner.documents(texts)) == first


def test_small_blocks_reach_the_workers(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(alignment, "BLOCK_DOCS", 3)
    write = alignment.table
    monkeypatch.setattr(alignment, "table", lambda df, name: seen.setdefault(name, write(df, name)))
    df = spark.createDataFrame([(*d, 1, "x", 2, "y") for d in DOCS], SCHEMA)
    assert rows(alignment.align(df.repartition(2), A, B)) == brute(DOCS)
    assert seen["aligned"].filter("kind = 0").groupBy("block").count().agg({"count": "max"}).first()[0] == 3
