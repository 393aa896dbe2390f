"""The divergence audit against all terms by all groups, and on odd inputs."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top):
    docs = [(s or "", g or "", TERM.findall((t or "").translate(UPPER))) for s, g, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held, n = Counter(), {}
        for _, source, terms in (d for d in docs if d[0] == lang):
            held.update(set(terms))
            n.setdefault(source, Counter()).update(terms)
        kept = [t for t, k in held.items() if k >= least]
        share = lambda c, v=len(kept), kept=kept: {t: 1 + 1000000000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        p, q = {s: share(c) for s, c in n.items()}, share(sum(n.values(), Counter()))
        for a in n:
            pairs = [(b, sum(abs(p[a][t] - p[b][t]) for t in kept)) for b in n if b != a]
            terms = [(t, p[a][t] - q[t]) for t in kept if n[a][t] and p[a][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, a, part, item, value, i) for i, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def rows(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


SCHEMA = "lang string, source string, text string, term int, rank string, n int, p int"


@pytest.mark.parametrize("least, top, small", [(30, 50, False), (3, 4, True), (1, 50, True)])
def test_audit(spark, monkeypatch, least, top, small):
    if small:
        for name, value in (("ENTRIES", 50), ("PIECE", 16), ("PAIRS", 7)):
            monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(least)
    words = ["The", "the", "Ünder", "ünder", "Straße", "a1b", "x_y", "İz", "東京", "don't", "🙂", "naïve", "zeta", "Eta"]
    docs = [(["en", "de", None, ""][int(rng.integers(4)) % 3 + (i % 7 == 0)], [None, "", "s1", "s2", "s3"][min(4, int(rng.integers(9)))], " ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(1, 15) / 105))) for i in range(400)]
    docs += [("en", "bare", "12 34 ,,"), ("en", "none", None), ("fr", "s1", "rare words"), ("fr", "s2", ""), ("en", "s1", "LONG " * 20_000 + "long"), ("en", "s1", "z" * 70_000)] + [("en", "s9", "copy of a text")] * 40
    df = spark.createDataFrame([(*d, 1, "r", 2, 3) for d in docs], SCHEMA)
    got = rows(divergence.audit(df.repartition(3), least, top))
    assert got == brute(docs, least, top)
    assert {r[4] for r in got if r[0] == "fr" and r[2] == "pair"} == {0} or least == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(divergence.audit(df)) == []
    lone = spark.createDataFrame([("en", "s", None, 1, "", 1, 1)], SCHEMA)
    assert rows(divergence.audit(lone)) == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x7F), st.sampled_from("ßİ東é\x80\x85\xa0 🙂")), max_size=60), st.integers(1, 9))
def test_pieces_are_the_pattern(text, piece):
    was, divergence.PIECE = divergence.PIECE, piece
    try:
        got = [w.decode() for words in divergence.pieces(text.encode()) for w in words]
    finally:
        divergence.PIECE = was
    assert got == TERM.findall(text.translate(UPPER))


def test_shares_are_exact(spark):
    rng = np.random.default_rng(1)
    cases = [(0, 0, 1), (5, 5, 1), (0, 0, 7), (10**14, 10**14, 3)] + [(int(c), int(c) + int(n), int(v)) for c, n, v in zip(rng.integers(0, 10**14, 300), rng.integers(0, 10**15, 300), rng.integers(1, 10**9, 300), strict=True)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "c long, n long, v long").withColumn("p", F.expr(divergence._share("c", "n", "v")))
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) for r in df.collect())
