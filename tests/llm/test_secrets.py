"""The secret scan's dictionary and labels from documents, held-out precision and recall, and scores one by one."""

import os
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import secrets

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")


@pytest.fixture(scope="module")
def words(docs):
    return secrets.dictionary(docs)


def test_dictionary_is_counted_over_all_documents(docs, words, monkeypatch):
    n = Counter()
    for r in docs.collect():
        n.update({w for w in re.split("[^a-z]+", (r["text"] or "").lower()) if 4 <= len(w) <= 16})
    assert words == {w for w, k in n.items() if k >= 5} and len(words) > 100
    for most in (50, 3, 0):
        monkeypatch.setattr(secrets, "MOST_WORDS", most)
        reached = [k for k in range(5, max(n.values()) + 2) if sum(v >= k for v in n.values()) <= most]
        assert secrets.dictionary(docs) == {w for w, v in n.items() if v >= reached[0]}


def test_dictionary_of_nothing(spark, docs):
    assert secrets.dictionary(docs.limit(0)) == frozenset()
    assert secrets.dictionary(spark.createDataFrame([(None,), ("",), ("ab " * 9,)], "text string")) == frozenset()


@settings(max_examples=200, deadline=None)
@given(st.text("abcdxyz-9", max_size=40), st.frozensets(st.text("abcd", min_size=4, max_size=6), max_size=8))
def test_coverage(low, some):
    want = np.zeros(len(low), bool)
    for w in [*some, *(x for x in secrets.DICTIONARY if len(x) >= 3)]:
        for at in range(len(low) - len(w) + 1):
            if low[at : at + len(w)] == w:
                want[at : at + len(w)] = True
    assert (secrets.coverage(low, some) == want).all()


def test_planted_findings_hold_their_values(docs):
    rows = secrets.planted_findings(docs, 300).collect()
    assert len(rows) == 300 and {r["label"] for r in rows} == {0, 1}
    drawn = {t[s:e] for t, s, e, *_ in secrets.example_findings(300, 5)}
    assert all(r["text"][r["start_at"] : r["end_at"]] in drawn for r in rows)
    assert len({r["path"] for r in rows}) > 5
    again = secrets.planted_findings(docs.repartition(7), 300).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert secrets.planted_findings(docs.limit(0), 300).count() == 0


def test_held_out_precision_and_recall(spark, docs, words):
    """Values of another draw, in the words of documents that taught nothing."""
    teach, hold = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    forest = secrets.train(secrets.planted_findings(teach, 400).unionByName(spark.createDataFrame(secrets.example_findings(1500), "text string, start_at int, end_at int, path string, label int")), words)
    rows = secrets.planted_findings(hold, 400, seed=77).collect()
    p = forest.predict(np.array([secrets.features(r["text"], r["start_at"], r["end_at"], r["path"], words) for r in rows])) >= 0.5
    y = np.array([r["label"] for r in rows]) == 1
    precision, recall = (p & y).sum() / p.sum(), (p & y).sum() / y.sum()
    print(f"precision {precision:.3f}, recall {recall:.3f} of {y.sum()}")
    assert precision > 0.93 and recall > 0.93


def test_scores_one_by_one(docs, words):
    forest = secrets.train(secrets.planted_findings(docs, 500), words)
    for r in secrets.scan(docs, forest).collect():
        spans = secrets.candidates(r["text"]) if r["text"] else []
        scored = [(s, e, float(forest.predict(np.array([secrets.features(r["text"], s, e, r["source"], words)]))[0])) for s, e in spans]
        best = []
        for s, e, v in sorted((x for x in scored if x[2] >= 0.5), key=lambda x: (-x[2], x[0] - x[1], x[0])):
            if all(e <= a or b <= s for a, b, _ in best):
                best.append((s, e, v))
        assert r["n_candidates"] == len(spans) and [(x["start"], x["end"]) for x in r["secrets"]] == sorted((s, e) for s, e, _ in best)


def test_a_very_long_candidate(spark, words):
    forest = secrets.train(spark.createDataFrame(secrets.example_findings(400), "text string, start_at int, end_at int, path string, label int"), words)
    df = spark.createDataFrame([(1, "token = " + "aB3x" * 20_000, None)], "doc_id long, text string, source string")
    assert secrets.scan(df, forest).first()["n_candidates"] == 1
