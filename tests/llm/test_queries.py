"""The registered queries at the smallest scale: SQL where there is some, brute force where there is none."""

import os

import duckdb
import numpy as np
import pytest
from lodestone.llm.queries import QUERIES, SQL

from tests.test_plans import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_near_duplicates(spark):
    from tests.llm.test_operators import brute_jaccard

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in QUERIES["op3_ngram_jaccard"](spark, SF).collect()}
    assert got == brute_jaccard(docs)


def test_pseudonyms(spark):
    from lodestone.llm.pii import Pseudonyms
    from lodestone.llm.queries import KEY

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    back = Pseudonyms(KEY, undo=True)
    for r in QUERIES["op8_feistel_pii"](spark, SF).collect():
        assert back.rewrite(r["text"])[0] == docs[r["doc_id"]]


def test_quality_holds_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op2_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in got]) > 0.95


def test_rows_that_share_an_id_stay_by_their_texts(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"v{i}" for i in range(60)), "z y x"
    rows = [(1, text), (2, text + " end"), (2, other), (2, other), (2, third), (3, other + " end"), (4, text), (5, None), (5, None), (5, ""), (None, text), (None, text), (6, third + " a b c d"), (6, "q r s t u " * 9 + "v"), (6, "q r s t u " * 9 + "v.")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, df, SF).collect()), key=repr)
    want = [(1, text), (2, other), (2, third), (5, None), (5, ""), (None, text), (None, text), (6, third + " a b c d"), (6, "q r s t u " * 9 + "v")]
    assert got == sorted(want, key=repr)


def test_rows_leave_the_mix_as_often_as_it_takes_them(spark):
    from collections import Counter

    import corpus_pipeline
    from lodestone.llm import mixing

    rng = np.random.default_rng(8)
    rows = [(i % 100 if i % 5 else None, "w " * int(rng.integers(1, 40)), "en", f"s{i % 7 % 3}", 0) for i in range(400)] + [(7, "same text here", "en", "s0", 14)] * 600 + [(7, "same text here", "de", "s1", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = lambda t: len(t.split())
    mixed = mixing.mix(df, keep=("lang", "n_chars")).collect()
    got = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in corpus_pipeline.mix_sources(spark, df, SF).collect())
    times = Counter(rows)
    assert all(0 < n <= 3 * times[r] for r, n in got.items())
    words = sum(size(r[1]) * n for r, n in got.items())
    assert words == sum(r["taken"] for r in mixed) <= sum(size(r[1]) for r in rows) <= words + 40
    by = lambda i, s: sum(size(r[1]) * n for r, n in got.items() if r[0] == i and size(r[1]) == s)
    for i, s in {(r["doc_id"], r["size"]) for r in mixed}:
        assert by(i, s) == sum(r["taken"] for r in mixed if r["doc_id"] == i and r["size"] == s)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
            out = spark.createDataFrame(out.collect(), out.schema)
        docs = out
        if k < 3:
            assert 0 < docs.count() <= n
            n = docs.count()
    rows = docs.collect()
    assert rows and all(r["n_tokens"] > 0 for r in rows)
