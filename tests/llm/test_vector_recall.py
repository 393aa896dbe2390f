"""Recall of the collision counts where there are links: near copies planted among the given embeddings."""

import os

import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import vector_dedup

SF = "/root/testdata/sf0.1"


def at_cosine(rng, a, c):
    """A vector at this cosine of each."""
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    return c[:, None] * a + np.sqrt(1 - c[:, None] ** 2) * b / np.linalg.norm(b, axis=1)[:, None]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_planted_near_copies_are_all_linked(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = np.array(rows["embedding"].tolist(), np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    rng = np.random.default_rng(11)
    of = rng.permutation(len(x))[: len(x) // 2]
    near = (at_cosine(rng, unit[of], rng.uniform(0.9301, 0.95, len(of))) * rng.uniform(0.5, 3, len(of))[:, None]).astype(np.float32)
    label = rows["label"].to_numpy()
    every, labels = np.concatenate((x.astype(np.float32), near)), np.concatenate((label, label[of]))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(every, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(links, False)
    got = np.zeros(len(every), int)
    for r in vector_dedup.near_duplicates(df).collect():
        got[r["vec_id"]] = r["n_links"]
    assert links.sum() >= len(of) and (got <= links.sum(1)).all()
    assert got.sum() >= 0.999 * links.sum()


def test_pairs_at_the_threshold_fail_as_seldom_as_promised():
    rng = np.random.default_rng(4)
    for size in (100, 30_000):
        plan = vector_dedup.calibrated(size, 0.93, 1.5, 1e-4)
        n, failed = 12_000, 0
        axes = rng.standard_normal((24, plan.lines), np.float32)
        for _ in range(2):
            a = rng.normal(size=(n, 24))
            a /= np.linalg.norm(a, axis=1)[:, None]
            marks = vector_dedup.marks_of(np.concatenate((a, at_cosine(rng, a, np.full(n, 0.93)))), axes, plan)
            lists = vector_dedup.padded(pa.array([m.tolist() for m in marks], pa.list_(pa.int32())))
            i = np.arange(n)
            failed += (~vector_dedup.colliding(lists, i, i + n, plan)[0]).sum()
        assert failed <= 12  # 2.4 expected of 24,000; the lines are the same for all of them
