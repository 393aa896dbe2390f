"""The endless source: order, epochs, ratio, and where it goes on."""

import json
import random
from math import gcd

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lodestone.sources import row_groups
from lodestone.streaming import endless


@pytest.fixture
def plans(spark, tmp_path):
    """Two files of three groups, the second without its last; and one file of two groups."""
    for name, files in (("a", (3, 2)), ("b", (2,))):
        (tmp_path / name).mkdir()
        for f, groups in enumerate(files):
            texts = [f"{name}{f}{g}{p}" for g in range(groups) for p in range(4)]
            pq.write_table(pa.table({"text": texts}), tmp_path / name / f"{f}.parquet", row_group_size=4)
    return [row_groups.plan(spark, str(tmp_path / x)) for x in "ab"]


def reader(plans, **options):
    return endless.StepReader({"plans": json.dumps(plans)} | {k: str(v) for k, v in options.items()})


def taken(r, start, n):
    return r.readBetweenOffsets(start, {"step": start["step"] + n})


def test_one_source_goes_round_in_order(plans):
    got = [row[2:3] + row[4:] for row in taken(reader(plans[:1]), {"step": 0, "second": 0}, 12)]
    once = [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert got == [(e, *once[x]) for e in range(3) for x in range(5)][:12]


def test_ranks_share_an_epoch(plans):
    parts = [[row[4:] for row in taken(reader(plans[:1], start=r, step=2), {"step": 0, "second": 0}, n)] for r, n in ((0, 3), (1, 2))]
    assert sorted(parts[0] + parts[1]) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
@pytest.mark.parametrize("shuffle", ["true", "false"])
def test_stopped_anywhere_it_goes_on_alike(plans, ratio, shuffle):
    r = reader(plans, ratio=ratio, seed="s", shuffle=shuffle, per_trigger=7)
    every = list(taken(r, {"step": 0, "second": 0}, 100))
    rng, offset, got = random.Random(1), r.initialOffset(), []
    while len(got) < 100:
        again = reader(plans, ratio=ratio, seed="s", shuffle=shuffle, per_trigger=rng.randrange(1, 9))
        rows, end = again.read(offset)
        rows = list(rows)
        assert rows == list(r.readBetweenOffsets(offset, end))
        got, offset = got + rows, end
    assert got[:100] == every
    share = sum(row[1] for row in every) / 100
    assert share == ratio if ratio in (0, 1) else 0.15 < share < 0.45
    for source, groups in ((0, 5), (1, 2)):  # each epoch meets each of its groups once
        mine = [row for row in every if row[1] == source]
        for e in range(len(mine) // groups):
            assert len({row[3:] for row in mine if row[2] == e}) == groups


@pytest.mark.parametrize("n", [1, 2, 3, 8, 30, 97, 360])
def test_places_are_permuted(n):
    orders = {tuple(endless.permuted(x, n, "seed", e) for x in range(n)) for e in range(6)}
    assert all(sorted(o) == list(range(n)) for o in orders) and (n < 8 or len(orders) > 3)
    assert gcd(n, n) == n


def test_last_step_and_bad_sources(plans, tmp_path, spark):
    r = reader(plans[:1], steps=3, per_trigger=2)
    rows, end = r.read({"step": 2, "second": 0})
    assert len(list(rows)) == 1 and end == {"step": 3, "second": 0}
    rows, end = r.read(end)
    assert list(rows) == [] and end == {"step": 3, "second": 0}
    with pytest.raises(ValueError, match="never ends"):
        reader(plans[:1], start=7)
    with pytest.raises(ValueError, match="one source, or two"):
        reader(plans * 2)


def test_texts_of_a_stream(spark, plans, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(3):  # two steps a run
        stream = endless.texts(endless.steps(spark, plans, 0.5, "x", per_trigger=2, last=5))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    want = [(row[0], row[1], row[2], f"{'ab'[row[1]]}{row[4]}{row[5]}{p}", p) for row in taken(reader(plans, ratio=0.5, seed="x"), {"step": 0, "second": 0}, 5) for p in range(4)]
    got = sorted((r["step"], r["source"], r["epoch"], r["text"], r["pos"]) for r in spark.read.parquet(out).collect())
    assert got == sorted(want)
