"""Scans that read only what they need, and scans of orders that no task sees whole."""

import random
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lodestone.operators import logs, sampling
from lodestone.sources import readers, row_groups, sinks
from pyspark.sql import functions as F

# ---- row groups as a data source


@pytest.fixture
def corpus(tmp_path):
    """Three files of four row groups of five rows, and one empty."""
    rows = []
    for f in range(3):
        texts = [f"f{f} r{i} " + "é" * (i * 7 % 11) for i in range(20)]
        texts[3] = None
        pq.write_table(pa.table({"id": list(range(f * 20, f * 20 + 20)), "text": texts, "junk": ["x" * 50] * 20}), tmp_path / f"shard_{f}.parquet", row_group_size=5, use_dictionary=False)
        rows += [(f, i // 5, i % 5, t) for i, t in enumerate(texts)]
    pq.write_table(pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "junk": pa.array([], pa.string())}), tmp_path / "shard_3.parquet")
    return str(tmp_path), rows


def spoil(path: str, file: int, groups: set[int], columns: set[str] | None = None) -> None:
    """Overwrites the pages of these row groups, so that whoever reads them fails or gets other bytes."""
    at = Path(path) / f"shard_{file}.parquet"
    meta, raw = pq.read_metadata(at), bytearray(at.read_bytes())
    for g in groups:
        for i in range(meta.num_columns):
            c = meta.row_group(g).column(i)
            if columns is None or c.path_in_schema in columns:
                raw[c.data_page_offset : c.data_page_offset + c.total_compressed_size] = b"\xff" * c.total_compressed_size
    at.write_bytes(raw)


def test_footers_make_the_plan(spark, corpus):
    path, rows = corpus
    plan = row_groups.chosen(spark, row_groups.plan(spark, path)).orderBy("file_pos", "rg").collect()
    assert [(r["file_pos"], r["rg"], r["first"], r["n"], r["split"]) for r in plan if r["n"]] == [(f, g, g * 5, 5, "train") for f in range(3) for g in range(4)]
    assert all(r["column_bytes"]["text"] > 0 for r in plan if r["n"])


@pytest.mark.parametrize("start, step", [(0, 1), (1, 2), (2, 3), (3, 4), (9, 1)])
def test_only_chosen_groups_are_read(spark, corpus, start, step):
    path, rows = corpus
    plan = row_groups.plan(spark, path)
    chosen = {g for g in range(4) if g >= start and (g - start) % step == 0}
    for f in range(3):
        spoil(path, f, set(range(4)) - chosen)
        spoil(path, f, chosen, {"junk"})  # a column that is not asked for
    got = row_groups.scan(spark, plan, "pos bigint, text string, file_pos int, rg int, row bigint, id bigint", start=start, step=step).collect()
    assert sorted((r["file_pos"], r["rg"], r["pos"], r["text"] or "") for r in got) == sorted((f, g, p, t or "") for f, g, p, t in rows if g in chosen)
    assert all(r["row"] == r["rg"] * 5 + r["pos"] and r["id"] == r["file_pos"] * 20 + r["row"] for r in got)


def test_spoilt_groups_do_fail(spark, corpus):
    path, _ = corpus
    plan = row_groups.plan(spark, path)
    spoil(path, 1, {2})
    with pytest.raises(Exception):
        row_groups.scan(spark, plan).collect()


def test_splits_spans_and_bare_rows(spark, corpus):
    path, rows = corpus
    plan = row_groups.plan(spark, path)
    assert row_groups.scan(spark, plan, split="val").count() == 0  # the last file is empty
    assert row_groups.scan(spark, plan, split="train").count() == 60
    assert row_groups.scan(spark, plan, "rg int", after=(0, 2), until=(1, 0)).groupBy("rg").count().orderBy("rg").collect() == [(0, 5), (3, 5)]
    with pytest.raises(Exception, match="train or val"):
        row_groups.scan(spark, plan, split="test").collect()


def test_corpus_goes_through_it(spark, corpus):
    path, rows = corpus
    got = readers.corpus(spark, path, "train", start=1, step=2)
    assert sorted((r["rg"], r["pos"], r["text"] or "") for r in got.collect()) == sorted((g, p, t or "") for _, g, p, t in rows if g % 2)
    virtual = readers.corpus(spark, path, "train", row_group=8, start=1, step=1).collect()
    assert sorted((r["rg"], r["pos"]) for r in virtual) == sorted([(i // 8, i % 8) for i in range(8, 20)] * 3)


# ---- scans that stop at a budget


@pytest.mark.parametrize("crossing", ["le", "lt"])
@pytest.mark.parametrize("budget", [0, 1, 60, 61, 200, 333, 500, 10_000])
def test_early_stop(spark, corpus, budget, crossing):
    path, rows = corpus
    want, prior = [], 0
    for f, g, p, t in rows:
        if prior < budget or (prior == budget and crossing == "le"):
            want.append((f, g, p, t and t[:9]))
        prior += len((t or "")[:9])
    plan = row_groups.plan(spark, path)
    last = max([(f, g) for f, g, *_ in want], default=(0, -1))
    for f in range(3):  # what lies two groups or more behind the boundary is not read
        spoil(path, f, {g for g in range(4) if f * 4 + g >= last[0] * 4 + last[1] + 3})
    got = readers.early_stop(spark, path, budget, crop=9, crossing=crossing, plan=plan).collect()
    assert sorted((r["file_pos"], r["rg"], r["pos"], r["text"] or "") for r in got) == sorted((f, g, p, t or "") for f, g, p, t in want)


@pytest.mark.parametrize("edge_rows", [3, 100_000])
@pytest.mark.parametrize("crossing", ["le", "lt"])
def test_within_budget(spark, monkeypatch, edge_rows, crossing):
    monkeypatch.setattr(sampling, "EDGE_ROWS", edge_rows)
    rng = random.Random(edge_rows)
    rows = [(i * 3 + rng.randrange(3), rng.choice([0, 0, 1, 5, 900]), "x") for i in range(500)] + [(None, 7, "x")]
    df = spark.createDataFrame(rows, "at int, size int, text string").repartition(3)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    total = sum(r[1] for r in rows)
    for budget in (0, 6, 7, 8, 1000, total // 2, total - 1, total, total + 1):
        want, prior = [], 0
        for r in ordered:
            if prior < budget or (prior == budget and crossing == "le"):
                want.append(r)
            prior += r[1]
        got = sampling.within_budget(df, "at", F.col("size"), budget, crossing)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr), budget
    assert sampling.within_budget(df.limit(0), "at", F.col("size"), 5, crossing).count() == 0


def test_the_budget_reaches_the_scan(spark, tmp_path):
    spark.range(0, 50_000).select("id", F.lit(10).alias("size"), F.repeat(F.lit("x"), 100).alias("text")).coalesce(1).write.option("parquet.block.row.count.limit", 1000).parquet(str(tmp_path / "t"))
    (at,) = (tmp_path / "t").glob("*.parquet")
    got = sampling.within_budget(spark.read.parquet(str(tmp_path / "t")), "id", F.col("size"), 100_000)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(id," in plan
    assert got.count() == 10_001
    # texts behind the boundary can be anything: no task reads them
    meta, raw = pq.read_metadata(at), bytearray(at.read_bytes())
    for g in range(13, meta.num_row_groups):
        c = meta.row_group(g).column(2)
        begin = c.dictionary_page_offset or c.data_page_offset
        raw[begin : begin + c.total_compressed_size] = b"\xff" * c.total_compressed_size
    at.write_bytes(raw)
    (tmp_path / "t" / f".{at.name}.crc").unlink()
    again = sampling.within_budget(spark.read.parquet(str(tmp_path / "t")), "id", F.col("size"), 100_000)
    assert again.agg(F.sum(F.length("text"))).first()[0] == 1_000_100


# ---- shards


@pytest.mark.parametrize("chunk", [3, 20, 65_536])
@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_the_fold(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(sampling, "CHUNK", chunk)
    rng = random.Random(seed)
    n = rng.choice([1, 7, 60, 200])
    sizes = [rng.choice([0, 0, 1, 3, rng.randrange(40), 500 if seed % 2 else 9]) for _ in range(n)]
    block, limit = rng.choice([1, 2, 5]), rng.choice([1, 20, 100])
    want, shard, held = {}, 0, 0
    for i, s in enumerate(sizes):
        want[i] = shard
        held += s
        if i % block == block - 1 and held >= limit:
            shard, held = shard + 1, 0
    df = spark.createDataFrame(list(enumerate(sizes)), "id int, size int").repartition(3)
    got = {r["id"]: r["shard"] for r in sampling.shard_cuts(df, "id", F.col("size"), limit, block).collect()}
    assert got == want


def test_cuts_of_one_whole_chunk(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CHUNK", 6)
    for n, shards in ((6, [0, 0, 1, 1, 2, 2]), (7, [0, 0, 1, 1, 2, 2, 3]), (12, [i // 2 for i in range(12)])):
        df = spark.createDataFrame([(i, 1) for i in range(n)], "id int, size int")
        assert [r["shard"] for r in sampling.shard_cuts(df, "id", F.col("size"), 2, 1).orderBy("id").collect()] == shards


def test_cuts_of_nothing(spark):
    df = spark.createDataFrame([], "id int, size int")
    assert sampling.shard_cuts(df, "id", F.col("size"), 5, 2).count() == 0
    with pytest.raises(ValueError):
        sampling.shard_cuts(df, "id", F.col("size"), 0)


def test_rows_keep_their_order_in_a_shard(spark, tmp_path):
    spark.range(0, 3000).select("id", F.col("id").cast("string").alias("text")).repartition(7).createOrReplaceTempView("unordered")
    sinks.write_shards(spark.table("unordered"), str(tmp_path / "s"), "id", shard_chars=2000, row_group=64)
    plan = row_groups.plan(spark, str(tmp_path / "s"))
    got = row_groups.scan(spark, plan, "text string, file_pos int, rg int, pos bigint").orderBy("file_pos", "rg", "pos").collect()
    assert [int(r["text"]) for r in got] == list(range(3000))


# ---- logs


def a_log(rng, n):
    lines = []
    for i in range(n):
        lines.append(rng.choice([f"Step: {i}/9 | Loss: {i}.5 | lr tkps: {i} | mfu: 1.5", "noise", "", "\t<|bos|>made it", "  more of it", "\tPeak bytes reserved/limit: 2.5/9.0GB", "tail\r"]))
    return lines


def brute(lines):
    """step of each line, and the last batch of generations."""
    import re

    steps, step, gens, batch, open_ = [], 0, {}, 0, None
    for line in lines:
        m = re.match(logs.STEP, line)
        if m:
            step, batch = int(m[1]), batch + 1
        steps.append(step)
        if line.startswith(logs.GENERATION):
            open_ = [line.strip()]
            gens.setdefault(batch, []).append(open_)
        elif m or re.match(logs.METRIC, line):
            open_ = None
        elif open_ is not None:
            open_.append(line)
    return steps, ["\n".join(g) for g in gens[max(gens)]] if gens else []


@pytest.mark.parametrize("span", [1, 7, 100_000])
def test_logs_of_any_size(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(logs, "SPAN_LINES", span)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rng = random.Random(span)
        texts = {f"l{k}.txt": a_log(rng, n) for k, n in enumerate((1, 40, 200))}
        for name, lines in texts.items():
            (tmp_path / name).write_bytes("\n".join(lines + [""] * (name == "l1.txt")).encode())
        (tmp_path / "empty.txt").write_text("")
        read = readers.log_lines(spark, str(tmp_path)).withColumn("log", F.substring_index("log", "/", -1))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        stepped = logs.with_step(read).collect()
        shown = logs.generations(read).collect()
        for name, lines in texts.items():
            while lines and lines[-1] == "" and name != "l1.txt":
                lines = lines[:-1]  # nothing follows the last line feed
            mine = sorted((r["line_no"], r["line"], r["step"]) for r in stepped if r["log"] == name)
            steps, gens = brute(lines)
            assert mine == [(i, x, s) for i, (x, s) in enumerate(zip(lines, steps, strict=True))]
            assert [r["text"] for r in sorted((r for r in shown if r["log"] == name), key=lambda r: r["n"])] == gens
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
