"""Sources: corpus shards by row group, conversation and preference JSONL, benchmark bundles, logs, blobs."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import conversations as C
from lodestone.operators.sampling import head_fraction, running_sum, shuffled
from lodestone.sources import row_groups, shared


def shards(spark: SparkSession, path: str) -> DataFrame:
    """Files of a corpus in lexicographic order: file, pos, split (the last one is val)."""
    return row_groups.files(spark, path)


def corpus(spark: SparkSession, path: str, split: str, row_group: int | None = None, start: int = 0, step: int = 1, text: str = "text", plan: str | None = None) -> DataFrame:
    """text, file, rg, pos of a split: all files but the last are train, the last is val; of each file the row
    groups start, start + step, ..., as the file's footer has them, or of row_group rows where that is given; pos is
    the place in the group. plan is that of `row_groups.plan`, for several reads of one corpus.

    A corpus of one file has no train split, which is an error rather than an empty corpus.
    """
    if split not in ("train", "val"):
        raise ValueError("split is train or val")
    plan = plan or row_groups.plan(spark, path)
    if split == "train" and row_groups.chosen(spark, plan).filter("split = 'train'").isEmpty() and not row_groups.chosen(spark, plan).isEmpty():
        raise ValueError("a corpus of one shard has no train split")
    if row_group is None:
        return row_groups.scan(spark, plan, f"{text} string, file string, rg int, pos bigint", split, start, step).withColumnRenamed(text, "text")
    rows = row_groups.scan(spark, plan, f"{text} string, file string, row bigint", split).withColumnRenamed(text, "text")
    rows = rows.withColumns({"rg": F.floor(F.col("row") / row_group).cast("int"), "pos": F.pmod("row", F.lit(row_group))})
    return rows.filter((F.col("rg") >= start) & (F.pmod(F.col("rg") - start, F.lit(step)) == 0)).drop("row")


def early_stop(spark: SparkSession, path: str, budget: int, crop: int | None = None, split: str | None = "train", start: int = 0, step: int = 1, text: str = "text", crossing: str = "le", plan: str | None = None) -> DataFrame:
    """text, file, file_pos, rg, pos of a corpus in its order, until the characters before a row pass the budget, as
    `within_budget` has it; texts are cropped to `crop` characters, and count so.

    Row groups are read in waves. The footers tell how many bytes of text each group has, so a wave takes the groups
    that should fill what is left of the budget; it sums their characters, a row for each group. Then the groups before
    the boundary are read whole and the boundary group alone is cut by a window. Groups behind the last wave are never
    read.
    """
    plan = plan or row_groups.plan(spark, path)
    head = (lambda c: F.substring(c, 1, crop)) if crop is not None else F.col
    groups = row_groups.chosen(spark, plan).filter((F.col("rg") >= start) & (F.pmod(F.col("rg") - start, F.lit(step)) == 0))
    if split is not None:
        groups = groups.filter(F.col("split") == split)
    size = F.coalesce(F.col("column_bytes")[text], F.lit(0))
    most = F.least(size, F.col("n") * crop) if crop is not None else size  # no group has more characters
    groups = running_sum(groups.filter("n > 0").withColumn("place_", F.col("file_pos").cast("bigint") * (1 << 31) + F.col("rg")), "place_", most, "through_").select("file_pos", "rg", "place_", "through_")
    groups = shared.table(groups, "groups")
    reached = lambda total: total > budget if crossing == "le" else total >= budget
    waves, held, after, through = None, 0, None, 0
    while not reached(held):
        want = max(int((budget - held) * 1.1), 1)
        left = groups if after is None else groups.filter(F.col("place_") > (after[0] << 31) + after[1])
        ends = left.agg(F.min(F.when(F.col("through_") >= through + want, F.col("place_"))), F.max("place_")).first()
        last = ends[1] if ends[0] is None else ends[0]
        if last is None:
            break  # the whole corpus is within the budget
        until = last >> 31, last & ((1 << 31) - 1)
        wave = row_groups.scan(spark, plan, f"{text} string, file_pos int, rg int", split, start, step, after, until)
        wave = shared.table(wave.groupBy("file_pos", "rg").agg(F.coalesce(F.sum(F.length(head(text)).cast("bigint")), F.lit(0)).alias("size_")), "wave")
        waves = wave if waves is None else waves.unionByName(wave)
        held += wave.agg(F.sum("size_")).first()[0] or 0
        after, through = until, groups.filter(F.col("place_") == last).first()["through_"]
    schema = f"{text} string, file string, file_pos int, rg int, pos bigint"
    rows = lambda *span: row_groups.scan(spark, plan, schema, split, start, step, *span).withColumn(text, head(text)).withColumnRenamed(text, "text")
    if not reached(held):
        return rows()
    if waves is None:
        return rows((0, -1), (0, -1))
    sums = running_sum(waves.withColumn("place_", F.col("file_pos").cast("bigint") * (1 << 31) + F.col("rg")), "place_", F.col("size_"), "sum_")
    cut_at = sums.filter(F.col("sum_") > budget if crossing == "le" else F.col("sum_") >= budget).orderBy("place_").first()
    edge, before = (cut_at["file_pos"], cut_at["rg"]), cut_at["sum_"] - cut_at["size_"]
    w = Window.partitionBy("rg").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # one row group
    cut = rows((edge[0], edge[1] - 1), edge).withColumn("prior_", before + F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    cut = cut.filter(F.col("prior_") <= budget if crossing == "le" else F.col("prior_") < budget).drop("prior_")
    return rows(None, (edge[0], edge[1] - 1)).unionByName(cut)


def conversations(spark: SparkSession, path: str, seed: int | None = None, system_prompt: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """messages and the fields of rollouts, from JSON lines. Blank lines are skipped. PERMISSIVE keeps bad rows as null
    messages with the line in _corrupt, DROPMALFORMED drops them (a resume scan), FAILFAST stops (scenarios)."""
    schema = f"messages {C.RAW_MESSAGES}, _source string, _source_idx bigint, _original_code string, _scenario_id string, _scenario_prompt string, _generator_prompt string"
    if mode == "PERMISSIVE":
        schema += ", _corrupt string"
    df = spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    df = df.withColumn("messages", C.ordered(F.col("messages")))
    if system_prompt is not None:
        df = df.withColumn("messages", C.prepend_system(F.col("messages"), system_prompt))
    if seed is not None:
        df = shuffled(df.withColumn("json_", F.to_json("messages")), seed, "json_").drop("json_")
    return df


def preferences(spark: SparkSession, path: str, seed: int, frac: float = 1.0, system_prompt: str | None = None, answered: bool = False) -> DataFrame:
    """chosen and rejected messages, shuffled, of which the first int(n * frac) stay; answered filters the pairs
    in which both sides have an assistant's words, before the shuffle."""
    side = f"struct<messages:{C.RAW_MESSAGES},_original_code:string>"
    df = spark.read.schema(f"chosen {side}, rejected {side}, _source string, _source_idx bigint, prompt string, id string, generator_prompt string").json(path)
    df = df.withColumns({"chosen": C.ordered(F.col("chosen.messages")), "rejected": C.ordered(F.col("rejected.messages"))})
    if answered:
        df = df.filter(C.has_answer(F.col("chosen")) & C.has_answer(F.col("rejected")))
    df = shuffled(df.withColumn("json_", F.to_json(F.struct("chosen", "rejected"))), seed, "json_").drop("json_")
    df = head_fraction(df, frac)
    if system_prompt is not None:
        df = df.withColumns({c: C.prepend_system(F.col(c), system_prompt) for c in ("chosen", "rejected")})
    return df


def instructions(spark: SparkSession, path: str, most: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of instructions with _source_idx, its 0-based place in the files' order; the first most rows if given."""
    df = spark.read.format(fmt).load(path)
    if fmt == "parquet":  # places within files, and what the files before hold: one small row a file
        rows = df.withColumns({"file_": F.col("_metadata.file_path"), "row_": F.col("_metadata.row_index")})
        held = rows.groupBy("file_").agg(F.count(F.lit(1)).alias("n_"))
        w = Window.partitionBy(F.lit(0)).orderBy("file_").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select(F.col("file_").alias("f_"), F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("before_"))
        df = rows.join(F.broadcast(held), F.col("file_") == F.col("f_")).withColumn("_source_idx", F.col("before_") + F.col("row_")).drop("file_", "row_", "f_", "before_")
    else:
        df = running_sum(df.withColumn("order_", F.monotonically_increasing_id()), "order_", F.lit(1), "_source_idx", inclusive=False).drop("order_")
    return df if most is None else df.filter(F.col("_source_idx") < most)


def percent_slice(df: DataFrame, percent: int, pos: str = "_source_idx") -> DataFrame:
    """The first percent of the rows by place, rounded to the nearest row."""
    n = df.agg(F.count(F.lit(1)).alias("n_"))
    return df.join(F.broadcast(n)).filter(F.col(pos) < F.round(F.col("n_") * percent / 100)).drop("n_")


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """id, prompt, notes; any bad line stops the read."""
    return spark.read.schema("id string, prompt string, notes string").option("mode", "FAILFAST").json(path)


def bundle_tasks(spark: SparkSession, config: str) -> DataFrame:
    """label, task_type, dataset_uri, num_fewshot, delimiter of a benchmark's YAML: the list under icl_tasks."""
    tasks: list[dict] = []
    for raw in config.splitlines():
        bare = raw.split("#")[0].rstrip()
        item = bare.strip()
        if not item or item == "icl_tasks:":
            continue
        if item.startswith("- ") and ":" in item:
            tasks.append({})
            item = item[2:].strip()
        if item.startswith("- "):
            tasks[-1].setdefault("num_fewshot", int(item[2:]))
            continue
        key, _, value = item.partition(":")
        value = value.strip()
        if key == "num_fewshot" and value.startswith("["):
            tasks[-1][key] = int(value.strip("[]").split(",")[0])
        elif value and tasks:
            tasks[-1][key] = value[1:-1] if value[:1] in "'\"" else value
    rows = [(t["label"], t["icl_task_type"], t["dataset_uri"], t.get("num_fewshot", 0), t.get("continuation_delimiter", " ").encode().decode("unicode_escape")) for t in tasks]
    return spark.createDataFrame(rows, "label string, task_type string, dataset_uri string, num_fewshot int, delimiter string")


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """task and baseline (percent) of a benchmark's CSV."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col("Eval Task").alias("task"), F.col("Random baseline").cast("double").alias("baseline"))


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of any shape, with their 0-based place in the file. An item file is split as a whole, to keep its order."""
    item = "query string, choices array<string>, gold int, context_options array<string>, continuation string, context string"
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    return raw.select(F.col("pos").cast("bigint").alias("pos"), F.from_json("line", item).alias("i")).select("pos", "i.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log, line_no, line of text logs, whose lines end with a line feed. A long log is read in blocks by many tasks:
    lines are numbered within their block, and blocks by the lines of those before, so no task has a whole log.
    What follows the last line feed is a line if there is any of it."""
    at = F.monotonically_increasing_id()  # rises with the place in a block
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block_"), at.alias("at_"), F.col("value").alias("line"))
    blocks = rows.groupBy("log", "block_").agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))
    earlier = Window.partitionBy("log").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select(F.col("log").alias("log_"), F.col("block_").alias("b_"), "first_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"))
    met = rows.join(blocks, (F.col("log") == F.col("log_")) & (F.col("block_") == F.col("b_")))
    lines = met.select("log", (F.col("before_") + F.col("at_") - F.col("first_")).cast("int").alias("line_no"), "line")
    return lines.sortWithinPartitions("log", "line_no")


def decoded_blobs(rows: DataFrame, content: str = "content", encoding: str = "encoding", default: str = "utf-8", text: str = "text") -> DataFrame:
    """rows with the text of their gzip content in place of it, decoded with replacement by each row's own encoding
    (null: the default), and failed: content that is null, no gzip or cut off, or an encoding that is not known, has
    no text."""
    schema = rows.drop(content, text, "failed").withColumns({text: F.lit(None).cast("string"), "failed": F.lit(True)}).schema

    def one(raw: bytes | None, name: str | None) -> str | None:
        try:
            return None if raw is None else gzip.decompress(raw).decode(name or default, errors="replace")
        except (OSError, EOFError, LookupError, ValueError, zlib.error):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            held = b.column(names.index(encoding)).to_pylist() if encoding in names else [None] * b.num_rows
            for lo in range(0, b.num_rows, 64):  # contents are files
                part = b.slice(lo, 64)
                got = [one(raw, name) for raw, name in zip(part.column(names.index(content)).to_pylist(), held[lo : lo + 64], strict=True)]
                kept = [part.column(names.index(f.name)) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.string()), pa.array([t is None for t in got], pa.bool_())], names=schema.names)

    return rows.mapInArrow(run, schema)


def blobs(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """path and content of gzip files decoded with replacement; null where that fails."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return decoded_blobs(raw, default=encoding).select("path", F.col("text").alias("content"))


def repository_files(repos: DataFrame, min_stars: int, min_bytes: int, max_bytes: int, language: str = "Python", budget: float | None = None, slack: float = 1.2) -> DataFrame:
    """Files of (pos, star_events_count, files) that pass the metadata filter, whole repositories at a time until
    their bytes reach slack times the budget."""
    from lodestone.operators.sampling import within_budget

    fits = lambda f: (f["language"] == language) & ~F.coalesce(f["is_vendor"], F.lit(False)) & ~F.coalesce(f["is_generated"], F.lit(False)) & F.coalesce(f["length_bytes"], F.lit(0)).between(min_bytes, max_bytes)
    rows = repos.filter(F.coalesce("star_events_count", F.lit(0)) >= min_stars).withColumn("files", F.filter("files", fits))
    if budget is not None:
        size = F.aggregate("files", F.lit(0).cast("bigint"), lambda s, f: s + F.coalesce(f["length_bytes"], F.lit(0)).cast("bigint"))
        rows = within_budget(rows, "pos", size, int(budget * slack), "lt")
    return rows.select("pos", F.explode("files").alias("file")).select("pos", "file.*")
