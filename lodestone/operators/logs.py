"""Training logs: metrics by pattern, the step carried forward, generations, summaries and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import metric_text, strip

# The formats of log lines. Each series has its pattern and the names of its groups.
STEP = r"^Step: (\d+)/"
SERIES = {
    "train": (r"^Step: \d+/\d+ \| Loss: ([\d.]+) .* tkps: (\d+) \| mfu: ([\d.]+)", ("loss", "tkps", "mfu")),
    "memory": (r"^\tPeak bytes reserved/limit: ([\d.]+)/[\d.]+", ("memory (GB)",)),
    "base_bpb": (r"^\tfwe_bpb: ([\d.]+) \| sv2_bpb: ([\d.]+) \| avg_bpb: ([\d.]+)", ("fwe_bpb", "sv2_bpb", "avg_bpb")),
    "core": (r"^  CORE metric: ([\d.]+)", ("CORE",)),
    "sft_bpb": (r"^\trollout_bpb: ([\d.]+) \| chat_bpb: ([\d.]+) \| avg_bpb: ([\d.]+)", ("rollout_val_bpb", "chat_val_bpb", "avg_val_bpb")),
    "preference": (r"^Step: \d+/\d+ \| Loss: ([\d.]+) \| Acc: ([\d.]+) \| Margins: ([-\d.]+) \| Rewards \(chosen/rejected\): ([-\d.]+)/([-\d.]+)", ("loss", "accuracy", "margins", "chosen_reward", "rejected_reward")),
    "preference_eval": (r"^\tval bpb: ([\d.]+) \| val loss: ([\d.]+) \| val acc: ([\d.]+) \| val margins: ([-\d.]+)", ("rollout_val_bpb", "val_loss", "val_acc", "val_margins")),
}
SCALARS = {"training_minutes": r"^Total training time: ([\d.]+)min", "tokenizer_seconds": r"^Training time: ([\d.]+)s"}
TOKENS_PER_STEP = (r"^  batch_size: (\d+)", r"^  config: GPTConfig\(sequence_len=(\d+)", r"^[Ww]orld.size: (\d+)")
#: Series of each phase, in the order of its report.
PHASES = {"base": ("train", "base_bpb", "core", "memory"), "sft": ("train", "sft_bpb", "memory"), "dpo": ("preference", "preference_eval", "train", "memory")}
GENERATION, METRIC = "\t<|bos|>", r"^(\t(fwe_bpb|sv2_bpb|rollout_bpb|chat_bpb|val bpb|Peak bytes)|Evaluating:|Total training|Model \()"


#: Lines of a log that a window sees at once. What a log said before them comes in as one row.
SPAN_LINES = 100_000


def _scan(lines: DataFrame, log: str, line_no: str, **running: tuple[str, Column]) -> DataFrame:
    """lines with running values over each log: name=("last", value) is the last value that is not null, ("sum",
    value) the sum so far, both with the line itself. Spans of SPAN_LINES lines are summed up first, each to a row;
    these rows are scanned, and every span starts from what lies before it, so no window holds a whole log."""
    over = {"last": lambda c, w: F.last(c, ignorenulls=True).over(w), "sum": lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))}
    whole = {"last": lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(line_no))), "sum": lambda c: F.coalesce(F.sum(c), F.lit(0))}
    rows = lines.withColumn("span_", F.floor(F.col(line_no) / SPAN_LINES)).withColumns({f"{n}_in_": v for n, (_, v) in running.items()})
    spans = rows.groupBy(log, "span_").agg(*[whole[k](F.col(f"{n}_in_")).alias(f"{n}_all_") for n, (k, _) in running.items()])
    earlier = Window.partitionBy(log).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    spans = spans.select(F.col(log).alias("log_"), F.col("span_").alias("at_"), *[over[k](F.col(f"{n}_all_"), earlier).alias(f"{n}_before_") for n, (k, _) in running.items()])
    w = Window.partitionBy(log, "span_").orderBy(line_no).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.join(spans, F.col(log).eqNullSafe(F.col("log_")) & F.col("span_").eqNullSafe(F.col("at_")))
    own = {n: over[k](F.col(f"{n}_in_"), w) for n, (k, _) in running.items()}
    met = met.withColumns({n: F.coalesce(own[n], F.col(f"{n}_before_")) if k == "last" else own[n] + F.col(f"{n}_before_") for n, (k, _) in running.items()})
    return met.drop("span_", "log_", "at_", *[f"{n}{x}" for n in running for x in ("_in_", "_before_")])


def with_step(lines: DataFrame, log: str = "log", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """lines with the step that was last announced at or before each; 0 before the first."""
    own = F.regexp_extract(line, STEP, 1)
    return _scan(lines, log, line_no, step=("last", F.when(own != "", own.cast("bigint")))).withColumn("step", F.coalesce("step", F.lit(0)))


def metrics(lines: DataFrame, *series: str, log: str = "log", line: str = "line") -> DataFrame:
    """log, series, line_no, step, name, value: one row for each value of each line that a pattern matches."""

    def values(name: str) -> Column:
        pattern, names = SERIES[name]
        each = [F.struct(F.lit(name).alias("series"), F.lit(n).alias("name"), F.regexp_extract(line, pattern, i + 1).try_cast("double").alias("value")) for i, n in enumerate(names)]
        return F.when(F.col(line).rlike(pattern), F.array(*each)).otherwise(F.array().cast("array<struct<series:string,name:string,value:double>>"))

    rows = with_step(lines, log=log, line=line).withColumn("m_", F.explode(F.concat(*map(values, series or tuple(SERIES)))))
    return rows.select(log, "m_.series", "line_no", "step", "m_.name", "m_.value")


def scalars(lines: DataFrame, log: str = "log", line: str = "line") -> DataFrame:
    """log and the first value of each of SCALARS, and tokens_per_step if all its factors were logged."""
    first = lambda p: F.min_by(F.regexp_extract(line, p, 1), F.when(F.col(line).rlike(p), F.col("line_no"))).cast("double")
    last = lambda p: F.max_by(F.regexp_extract(line, p, 1), F.when(F.col(line).rlike(p), F.col("line_no"))).cast("bigint")
    out = lines.groupBy(log).agg(*[first(p).alias(n) for n, p in SCALARS.items()], *[last(p).alias(f"f{i}_") for i, p in enumerate(TOKENS_PER_STEP)])
    return out.withColumn("tokens_per_step", F.nullif(F.col("f0_") * F.col("f1_") * F.col("f2_"), F.lit(0))).drop("f0_", "f1_", "f2_")


def generations(lines: DataFrame, log: str = "log", line: str = "line") -> DataFrame:
    """log, n, text of the last batch of generations, where batches end at steps. A generation starts at its
    mark and ends before the next mark, a step, or a metric's line: islands by running counts."""
    is_step, opens = F.col(line).rlike(STEP), F.startswith(F.col(line), F.lit(GENERATION))
    ends = is_step | F.col(line).rlike(METRIC)
    rows = _scan(lines, log, "line_no", batch_=("sum", is_step.cast("int")), gen_=("sum", (opens | ends).cast("int"))).withColumns({"opens_": opens, "ends_": ends & ~opens})
    rows = rows.withColumn("text_", F.when(F.col("opens_"), strip(F.col(line))).otherwise(F.col(line)))
    each = rows.groupBy(log, "batch_", "gen_").agg(F.bool_or("opens_").alias("is_gen_"), F.min("line_no").alias("at_"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("ends_"), F.struct("line_no", "text_")))), lambda x: x["text_"]), "\n").alias("text")).filter("is_gen_")
    last = each.withColumn("top_", F.max("batch_").over(Window.partitionBy(log))).filter("batch_ = top_")
    return last.select(log, F.row_number().over(Window.partitionBy(log).orderBy("at_")).alias("n"), "text")


def summary(values: DataFrame, log: str = "log") -> DataFrame:
    """First and last value of each series, by the order of its lines."""
    return values.groupBy(log, "series", "name").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "line_no").alias("first_value"), F.max_by("value", "line_no").alias("last_value"), F.max("step").alias("last_step"))


def report(values: DataFrame, log: str = "log") -> DataFrame:
    """A Markdown line for each series of the summary."""
    s = summary(values, log)
    return s.select(log, F.concat(F.lit("| "), "series", F.lit(" | "), "name", F.lit(" | "), metric_text(F.col("name"), F.col("first_value")), F.lit(" | "), metric_text(F.col("name"), F.col("last_value")), F.lit(" |")).alias("line"))


def phase_report(lines: DataFrame, phase: str = "phase", log: str = "log") -> DataFrame:
    """log, phase, place, line: a Markdown report of each log by its phase, one of PHASES. A heading, the time that the
    training took if the log says so, a table of the first and last values of the phase's series in their order, and
    the last generations. Logs of other phases have no report."""
    known = lines.filter(F.col(phase).isin(*PHASES))
    order = F.create_map(*[x for name, series in PHASES.items() for x in (F.lit(name), F.array(*map(F.lit, series)))])
    of = known.select(F.col(log).alias("log_"), F.col(phase).alias("phase_")).distinct()
    met = lambda df: df.join(of, F.col(log).eqNullSafe(F.col("log_"))).drop("log_").withColumnRenamed("phase_", "phase")
    row = lambda part, at, sub, text: (F.col(log), F.col("phase"), F.lit(part).alias("part_"), at.alias("at_"), sub.alias("sub_"), text.alias("line"))
    zero, none = F.lit(0), F.lit("")
    head = of.select(F.col("log_").alias(log), F.col("phase_").alias("phase")).select(*row(0, zero, none, F.concat(F.lit("## "), F.col("phase"))))
    time = met(scalars(known, log)).filter("training_minutes is not null").select(*row(1, zero, none, F.format_string("Training took %.2f minutes.", "training_minutes")))
    title = head.select(*row(2, zero, none, F.lit("| series | name | first | last |")))
    rule = head.select(*row(2, F.lit(1), none, F.lit("|-|-|-|-|")))
    s = met(summary(metrics(known, log=log), log)).withColumn("in_", F.array_position(F.element_at(order, F.col("phase")), F.col("series"))).filter("in_ > 0")
    name = F.col("name")
    told = F.concat(F.lit("| "), "series", F.lit(" | "), "name", F.lit(" | "), metric_text(name, F.col("first_value")), F.lit(" | "), metric_text(name, F.col("last_value")), F.lit(" |"))
    values = s.select(*row(3, F.col("in_").cast("int"), name, told))
    shown = met(generations(known, log)).select(*row(4, F.col("n").cast("int"), none, F.concat(F.lit("> "), F.regexp_replace("text", "\n", "\n> "))))
    every = head.unionByName(time).unionByName(title).unionByName(rule).unionByName(values).unionByName(shown)
    w = Window.partitionBy(log).orderBy("part_", "at_", "sub_")  # the lines of one report
    return every.select(log, "phase", F.row_number().over(w).alias("place"), "line")


def parse_eval_csv(lines: DataFrame, line: str = "line") -> DataFrame:
    """task, accuracy, centered of the three-field rows but the header; empty fields are null."""
    part = F.transform(F.split(line, ",", -1), strip)
    rows = lines.withColumn("p_", part).filter((F.size("p_") == 3) & (F.get("p_", F.lit(0)) != "Task"))
    number = lambda i: F.nullif(F.get("p_", F.lit(i)), F.lit("")).cast("double")
    return rows.select(F.get("p_", F.lit(0)).alias("task"), number(1).alias("accuracy"), number(2).alias("centered"))


def parse_eval_bpb(lines: DataFrame, log: str = "log", line: str = "line") -> DataFrame:
    """log and the three figures of its first line of bits per byte; a log without one has no row."""
    pattern = SERIES["base_bpb"][0].replace(r"^\t", "^")
    first = lines.filter(F.col(line).rlike(pattern)).groupBy(log).agg(F.min_by(line, "line_no").alias("l_"))
    return first.select(log, *[F.regexp_extract("l_", pattern, i + 1).cast("double").alias(n) for i, n in enumerate(SERIES["base_bpb"][1])])


def format_eval_bpb(bpb: dict[str, Column]) -> list[Column]:
    """Padded footer lines of an evaluation: each figure under the accuracies."""
    return [F.concat_ws(", ", F.format_string("%-35s", F.lit(n)), F.format_string("%-10s", F.format_string("%.6f", v.cast("double"))), F.format_string("%-10s", F.lit(""))) for n, v in bpb.items()]


def format_eval_csv(scores: DataFrame) -> DataFrame:
    """Padded lines of task scores, and a footer with their mean."""
    cell = lambda v: F.format_string("%-10s", F.format_string("%.6f", v))
    rows = scores.select(F.lit(1).alias("part"), F.concat_ws(", ", F.format_string("%-35s", "task"), cell(F.col("accuracy")), cell(F.col("centered"))).alias("line"))
    foot = scores.agg(F.avg("centered").alias("c")).select(F.lit(2).alias("part"), F.concat_ws(", ", F.format_string("%-35s", F.lit("CORE")), F.format_string("%-10s", F.lit("")), cell(F.col("c"))).alias("line"))
    head = scores.sparkSession.range(1).select(F.lit(0).alias("part"), F.concat_ws(", ", F.format_string("%-35s", F.lit("Task")), F.format_string("%-10s", F.lit("Accuracy")), F.format_string("%-10s", F.lit("Centered"))).alias("line"))
    return head.unionByName(rows).unionByName(foot)
