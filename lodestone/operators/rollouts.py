"""Editing rollouts from instruction tables, preference pairs from recorded attempts, and their filters."""

from __future__ import annotations

import ast
import difflib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as S
from lodestone.operators import conversations as C


@F.pandas_udf(T.BooleanType())
def parses(code: pd.Series) -> pd.Series:
    """Whether a text is Python, by this interpreter's grammar. A null is not."""

    def one(c: str | None) -> bool:
        if c is None:
            return False
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore", SyntaxWarning)
                ast.parse(c)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True

    return code.map(one).astype(bool)


def edit_pair(original: str, modified: str, compat: bool = True, most: float = 0.8, context: int = 2, tries: int = 7) -> tuple[str | None, str]:
    """The smallest (old, new) pair of line ranges around all changes whose old text occurs once; (None,
    modified) if too much changed, nothing did, or no range is unique.

    compat counts unchanged lines by the end offsets of equal ranges in the modified text, which is
    usually too many, so that few edits count as too large; otherwise by their lengths.
    """
    old, new = original.split("\n"), modified.split("\n")
    *kept, end = difflib.SequenceMatcher(None, old, new).get_matching_blocks()
    same = sum(k.b + k.size if compat else k.size for k in kept)
    if old == new or len(old) - same > most * len(old):
        return None, modified
    # what changed lies between the lines that both texts begin with and those that both end with
    head = kept[0].size if kept and kept[0].a == kept[0].b == 0 else 0
    foot = kept[-1].size if kept and (kept[-1].a + kept[-1].size, kept[-1].b + kept[-1].size) == (end.a, end.b) else 0
    around = lambda text, wide: "\n".join(text[max(0, head - wide) : len(text) - foot + wide])
    unique = (wide for wide in range(context, context + tries) if original.count(around(old, wide)) == 1)
    wide = next(unique, None)
    return (None, modified) if wide is None else (around(old, wide), around(new, wide))


@F.pandas_udf(T.StructType([T.StructField("old_string", T.StringType()), T.StructField("new_string", T.StringType())]))
def compute_edit(original: pd.Series, modified: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([edit_pair(o or "", m or "") for o, m in zip(original, modified, strict=True)], columns=["old_string", "new_string"])


def _edit_messages(user: Column, before: Column, code: Column, after: Column, filename: Column, arguments: Column) -> Column:
    return F.array(C.message("user", user), C.message("assistant", before, F.lit("Edit"), arguments), C.message("tool_result", S.line_numbers(code)), C.message("assistant", after))


def _rollouts(df: DataFrame, source: str, extracted: Column) -> DataFrame:
    """Rollouts that write a file: user, edit, result, answer. df has _source_idx, user and answer."""
    rows = df.withColumn("x", extracted).filter(F.col("x").isNotNull() & (F.coalesce(F.col("x.code"), F.lit("")) != ""))
    rows = rows.withColumn("code", S.strip(F.col("x.code")))
    # cheap gates come before the parser
    rows = rows.filter((F.length("code") >= 20) & (F.size(S.lines(F.col("code"))) <= 200)).filter(parses("code"))
    name = S.infer_filename(F.col("code"), F.col("_source_idx"))
    messages = _edit_messages(F.col("user"), F.col("x.before"), F.col("code"), F.col("x.after"), name, C.args(file_path=name, new_string=F.col("code")))
    return rows.select(messages.alias("messages"), F.lit("").alias("_original_code"), F.lit(source).alias("_source"), F.col("_source_idx").cast("bigint").alias("_source_idx"))


def from_chats(df: DataFrame, source: str) -> DataFrame:
    """Of (_source_idx, messages): the last user message and the code of the last answer, fenced or bare."""
    rows = df.select("_source_idx", C.last_of(F.col("messages"), "user").alias("user"), C.last_of(F.col("messages"), "assistant").alias("answer"))
    return _rollouts(rows.filter("user <> '' and answer <> ''"), source, S.extract_chat_code(F.col("answer")))


def from_pairs(df: DataFrame, source: str, instruction: str = "instruction", response: str = "response") -> DataFrame:
    """Of (_source_idx, instruction, response): the fenced code of the response."""
    rows = df.select("_source_idx", F.col(instruction).alias("user"), F.col(response).alias("answer"))
    return _rollouts(rows.filter("user <> '' and answer <> ''"), source, S.extract_pair_code(F.col("answer")))


def evolved(df: DataFrame, instruction: str = "instruction", output: str = "output") -> DataFrame:
    """df with outcome, code_in, code_out: what an evolved instruction asks for and whether it can be built.

    Several fenced blocks of the output are one text if that parses, else the first counts. Outcomes:
    empty, not_english, no_code_out, not_python_out, identical, build_fail, code_both, code_out_only.
    """
    fine = lambda c: F.coalesce(F.length(S.strip(c)) >= 10, F.lit(False)) & parses(c)
    rows = df.withColumns({"blocks": S.fenced_blocks(F.col(output)), "code_in": S.extract_field_code(F.col(instruction))["code"]})
    rows = rows.withColumn("joined", F.array_join("blocks", "\n\n"))
    rows = rows.withColumn("joined_fine", fine(F.col("joined")))
    bare = S.extract_field_code(F.col(output), allow_bare=True)["code"]
    rows = rows.withColumn("code_out", F.when(F.size("blocks") == 0, bare).when((F.size("blocks") == 1) | ~F.col("joined_fine"), F.get("blocks", F.lit(0))).otherwise(F.col("joined")))
    rows = rows.withColumns({"in_fine": fine(F.col("code_in")), "out_fine": fine(F.col("code_out"))})
    rows = rows.withColumns({"code_in": S.strip(F.col("code_in")), "code_out": S.strip(F.col("code_out"))})
    fits = lambda c: (F.length(c) >= 20) & (F.size(S.lines(F.col(c))) <= 200)
    outcome = (
        F.when((F.coalesce(F.col(instruction), F.lit("")) == "") | (F.coalesce(F.col(output), F.lit("")) == ""), "empty")
        .when(~S.is_english(F.col(instruction)), "not_english")
        .when(F.coalesce(F.col("code_out"), F.lit("")) == "", "no_code_out")
        .when(~F.col("out_fine"), "not_python_out")
        .when(F.col("in_fine") & (F.col("code_in") == F.col("code_out")), "identical")
        .when(F.col("in_fine") & ~(fits("code_in") & fits("code_out")), "build_fail")
        .when(F.col("in_fine"), "code_both")
        .when(fits("code_out"), "code_out_only")
        .otherwise("build_fail")
    )
    return rows.withColumn("outcome", outcome).drop("blocks", "joined", "joined_fine", "in_fine", "out_fine")


def from_evolved(df: DataFrame, source: str, instruction: str = "instruction", output: str = "output") -> DataFrame:
    """Rollouts of evolved(): edits of the code in the instruction, or new files."""
    rows = evolved(df, instruction, output).filter(F.col("outcome").isin("code_both", "code_out_only"))
    both = F.col("outcome") == "code_both"
    rows = rows.withColumn("edit", compute_edit(F.when(both, F.col("code_in")).otherwise(F.lit("")), F.col("code_out")))
    name = S.infer_filename(F.when(both, F.col("code_in")).otherwise(F.col("code_out")), F.col("_source_idx"))
    new = C.args(file_path=name, new_string=F.when(both, F.col("edit.new_string")).otherwise(F.col("code_out")))
    old = F.when(both & F.col("edit.old_string").isNotNull(), C.args(old_string=F.col("edit.old_string"))).otherwise(F.array().cast(C.ARGS))
    messages = _edit_messages(F.col(instruction), F.lit(""), F.col("code_out"), F.lit(""), name, F.concat(new, old))
    return rows.select(messages.alias("messages"), F.when(both, F.col("code_in")).otherwise(F.lit("")).alias("_original_code"), F.lit(source).alias("_source"), F.col("_source_idx").cast("bigint").alias("_source_idx"))


def add_search_steps(messages: Column, original: Column, seed: Column) -> Column:
    """A search and a read of the original code before the first edit; unchanged without original or edit."""
    edits = F.filter(F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & (m["tool_call"]["name"] == "Edit"), i + 1)), lambda i: i.isNotNull())
    at = F.try_element_at(edits, F.lit(1))
    name = F.coalesce(C.argument(F.get(messages, at - 1)["tool_call"], "file_path"), F.lit(""))
    target = S.grep_target(original)
    found = S.grep_result(target, name, original, seed)
    grep = F.array(C.message("assistant", F.lit(""), F.lit("Grep"), C.args(pattern=F.concat(target["keyword"], F.lit(" "), target["name"]), path=F.lit("."))), C.message("tool_result", found))
    read = F.array(C.message("assistant", F.lit(""), F.lit("Read"), C.args(file_path=name)), C.message("tool_result", S.line_numbers(original)))
    steps = F.when(target.isNotNull() & (F.coalesce(found, F.lit("")) != ""), F.concat(grep, read)).otherwise(read)
    more = F.concat(F.slice(messages, F.lit(1), at - 1), steps, F.slice(messages, at, F.size(messages)))
    return F.when(at.isNotNull() & (F.coalesce(original, F.lit("")) != ""), more).otherwise(messages)


def outcomes(rollouts: DataFrame, n_tokens: Column | None = None, most: int = 4096) -> DataFrame:
    """rollouts with outcome: invalid, tokenizer_failure (null length), too_long or valid, in that order."""
    n = F.lit(0) if n_tokens is None else n_tokens
    return rollouts.withColumn("outcome", F.when(F.size(C.short_problems(F.col("messages"))) > 0, "invalid").when(n.isNull(), "tokenizer_failure").when(n > most, "too_long").otherwise("valid"))


def not_done(rollouts: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("_source", "_source_idx")) -> DataFrame:
    """Rollouts whose keys are not among those done; null keys equal null keys."""
    seen = done.select(*[F.col(k).alias(k + "_done") for k in keys]).distinct()
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(k + "_done"))
        on = c if on is None else on & c
    return rollouts.join(seen, on, "left_anti")


def resolve_attempts(attempts: DataFrame, key: str = "id", attempt: str = "attempt", passed: str = "passed", kind: str = "kind") -> DataFrame:
    """Of recorded attempts: the first that passed is chosen, the first that failed for another reason than
    tokenization before it is rejected; attempts counts those made until then."""
    first = F.min(F.when(F.col(passed), F.col(attempt)))
    w = Window.partitionBy(key)
    rows = attempts.withColumn("chosen_at", first.over(w)).filter(F.col("chosen_at").isNull() | (F.col(attempt) <= F.col("chosen_at")))
    failed = ~F.coalesce(F.col(passed), F.lit(False)) & ~F.col(kind).eqNullSafe(F.lit("tokenization"))
    return rows.groupBy(key).agg(F.first("chosen_at").alias("chosen_at"), F.min(F.when(failed, F.col(attempt))).alias("rejected_at"), F.count(F.lit(1)).alias("attempts"), F.max_by(kind, F.when(~F.coalesce(F.col(passed), F.lit(False)), F.col(attempt))).alias("last_failure"))


def with_model(df: DataFrame, call, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """df with the answers of a callable from a list of prompts to a list of answers, batch by batch."""
    schema = df.withColumn(answer, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{answer: call(b[prompt].tolist())})

    return df.mapInPandas(run, schema)
