"""String functions over columns: code fences, line numbers, language share, tool calls, prompts.

Patterns run with Unicode character classes, so that \\s and \\w mean what they mean for Unicode text.
Nulls give nulls unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator after a line number, the code fence, line starts that mark bare code, call marks.
ARROW = "→"
FENCE = r"```(?:python)?\s*\n(.*?)```"
BARE_STARTS = r"^(def |class |import |from |@)"
BARE_STARTS_WIDE = r"^(def |class |import |from |@|#\s*!|if __name__)"
TOOL_ARG, TOOL_VAL = "<|tool_arg|>", "<|tool_val|>"


# The characters that Unicode calls white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included; in time that grows with the text."""
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_numbers(code: Column) -> Column:
    """Each line after its number, right-aligned in five places, and an arrow."""
    return F.array_join(F.transform(lines(code), lambda x, i: F.concat(F.format_string("%5d", i + 1), F.lit(ARROW), x)), "\n")


def strip_line_numbers(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?m)^ *\d+{ARROW}", "")


def infer_filename(code: Column, fallback: Column) -> Column:
    """After the first function, else the first class in lower case, else solution_<fallback>."""
    function = F.nullif(F.regexp_extract(code, r"(?U)def\s+(\w+)\s*\(", 1), F.lit(""))
    kind = F.nullif(F.lower(F.regexp_extract(code, r"(?U)class\s+(\w+)", 1)), F.lit(""))
    return F.concat(F.coalesce(function, kind, F.concat(F.lit("solution_"), fallback.cast("string"))), F.lit(".py"))


def _fenced(text: Column, group: int) -> Column:
    """Part 1, 2 or 3 of the text around and in its first fence; null without one."""
    pattern = rf"(?sU)^(.*?){FENCE}(.*)$"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, group)))


def _bare(text: Column, starts: str) -> tuple[Column, Column]:
    """(before, code) where the first line that starts like code opens it; both null without one."""
    every = lines(text)
    hits = F.filter(F.transform(every, lambda x, i: F.when(strip(x).rlike(starts), i + 1)), lambda i: i.isNotNull())
    at = F.try_element_at(hits, F.lit(1))
    part = lambda lo, n: strip(F.array_join(F.slice(every, lo, n), "\n"))
    return F.when(at.isNotNull(), part(F.lit(1), at - 1)), F.when(at.isNotNull(), part(at, F.size(every)))


def _struct(before: Column, code: Column, after: Column) -> Column:
    return F.struct(before.alias("before"), code.alias("code"), after.alias("after"))


def extract_chat_code(text: Column) -> Column:
    """(before, code, after) of an answer: its first fence, else bare code; prose in lower case; all empty without code."""
    before, code = _bare(text, BARE_STARTS)
    empty = F.lit("")
    fenced = _fenced(text, 2)
    return F.when(fenced.isNotNull(), _struct(F.lower(_fenced(text, 1)), fenced, F.lower(_fenced(text, 3)))).otherwise(_struct(F.coalesce(F.lower(before), empty), F.coalesce(code, empty), empty))


def extract_pair_code(text: Column) -> Column:
    """(before, code, after) around the first fence; null without one."""
    return F.when(_fenced(text, 2).isNotNull(), _struct(_fenced(text, 1), _fenced(text, 2), _fenced(text, 3)))


def extract_field_code(text: Column, allow_bare: bool = False) -> Column:
    """(prose, code): the first fence and the text without all fences; bare code if allowed; else the text and ''."""
    two = lambda p, c: F.struct(p.alias("prose"), c.alias("code"))
    fenced = _fenced(text, 2)
    other = two(text, F.lit(""))
    if allow_bare:
        before, code = _bare(text, BARE_STARTS_WIDE)
        other = F.when(code.isNotNull(), two(before, code)).otherwise(other)
    return F.when(fenced.isNotNull(), two(strip(F.regexp_replace(text, r"(?sU)```(?:python)?\s*\n.*?```", "")), fenced)).otherwise(other)


def fenced_blocks(text: Column) -> Column:
    """All fenced blocks that are not blank."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?sU){FENCE}"), F.lit(1)), strip), lambda x: x != "")


def ascii_share(text: Column) -> Column:
    """Share of ASCII characters in the prose, code fences left out; 1 if there is no prose."""
    prose = strip(F.regexp_replace(text, r"(?sU)```(?:python)?\s*\n.*?```", ""))
    return F.when(prose == "", F.lit(1.0)).otherwise(F.length(F.regexp_replace(prose, r"[^\x00-\x7F]+", "")) / F.length(prose))


def is_english(text: Column, threshold: float = 0.85) -> Column:
    return ascii_share(text) >= threshold


def definitions(code: Column) -> Column:
    """(keyword, name) of each function or class that starts a line."""
    found = F.regexp_extract_all(code, F.lit(r"(?mU)^(?:def|class)\s+\w+"), F.lit(0))
    return F.transform(found, lambda d: F.struct(F.regexp_extract(d, r"(?U)^(\w+)", 1).alias("keyword"), F.regexp_extract(d, r"(?U)(\w+)$", 1).alias("name")))


def grep_target(code: Column) -> Column:
    """The first definition that is no __init__; null without one."""
    return F.try_element_at(F.filter(definitions(code), lambda d: d["name"] != "__init__"), F.lit(1))


def grep_result(target: Column, filename: Column, code: Column, seed: Column) -> Column:
    """filename:line:text from the target's line through 2 to 5 lines of context, as many as seed says; '' if not found."""
    every = lines(code)
    numbered = F.transform(every, lambda x, i: F.struct((i + 1).alias("at"), x.alias("line")))
    opens = lambda x: F.regexp_extract(x, r"(?U)^(?:def|class)\s+(\w+)\b", 1)
    first = F.try_element_at(F.filter(numbered, lambda x: (opens(x["line"]) == target["name"]) & F.startswith(x["line"], target["keyword"])), F.lit(1))["at"]
    context = 2 + F.pmod(F.xxhash64(seed), F.least(F.lit(4), F.greatest(F.lit(1), F.size(every) - first - 1)))
    shown = F.slice(numbered, first, (context + 1).cast("int"))
    return F.when(first.isNotNull(), F.array_join(F.transform(shown, lambda x: F.concat(filename, F.lit(":"), x["at"].cast("string"), F.lit(":"), x["line"])), "\n")).otherwise(F.lit(""))


def clean_answer(text: Column) -> Column:
    """A model's answer without its thinking and without the fence around it."""
    c = F.regexp_replace(text, r"(?sU)<think>.*?</think>\s*", "")
    c = F.regexp_replace(strip(c), r"(?U)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(c, r"(?U)\s*```$", ""))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b\[[0-9;]*m", "")


def count_substring(text: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("bigint")


def parse_tool_call(text: Column) -> Column:
    """(name, args: array of (arg, val, int_val)) of a call written with its marks."""
    parts = F.split(text, F.lit(r"\Q" + TOOL_ARG + r"\E"), -1)

    def arg(p: Column) -> Column:
        two = F.split(p, F.lit(r"\Q" + TOOL_VAL + r"\E"), 2)
        val = strip(F.coalesce(F.try_element_at(two, F.lit(2)), F.lit("")))
        return F.struct(strip(two[0]).alias("arg"), val.alias("val"), F.when(val.rlike(r"^-?\d+$"), val.try_cast("bigint")).alias("int_val"))

    return F.struct(strip(parts[0]).alias("name"), F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), arg).alias("args"))


def render_choices(question: Column, letters: Column, choices: Column) -> Column:
    """A multiple choice question with one line for each choice and its letter."""
    rows = F.array_join(F.transform(F.arrays_zip(letters.alias("l"), choices.alias("c")), lambda x: F.concat(F.lit("- "), x["c"], F.lit("="), x["l"], F.lit("\n"))), "")
    return F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), rows, F.lit("\nRespond only with the letter of the correct answer."))


def render_restyle(messages: Column) -> Column:
    """A conversation as plain lines; tool results are shown to 200 characters, arguments to 100."""

    def line(m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        clipped = F.concat(F.substring(content, 1, 200), F.when(F.length(content) > 200, F.lit("...")).otherwise(F.lit("")))
        args = F.to_json(F.map_from_entries(m["tool_call"]["args"]))
        call = F.when(m["tool_call"].isNotNull(), F.concat(F.lit(" (tool_call: "), m["tool_call"]["name"], F.lit("("), F.substring(args, 1, 100), F.lit("))"))).otherwise(F.lit(""))
        return (
            F.when(m["role"] == "user", F.concat(F.lit("[user]: "), content))
            .when(m["role"] == "tool_result", F.concat(F.lit("[tool_result]: "), clipped))
            .when(m["role"] == "assistant", F.concat(F.lit('[assistant]: "'), content, F.lit('"'), call))
        )

    return F.array_join(F.filter(F.transform(messages, line), lambda x: x.isNotNull()), "\n")


def metric_text(name: Column, value: Column) -> Column:
    """Whole numbers for throughput, four places for the rest."""
    return F.when(name == "tkps", value.cast("bigint").cast("string")).otherwise(F.format_string("%.4f", value.cast("double")))


def shard_name(index: Column) -> Column:
    return F.format_string("shard_%05d.parquet", index.cast("int"))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)
