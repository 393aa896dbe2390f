"""Conversations: schemas, edits, and the validation rules as arrays of problems.

A message is (role, content, tool_call), a call (name, args), args an ordered array of (arg, val): the
order of arguments has a meaning that maps lose. An absent and a null call are both null here. The texts
of the problems that the rules report are fixed values, which counts and reports of them rely on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import ARROW, lines, strip

ARGS = "array<struct<arg:string,val:string>>"
MESSAGE = f"struct<role:string,content:string,tool_call:struct<name:string,args:{ARGS}>>"
MESSAGES = f"array<{MESSAGE}>"
#: As JSON has it: the arguments are an object.
RAW_MESSAGES = "array<struct<role:string,content:string,tool_call:struct<name:string,args:map<string,string>>>>"


def ordered(messages: Column) -> Column:
    """Messages as parsed from JSON with the arguments of calls as ordered arrays."""
    call = lambda c: F.when(c.isNotNull(), F.struct(c["name"].alias("name"), F.coalesce(F.transform(F.map_entries(c["args"]), lambda e: F.struct(e["key"].alias("arg"), e["value"].alias("val"))), F.array().cast(ARGS)).alias("args")))
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), call(m["tool_call"]).alias("tool_call")))


def message(role: Column | str, content: Column, name: Column | None = None, args: Column | None = None) -> Column:
    """A message; with a name, one that calls a tool."""
    role = F.lit(role) if isinstance(role, str) else role
    call = F.lit(None) if name is None else F.struct(name.alias("name"), args.alias("args"))
    return F.struct(role.alias("role"), content.alias("content"), call.cast(f"struct<name:string,args:{ARGS}>").alias("tool_call")).cast(MESSAGE)


def args(**values: Column) -> Column:
    """Call arguments in the order given."""
    return F.array(*[F.struct(F.lit(k).alias("arg"), v.cast("string").alias("val")) for k, v in values.items()])


def argument(call: Column, name: str) -> Column:
    """Value of an argument; null if there is none."""
    return F.try_element_at(F.filter(call["args"], lambda a: a["arg"] == name), F.lit(1))["val"]


def assemble(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation, from one for each message."""
    each = F.struct(F.col(turn).alias("turn"), message(F.col(role), F.col(text)).alias("m"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["m"]).alias("messages"))


def prepend_system(messages: Column, prompt: str) -> Column:
    return F.concat(F.array(message("system", F.lit(prompt))), messages)


def merge_system(messages: Column) -> Column:
    """A first system message joined to the user message after it; an error if another role follows."""
    first, second = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    ok = F.assert_true(second["role"].eqNullSafe(F.lit("user")), F.lit("a system message must be followed by a user message"))
    merged = message("user", F.concat(first["content"], F.lit("\n\n"), second["content"]))
    body = F.concat(F.array(merged), F.slice(messages, F.lit(3), F.greatest(F.size(messages), F.lit(1))))
    return F.when(first["role"] == "system", F.when(ok.isNull(), body)).otherwise(messages)


def without_last_answer(messages: Column) -> Column:
    """All but the last message, which must be an assistant's."""
    last = F.try_element_at(messages, F.lit(-1))["role"]
    return F.when(F.assert_true(last.eqNullSafe(F.lit("assistant")), F.lit("the last message must be an assistant's")).isNull(), F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0))))


def last_of(messages: Column, role: str) -> Column:
    """Content of the last message of a role; null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"]


def has_answer(messages: Column) -> Column:
    return F.exists(messages, lambda m: (m["role"] == "assistant") & (F.coalesce(m["content"], F.lit("")) != ""))


def assistant_places(messages: Column) -> Column:
    """0-based places of the assistant's messages."""
    return F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())


def replace_answers(messages: Column, contents: Column) -> Column:
    """The assistant's contents replaced in their order; the rest stays."""
    place = assistant_places(messages)
    return F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", m.withField("content", F.get(contents, (F.array_position(place, i) - 1).cast("int")))).otherwise(m))


def _problem(when: Column, text: Column | str) -> Column:
    """An array of one problem, or of none."""
    return F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(F.array().cast("array<string>"))


def _each(messages: Column, of) -> Column:
    """Problems of every message: of(message, place)."""
    return F.flatten(F.transform(messages, of))


def _at(messages: Column, i: Column) -> Column:
    return F.get(messages, i)


def _prefix(line: Column) -> Column:
    """Length of a line's number with its padding; 0 without."""
    return F.length(F.regexp_extract(line, rf"^( *\d+){ARROW}", 1))


def short_problems(messages: Column) -> Column:
    """Problems of a short editing rollout."""
    n = F.size(messages)

    def follow(m: Column, i: Column) -> Column:
        called = m["tool_call"].isNotNull()
        after = _at(messages, i + 1)["role"]
        wrong = F.filter(F.transform(lines(F.coalesce(m["content"], F.lit(""))), _prefix), lambda k: (k > 0) & (k != 5))
        edit = (m["role"] == "assistant") & (m["tool_call"]["name"] == "Edit")
        return F.concat(
            _problem(called & (i + 1 >= n), "tool_call at end without tool_result"),
            _problem(called & (i + 1 < n) & ~after.eqNullSafe(F.lit("tool_result")), "tool_call not followed by tool_result"),
            _problem((m["role"] == "tool_result") & (F.size(wrong) > 0), F.concat(F.lit("line prefix wrong length: "), F.get(wrong, F.lit(0)).cast("string"))),
            _problem(edit & F.contains(argument(m["tool_call"], "old_string"), F.lit(ARROW)), "Edit old_string contains line numbers"),
            _problem(edit & F.contains(argument(m["tool_call"], "new_string"), F.lit(ARROW)), "Edit new_string contains line numbers"),
        )

    rest = F.concat(_problem(~_at(messages, F.lit(0))["role"].eqNullSafe(F.lit("user")), "first message not from user"), _each(messages, follow))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.array(F.lit("no messages"))).otherwise(rest)


def line_problems(content: Column) -> Column:
    """Problems of numbered lines: widths, malformed lines, numbers that do not rise."""
    every = lines(content)
    # How lines with an arrow may start that are not numbered.
    others = r"^(src/|\./|error:|rejected:|no )"
    numbered = lambda x: x.rlike(rf"^ *\d+{ARROW}")

    def width(x: Column) -> Column:
        bad = F.concat(F.lit("Line number prefix wrong length ("), _prefix(x).cast("string"), F.lit("): '"), F.substring(x, 1, 20), F.lit("'"))
        odd = F.concat(F.lit(f"Malformed line with {ARROW}: '"), F.substring(x, 1, 30), F.lit("'"))
        return F.concat(_problem(numbered(x) & (_prefix(x) != 5), bad), _problem(F.contains(x, F.lit(ARROW)) & ~numbered(x) & ~strip(x).rlike(others), odd))

    numbers = F.transform(F.filter(every, numbered), lambda x: F.regexp_extract(x, rf"^ *(\d+){ARROW}", 1).cast("decimal(38,0)"))

    def rise(x: Column, i: Column) -> Column:
        before = F.get(numbers, i - 1)
        return _problem((i > 0) & (x <= before), F.concat(F.lit("Line numbers not sequential: "), before.cast("string"), F.lit(" -> "), x.cast("string")))

    return F.when(F.contains(content, F.lit(ARROW)), F.concat(F.flatten(F.transform(every, width)), F.flatten(F.transform(numbers, rise)))).otherwise(F.array().cast("array<string>"))


# Phrases that solicit new work, anywhere and in the last answer; keys that a rollout may have;
# words of the format's own description.
BANNED_ALWAYS = ("anything else", "let me know if")
BANNED_FINAL = ("would you like", "let me know if", "anything else")
KNOWN_KEYS = ("messages", "_scenario_id", "_scenario_prompt", "_generator_prompt")
LEAKS = ("4-space padded", "Read/Edit success", "EXACTLY")


def _says(content: Column, phrases: tuple[str, ...]) -> Column:
    return content.rlike("(?U)" + "|".join(p.replace(" ", r"\s+") for p in phrases))


def long_problems(messages: Column, keys: Column | None = None) -> Column:
    """Problems of a generated multi-tool rollout; keys are the names of its top-level fields.

    The message before the first is the last one, as the rule that looks back has it.
    """
    n = F.size(messages)
    content = lambda m: F.coalesce(m["content"], F.lit(""))
    is_result = lambda m: m["role"] == "tool_result"
    role_after = lambda i: _at(messages, i + 1)["role"]
    last_place = F.try_element_at(assistant_places(messages), F.lit(-1))

    def edits(m, i):
        return _problem((m["tool_call"]["name"] == "Edit") & F.contains(F.coalesce(argument(m["tool_call"], "old_string"), F.lit("")), F.lit(ARROW)), "Edit old_string contains line number formatting")

    def results(m, i):
        back = F.when(i == 0, F.try_element_at(messages, F.lit(-1))).otherwise(_at(messages, F.greatest(i - 1, F.lit(0))))
        rejected, error = F.startswith(content(m), F.lit("rejected")), F.startswith(content(m), F.lit("error:"))
        return F.concat(
            _problem(is_result(m) & ~back["role"].eqNullSafe(F.lit("assistant")) & back["tool_call"].isNull(), "Tool result must always be preceded by an assistant tool call."),
            _problem(is_result(m) & rejected & F.contains(content(m), F.lit(ARROW)), "Rejection tool_result contains file contents"),
            _problem(is_result(m) & rejected & (i + 1 >= n), "Rejection at end without user follow-up"),
            _problem(is_result(m) & rejected & (i + 1 < n) & ~role_after(i).eqNullSafe(F.lit("user")), "Rejection not followed by user message"),
            _problem(is_result(m) & ~rejected & error & (role_after(i) == "user"), "Error followed by user instead of assistant"),
            _problem(is_result(m) & ~rejected & ~error & (i + 1 < n) & ~role_after(i).eqNullSafe(F.lit("assistant")), "Success not followed by assistant"),
        )

    def users(m, i):
        return _problem((m["role"] == "user") & F.contains(F.lower(content(m)), F.lit("scenario:")), "User content contains 'scenario:'")

    def formats(m, i):
        leak = F.lit(False)
        for x in LEAKS:
            leak = leak | F.contains(content(m), F.lit(x))
        found = F.concat(_problem(leak, "Format description leaked into tool_result"), line_problems(content(m)))
        return F.when(is_result(m), found).otherwise(F.array().cast("array<string>"))

    def rejections(m, i):
        strict = is_result(m) & F.startswith(content(m), F.lit("rejected:"))
        got = F.concat(F.lit("Rejection not followed by user message (got "), F.coalesce(role_after(i), F.lit("None")), F.lit(")"))
        return F.concat(_problem(strict & (i + 1 >= n), "Rejection at end without user follow-up"), _problem(strict & (i + 1 < n) & ~role_after(i).eqNullSafe(F.lit("user")), got))

    def calls(m, i):
        got = F.concat(F.lit("tool_call not followed by tool_result (got "), F.coalesce(role_after(i), F.lit("None")), F.lit(")"))
        called = m["tool_call"].isNotNull()
        return F.concat(_problem(called & (i + 1 >= n), "tool_call at end without tool_result"), _problem(called & (i + 1 < n) & ~role_after(i).eqNullSafe(F.lit("tool_result")), got))

    made = F.transform(F.filter(messages, lambda m: m["tool_call"].isNotNull()), lambda m: F.to_json(m["tool_call"]))

    def stuck(c, i):
        return _problem((c == F.get(made, i + 1)) & (c == F.get(made, i + 2)), "Agent made same tool call 3+ times in a row")

    def arguments(m, i):
        edit = m["tool_call"]["name"] == "Edit"
        has = lambda k: F.exists(m["tool_call"]["args"], lambda a: a["arg"] == k)
        return F.concat(_problem(edit & has("pattern"), "Edit tool call contains invalid 'pattern' arg"), _problem(edit & ~has("new_string"), "Edit tool call missing required 'new_string'"))

    def phrases(m, i):
        said, answer, final = F.lower(content(m)), m["role"] == "assistant", i == last_place
        return F.concat(
            _problem(answer & _says(said, BANNED_ALWAYS), F.concat(F.lit("Assistant soliciting new work at turn "), i.cast("string"))),
            _problem(answer & final & F.contains(said, F.lit("?")), "Assistant asked question in final turn"),
            _problem(answer & final & _says(said, BANNED_FINAL), "Assistant offering follow-up in final turn"),
        )

    unknown = F.transform(F.filter(keys, lambda k: ~k.isin(*KNOWN_KEYS)), lambda k: F.concat(F.lit("Unexpected top-level key: "), k)) if keys is not None else F.array().cast("array<string>")
    found = F.concat(
        _each(messages, edits), unknown, _each(messages, results), _problem(~_at(messages, F.lit(0))["role"].eqNullSafe(F.lit("user")), "First message not from user"), _each(messages, users), _each(messages, formats), _each(messages, rejections), _each(messages, calls),
        F.flatten(F.transform(made, stuck)), _each(messages, arguments), _problem(last_place.isNull(), "No assistant message"), _each(messages, phrases),
    )
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.array(F.lit("No messages"))).otherwise(found)


def restyle_problems(original: Column, styled: Column) -> Column:
    """What a restyled conversation changed besides the assistant's words. Arguments compare without their order."""
    canonical = lambda c: F.to_json(F.struct(c["name"].alias("name"), F.array_sort(c["args"]).alias("args")))
    place = lambda i: F.concat(F.lit("Msg "), i.cast("string"))

    def compare(o: Column, i: Column) -> Column:
        s = _at(styled, i)
        changed = ~o["content"].eqNullSafe(s["content"])
        return F.concat(
            _problem(~o["role"].eqNullSafe(s["role"]), F.concat(place(i), F.lit(" role changed: "), o["role"], F.lit(" -> "), s["role"])),
            _problem((o["role"] == "tool_result") & changed, F.concat(place(i), F.lit(" tool_result content changed"))),
            _problem((o["role"] == "user") & changed, F.concat(place(i), F.lit(" user content changed"))),
            _problem(o["tool_call"].isNotNull() & ~canonical(o["tool_call"]).eqNullSafe(canonical(s["tool_call"])), F.concat(place(i), F.lit(" tool_call changed"))),
            _problem(o["tool_call"].isNull() & s["tool_call"].isNotNull(), F.concat(place(i), F.lit(" tool_call added"))),
        )

    counts = F.concat(F.lit("message count changed: "), F.size(original).cast("string"), F.lit(" -> "), F.size(styled).cast("string"))
    return F.when(F.size(original) != F.size(styled), F.array(counts)).otherwise(_each(original, compare))
