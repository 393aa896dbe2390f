"""Answers in JSON: tolerant shapes, defaults, and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def answer_contents(answer: Column, n_answers: Column) -> Column:
    """The new contents in a model's answer: a JSON string, an array of strings, or an object with them under
    assistant_contents. Text that is no JSON stands for itself if one content is wanted and it does not look
    like an array or object; else null."""
    v = F.try_parse_json(answer)
    kind = F.schema_of_variant(v)
    listed = F.try_variant_get(v, "$", "array<string>")
    inner = F.try_variant_get(v, "$.assistant_contents", "array<string>")
    bare = F.regexp_replace(F.regexp_replace(strip(answer), '^"+|"+$', ""), "^'+|'+$", "")
    alone = (n_answers == 1) & ~strip(answer).rlike(r"^[\[{]")
    parsed = F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), inner)
    return F.when(v.isNotNull(), parsed).when(alone, F.array(bare))


def field(json: Column, path: str, default: Column, kind: str = "string") -> Column:
    """A field of a JSON text, or the default where it is absent."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), path, kind), default)


def has_key(json: Column, key: str) -> Column:
    """Whether an object has a key, be it null: absent and null differ."""
    return F.coalesce(F.array_contains(F.json_object_keys(json), key), F.lit(False))


def dumps(value: Column) -> Column:
    """Compact JSON text; for comparing, as spacing is not part of the value."""
    return F.to_json(value)
