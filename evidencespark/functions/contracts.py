"""Strict JSON answers of a model as column expressions.

An answer is one object and nothing else, its keys are those of the contract, each at most once, and values are of the
contract's types. The grammar of such an object is a regular expression, so no parser is called for what is refused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of an assessment and of a rewrite.
MOST_FACTS, LONGEST_FACT, LONGEST_REASON = 5, 256, 64
MOST_QUERIES, LONGEST_QUERY = 2, 4096
#: JSON as patterns: white space, a string, and a list of strings.
_WS = r"[ \t\n\r]*"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_STRINGS = rf"\[{_WS}(?:(?:{_STRING}|null){_WS}(?:,{_WS}(?:{_STRING}|null){_WS})*)?\]"
_KINDS = {"boolean": "(?:true|false|null)", "string": f"(?:{_STRING}|null)", "array<string>": f"(?:{_STRINGS}|null)"}


def object_pattern(fields: dict[str, str]) -> str:
    """The pattern of an object with some of ``fields`` (name: type), in any order; repeated ones are not excluded by it."""
    pair = "(?:" + "|".join(rf'"{name}"{_WS}:{_WS}{_KINDS[kind]}' for name, kind in fields.items()) + ")"
    return rf"^\{{{_WS}(?:{pair}{_WS}(?:,{_WS}{pair}{_WS})*)?\}}$"


def strict_object(text: Column, fields: dict[str, str]) -> tuple[Column, Column]:
    """``error`` of an answer (null: none), and its value as a struct.

    ``NOT_AN_OBJECT`` if it does not begin and end as one, ``INVALID_JSON`` for bad JSON, other keys, repeated keys, other
    types and what follows the object, ``MISSING_FIELD`` if a field is absent or null. A null answer is not an object.
    """
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), r"\s+$", "")
    keys = F.coalesce(F.json_object_keys(plain), F.array().cast("array<string>"))
    value = F.from_json(plain, ", ".join(f"{name} {kind}" for name, kind in fields.items()))
    fits = plain.rlike(object_pattern(fields)) & (F.size(keys) == F.size(F.array_distinct(keys)))
    missing = F.lit(False)
    for name in fields:
        missing = missing | value[name].isNull()
    error = F.when(~(F.startswith(plain, F.lit("{")) & F.endswith(plain, F.lit("}"))), "NOT_AN_OBJECT").when(~fits, "INVALID_JSON").when(missing, "MISSING_FIELD")
    return error, value


def _blank(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")) == ""


def assessment(answer: Column) -> tuple[Column, Column, Column, Column]:
    """``error``, ``sufficient``, ``missing_facts`` and ``reason_code`` of an answer on whether the evidence is enough."""
    error, value = strict_object(answer, {"sufficient": "boolean", "missing_facts": "array<string>", "reason_code": "string"})
    reason = F.trim(F.regexp_replace(value["reason_code"], r"^\s+|\s+$", ""))
    facts = value["missing_facts"]
    error = F.coalesce(
        error,
        F.when(F.size(facts) > MOST_FACTS, "TOO_MANY_FACTS")
        .when(F.exists(facts, _blank), "EMPTY_FACT")
        .when(F.exists(facts, lambda x: F.length(x) > LONGEST_FACT), "FACT_TOO_LONG")
        .when((reason == "") | (F.octet_length(reason) > LONGEST_REASON), "BAD_REASON"),
    )
    ok = error.isNull()
    return error, F.when(ok, value["sufficient"]), F.when(ok, facts), F.when(ok, reason)


def rewrite(answer: Column, attempted: Column) -> tuple[Column, Column]:
    """``error`` and the new ``queries`` of an answer that rewrites a query; those already ``attempted`` (array) are no news."""
    error, value = strict_object(answer, {"queries": "array<string>"})
    spaced = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    queries = F.transform(value["queries"], lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", ""))
    folded = F.transform(queries, lambda x: F.lower(spaced(x)))
    done = F.transform(F.coalesce(attempted, F.array().cast("array<string>")), lambda x: F.lower(spaced(x)))
    new = F.filter(queries, lambda x, i: ~F.array_contains(done, F.lower(spaced(x))) & (F.array_position(folded, F.lower(spaced(x))) == i + 1))
    error = F.coalesce(
        error,
        F.when(F.size(queries) > MOST_QUERIES, "TOO_MANY_QUERIES")
        .when(F.exists(queries, _blank), "EMPTY_QUERY")
        .when(F.exists(queries, lambda x: F.length(x) > LONGEST_QUERY), "QUERY_TOO_LONG")
        .when(F.size(new) == 0, "NO_NEW_QUERY"),
    )
    return error, F.when(error.isNull(), new)
