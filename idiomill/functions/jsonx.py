"""JSON that models return: fenced, embedded, or broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, strip

# The fields of a cultural analysis.
LISTS = ("english_primary_meanings", "chinese_primary_meanings", "shared_meanings", "english_unique_aspects", "chinese_unique_aspects")
ANALYSIS = ", ".join(f"{n} array<string>" for n in LISTS) + ", cultural_explanation string, summary string"


def fenced(c) -> Column:
    """The text inside a json fence; without one, the text without fences."""
    c = _col(c)
    inside = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(strip(F.regexp_replace(F.regexp_replace(c, r"```\w*\s*", ""), "```", "")))


def fenced_object(c) -> Column:
    """The object inside a fence, with or without the json tag; without one, the text."""
    c = _col(c)
    inside = F.regexp_extract(c, r"```(?:json)?\s*(\{[^`]+\})\s*```", 1)
    return F.when(inside != "", inside).otherwise(strip(c))


def is_json(c) -> Column:
    return F.try_parse_json(_col(c)).isNotNull()


def parse(c, schema: str) -> Column:
    """A struct of JSON text, fenced or not; null if it is no JSON."""
    text = fenced(c)
    return F.when(is_json(text), F.from_json(text, schema))


def question_answer(c) -> Column:
    """(input, output) of a model's answer; null unless both are there."""
    got = parse(c, "input string, output string")
    return F.when(got["input"].isNotNull() & got["output"].isNotNull(), got)


def string_list(c, fallback) -> Column:
    """An array out of a model's answer: the answer, the first [...] in it, or [fallback]."""
    c = strip(_col(c))

    def read(text):
        return F.when(is_json(text) & text.startswith("["), F.from_json(text, "array<string>"))

    salvaged = F.regexp_extract(c, r"(?s)\[(.*?)\]", 0)
    return F.coalesce(read(c), read(F.when(salvaged != "", salvaged)), F.array(_col(fallback)))


def picked(c, candidates) -> Column:
    """The candidates that a list of 1-based numbers names, in its order.

    Numbers out of range and entries that are not whole numbers are left out, another
    JSON value picks nothing, and what is no JSON keeps all. A single candidate is kept.
    """
    c, candidates = fenced(c), _col(candidates)
    entries = F.from_json(c, "array<string>")
    numbers = F.filter(F.transform(entries, lambda x: F.when(x.rlike(r"^-?\d{1,9}$"), x.try_cast("int"))), lambda i: i.isNotNull())
    inside = F.filter(numbers, lambda i: (i >= 1) & (i <= F.size(candidates)))
    named = F.transform(inside, lambda i: F.element_at(candidates, i))
    none = F.slice(candidates, 1, 0)
    return (
        F.when(F.size(candidates) <= 1, candidates)
        .when(~is_json(c), candidates)
        .when(c.startswith("["), F.coalesce(named, none))
        .otherwise(none)
    )


def error_payload(message) -> Column:
    return F.to_json(F.struct(_col(message).alias("error")))


def strings(c, keep_empty: bool = False) -> Column:
    """A JSON array of strings or of arrays of strings (to two levels), flat.

    Elements are trimmed and empty ones dropped, unless keep_empty.
    """
    outer = F.from_json(_col(c), "array<string>")
    flat = F.flatten(
        F.transform(
            outer, lambda x: F.when(x.startswith("[") & is_json(x), F.from_json(x, "array<string>")).otherwise(F.array(x))
        )
    )
    present = F.filter(flat, lambda x: x.isNotNull())
    return present if keep_empty else F.filter(F.transform(present, strip), lambda x: x != "")


def says_yes(c) -> Column:
    """A model's YES; everything else, an error too, is no."""
    return F.coalesce(F.upper(strip(c)).contains("YES"), F.lit(False))
