"""Typed attributes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LIST_ITEMS, TIME_ATTRIBUTES, TITLE_ATTRIBUTES, plain_entity

SATURATED = str((1 << 64) - 1)


def text_of(attrs: Column, name: str) -> Column:
    """The attribute's text if it is a string, else null."""
    v = F.try_element_at(attrs, F.lit(name))
    return F.when(v["tag"] == "string", v["text"])


def first_text(attrs: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[text_of(attrs, n) for n in names])


def timestamp_of(attrs: Column) -> Column:
    return first_text(attrs, TIME_ATTRIBUTES)


def title_of(attrs: Column) -> Column:
    return first_text(attrs, TITLE_ATTRIBUTES)


def counter_of(attrs: Column, aliases: tuple[str, ...]) -> Column:
    """The first alias that is there, if it is an integer from 0 to 2**64 - 1."""
    there = reduce(lambda rest, n: F.when(F.map_contains_key(attrs, n), F.try_element_at(attrs, F.lit(n))).otherwise(rest), reversed(aliases), F.lit(None).cast("struct<tag:string,text:string>"))
    number = F.when(there["tag"] == "int", there["text"].try_cast("decimal(38,0)"))
    return F.when((number >= 0) & (number <= F.lit(SATURATED).cast("decimal(38,0)")), number)


def saturating_sum(number: Column) -> Column:
    """The sum, at most 2**64 - 1; null if nothing is counted."""
    return F.when(F.count(number) > 0, F.least(F.sum(number), F.lit(SATURATED).cast("decimal(38,0)")))


def quoted(text: Column) -> Column:
    """A text in double quotes, with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def format_value(v: Column) -> Column:
    """A value as reports show it; of a list, the first items and how many more there are."""
    items = F.from_json(v["text"], "array<string>")
    shown = F.concat_ws(", ", F.transform(F.slice(items, 1, LIST_ITEMS), quoted))
    more = F.when(F.size(items) > LIST_ITEMS, F.concat(F.lit(", … +"), (F.size(items) - LIST_ITEMS).cast("string"))).otherwise(F.lit(""))
    return (
        F.when(v["tag"] == "null", F.lit("null"))
        .when(v["tag"] == "string", quoted(v["text"]))
        .when(v["tag"] == "bytes", F.concat(F.lit("bytes["), (F.length(v["text"]) / 2).cast("int").cast("string"), F.lit("]")))
        .when(v["tag"] == "list", F.concat(F.lit("["), shown, more, F.lit("]")))
        .when(v["tag"].isin("entity", "ref"), plain_entity(v["text"]))
        .otherwise(v["text"])
    )
