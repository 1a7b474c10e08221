"""Texts out of JSON whose shape isn't known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col, let


def json_list(text: Column | str) -> Column:
    """The entries of a JSON array as texts (what is no text, as JSON); null for anything else, and for broken or blank text."""

    def said(entry: Column) -> Column:
        return F.when(F.schema_of_variant(entry) == "STRING", F.try_variant_get(entry, "$", "string")).otherwise(F.to_json(entry))

    return F.transform(F.try_variant_get(F.try_parse_json(col(text)), "$", "array<variant>"), said)


def first_string(value: Column, depth: int = 4) -> Column:
    """The first text in a variant: itself, trimmed, if it has any, or a number; in a list, of the first entry that has one;
    of an object, in its name, else url, else @id, whichever is there first.  Down to a depth."""
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.nullif(F.trim(F.try_variant_get(value, "$", "string")), F.lit("")))
    number = F.when(kind.rlike("^(?:BIGINT|DOUBLE|DECIMAL)"), F.to_json(value))
    if not depth:
        return F.coalesce(text, number)
    entries = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: first_string(x, depth - 1))
    listed = F.get(F.filter(entries, lambda x: x.isNotNull()), F.lit(0))
    there = [F.try_variant_get(value, f"$['{name}']", "variant") for name in ("name", "url", "@id")]
    named = F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in there])
    return F.coalesce(text, number, listed, let(named, lambda x: first_string(x, depth - 1)))
