"""JSON values as text columns, each in the form that ``to_json`` of a variant gives: equal values are equal texts.

A value is a text such as ``"x"``, ``5``, ``null`` or ``{"a":1}``. Members of objects are in name order, as variants keep them. Explode lists before
going on with their values, so that no expression repeats another.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_object(text: Column) -> Column:
    return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))


def string_of(text: Column) -> Column:
    """The content of a JSON string; null for any other value."""
    return F.when(F.ltrim(text).startswith('"'), F.try_variant_get(F.try_parse_json(text), "$", "string"))


def members(text: Column, path: str = "$") -> Column:
    """An object (that stands at ``path``) as a map of name to value; null for any other value."""
    return F.transform_values(F.try_variant_get(F.try_parse_json(text), path, "map<string,variant>"), lambda _, v: F.to_json(v))


def items(text: Column, path: str = "$") -> Column:
    """The values of an array at ``path``; null for any other value."""
    return F.transform(F.try_variant_get(F.try_parse_json(text), path, "array<variant>"), lambda v: F.to_json(v))


def at(text: Column, path: str) -> Column:
    """The value at ``path``."""
    return F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant"))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING or another kind of a variant."""
    return F.regexp_extract(F.schema_of_variant(value), r"^\w+", 0)
