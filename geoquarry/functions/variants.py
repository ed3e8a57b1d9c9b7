"""Type-checked reads from JSON held as VARIANT.

A plain variant cast is looser than a catalog reader may be: it turns ``true``
into 1 and a number into text. These readers give NULL for a wrong type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(*keys: str) -> str:
    """Return the variant path of nested object keys."""
    return "$" + "".join(f"['{key}']" for key in keys)


def parse_json(text: Column) -> Column:
    """Parse JSON text; text that is not JSON gives NULL."""
    return F.try_parse_json(text)


def member(value: Column, *keys: str) -> Column:
    """Return a nested member as a variant, NULL when it is absent."""
    return F.try_variant_get(value, json_path(*keys), "variant")


def kind_of(value: Column) -> Column:
    """Return the type name of a variant, such as STRING or BIGINT."""
    return F.schema_of_variant(value)


def text(value: Column) -> Column:
    """Return a variant that is a string as text, else NULL."""
    return F.when(kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


def filled_text(value: Column) -> Column:
    """Return a variant that is a string with at least one character, else NULL."""
    return F.nullif(text(value), F.lit(""))


def text_at(value: Column, *keys: str) -> Column:
    """Return a member that is a string, else NULL."""
    is_text = kind_of(member(value, *keys)) == "STRING"
    return F.when(is_text, F.try_variant_get(value, json_path(*keys), "string"))


def filled_text_at(value: Column, *keys: str) -> Column:
    """Return a member that is a string with at least one character, else NULL."""
    return F.nullif(text_at(value, *keys), F.lit(""))


def integer_at(value: Column, *keys: str) -> Column:
    """Return a member that is an integer, else NULL. A bool or 5.0 is no integer."""
    is_integer = kind_of(member(value, *keys)) == "BIGINT"
    return F.when(is_integer, F.try_variant_get(value, json_path(*keys), "bigint"))


def list_at(value: Column, *keys: str) -> Column:
    """Return a member that is a list, as an array of variants, else NULL."""
    return F.try_variant_get(value, json_path(*keys), "array<variant>")


def object_at(value: Column, *keys: str) -> Column:
    """Return a member that is an object, as a map of variants, else NULL."""
    return F.try_variant_get(value, json_path(*keys), "map<string,variant>")


def ordered_object(body: Column, path: str) -> Column:
    """Return an object of a JSON text as a map whose keys keep the order of the text."""
    return F.from_json(F.get_json_object(body, path), "map<string,variant>")


def texts_of(values: Column) -> Column:
    """Return the strings of an array of variants, in order; other elements drop out."""
    kept = F.filter(values, lambda item: kind_of(item) == "STRING")
    return F.transform(kept, lambda item: F.try_variant_get(item, "$", "string"))


def is_number(value: Column) -> Column:
    """Return whether a variant is a number (a bool is not)."""
    return F.coalesce(kind_of(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
