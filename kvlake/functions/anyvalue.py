"""Values of any type (VARIANT): what they are, and as what they can be taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"number": "double", "string": "string", "boolean": "boolean", "list": "array<variant>"}


def kind(value: Column | str) -> Column:
    """number, string, boolean, list, object or null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "object").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def is_instance(value: Column | str, wanted: str) -> Column:
    return kind(value) == wanted


def get_as(value: Column | str, wanted: str, strict: bool = False) -> Column:
    """The value as number, string, boolean or list; of another type, null, or an error where strict is asked for."""
    taken = F.try_variant_get(value, "$", TYPES[wanted])
    other = F.raise_error(F.concat(F.lit(f"Value is not a {wanted}: "), kind(value))).cast(TYPES[wanted]) if strict else F.lit(None)
    return F.when(is_instance(value, wanted), taken).otherwise(other)
