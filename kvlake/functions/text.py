"""Text rules of the command language, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG_WORDS = ("-&save", "-&protobuff", "-&cache", "-&from-cache", "-&from-protobuff", "-&asa-json")
LEVELS = ("Info", "Debug", "Error")
# What is said to a command with too few parts.
USAGE = {
    "LIN": "USAGE: LIN <Group> <Password>",
    "AUTH": "ERROR: Usage: AUTH <CREATE|token>",
    "GET": "USAGE: GET <key> [-&from-cache,-&from-protobuff] [-&asa-json]",
    "SET": "USAGE: SET <key> <value> [-&save] [-&cache] [-&protobuff]",
    "DEL": "USAGE: DEL <key> [-&cache] [-&protobuff]",
    "UPDATE": "USAGE: UPDATE <key> <newValue>",
    "HEAVEN": "USAGE: GET <key> [-&from-cache,-&from-protobuff] [-&asa-json]",  # it goes on as a GET
}


def tokenize(line: Column) -> Column:
    """verb (upper case), arg and rest of a line: a split at single blanks into three parts at most; missing parts are null."""
    parts = F.split(line, " ", 3)
    return F.struct(F.upper(F.get(parts, 0)).alias("verb"), F.get(parts, 1).alias("arg"), F.get(parts, 2).alias("rest"))


def flags(rest: Column) -> Column:
    """The known flag words of the third part, lower case, in order."""
    return F.filter(F.split(F.lower(F.coalesce(rest, F.lit(""))), " "), lambda w: w.isin(*FLAG_WORDS))


def has_flag(found: Column, *words: str) -> Column:
    return F.arrays_overlap(found, F.array(*[F.lit(w) for w in words]))


def stored_value(rest: Column, observed: bool = False) -> Column:
    """What SET stores: the rest without blanks at its end and, unless observed is asked for, without flag words."""
    if observed:
        return F.rtrim(rest)
    kept = F.filter(F.split(rest, " "), lambda w: ~F.lower(w).isin(*FLAG_WORDS))
    return F.rtrim(F.array_join(kept, " "))


def key_head(key: Column) -> Column:
    """The part of a key that messages show: up to the first colon."""
    return F.get(F.split(key, ":"), 0)


def missing(key: Column) -> Column:
    return F.concat(F.lit("err: "), key_head(key), F.lit(" not found in cache or protobuff"))


def json_reply(key: Column, value: Column, observed: bool = False) -> Column:
    """A key and its value as JSON; as observed, the value isn't escaped and the key is cut."""
    if observed:
        return F.concat(F.lit('{"key": "'), key_head(key), F.lit('", "data": "'), value, F.lit('"}'))
    return F.to_json(F.struct(key.alias("key"), value.alias("data")))


def frame(level: Column, date: Column, message: Column) -> Column:
    """[Info - date]: message, for levels 0 to 2; another level is an error."""
    name = F.get(F.array(*[F.lit(x) for x in LEVELS]), level)
    return F.when(level.between(0, 2), F.format_string("[%s - %s]: %s", name, date, message)).otherwise(F.raise_error(F.lit("unknown level")))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Replaces <name> by each value."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"<{name}>"), value)
    return template
