"""Edits of JSON documents, as column expressions over their text: objects, or lists, whose other members keep their types and places.

A missing document (null) is an empty object. A text that isn't an object stays as it is: no edit can be made in it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,variant>"


def members(body: Column) -> Column:
    """The members of an object; null where the text isn't one."""
    return F.from_json(F.coalesce(body, F.lit("{}")), MAP)


def get(body: Column, key: str) -> Column:
    return F.get_json_object(body, f"$['{key}']")


def _edited(body: Column, edit: Column) -> Column:
    return F.when(members(body).isNull(), body).otherwise(F.to_json(edit))


def _without(body: Column, key: str) -> Column:
    return F.map_filter(members(body), lambda k, v: k != key)


def _with(body: Column, key: str, value: Column) -> Column:
    return F.map_concat(_without(body, key), F.create_map(F.lit(key), value))


def update_value(body: Column, key: str, value: Column) -> Column:
    """The object with a top-level member set to a text, number or boolean: others keep their place, the new one comes last."""
    return _edited(body, _with(body, key, value.cast("variant")))


def delete_key(body: Column, key: str) -> Column:
    return _edited(body, _without(body, key))


def array(body: Column, key: str) -> Column:
    """A list member as texts; an empty list where it is missing or isn't one."""
    return F.coalesce(F.try_variant_get(F.element_at(members(body), F.lit(key)), "$", "array<string>"), F.array().cast("array<string>"))


def write_array(body: Column, key: str, items: Column) -> Column:
    """The object with a top-level member set to a list."""
    return _edited(body, _with(body, key, F.to_variant_object(items)))


def _items(body: Column, key: str) -> Column:
    """A list member whose items keep their types; null where it isn't a list, empty where it is missing."""
    held = members(body)
    missing = ~F.map_contains_key(held, F.lit(key))
    return F.when(missing, F.array().cast("array<variant>")).otherwise(F.try_variant_get(F.element_at(held, F.lit(key)), "$", "array<variant>"))


def append_to_array(body: Column, key: str, item: Column) -> Column:
    """The object with an item more in a list member, which is made where it is missing; unchanged where the member isn't a list."""
    held = _items(body, key)
    return F.when(held.isNull(), body).otherwise(write_array(body, key, F.array_append(held, item.cast("variant"))))


def remove_from_array(body: Column, key: str, index: Column) -> Column:
    """The object without the item of a list member at a place counted from 0; unchanged where there is none."""
    held = _items(body, key)
    there = (index >= 0) & (index < F.size(held))
    return F.when(there, write_array(body, key, F.filter(held, lambda x, i: i != index))).otherwise(body)


def append(items: Column, item: Column) -> Column:
    return F.array_append(F.coalesce(items, F.array().cast("array<string>")), item)


def remove_at(items: Column, index: Column) -> Column:
    """Without the item at a place counted from 0; unchanged where there is none."""
    return F.filter(items, lambda x, i: i != index)


def set_at(items: Column, index: Column, item: Column) -> Column:
    """With another item at a place counted from 0; unchanged where there is none."""
    return F.transform(items, lambda x, i: F.when(i == index, item).otherwise(x))


def append_size(items: Column, item: Column) -> Column:
    """How many items there are after one is appended; equal ones are kept."""
    return F.size(append(items, item))


def merge_size(items: Column, more: Column) -> Column:
    return F.size(F.concat(items, more))


def pretty(body: Column) -> Column:
    """An object over several lines."""
    return F.when(members(body).isNull(), body).otherwise(F.to_json(members(body), {"pretty": "true"}))
