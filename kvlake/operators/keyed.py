"""Keyed tables: text, list-keyed and list-valued collections share one implementation, told apart by the types of key and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING = "null"
KINDS = {"string": ("string", "string"), "list_key": ("array<string>", "string"), "list_value": ("string", "array<string>")}


class Keyed:
    """A collection (key, value); every operation is a join or a union over the whole table and returns a new one."""

    def __init__(self, table: DataFrame, kind: str = "string"):
        key, value = KINDS[kind]
        self.kind = kind
        self.table = table.select(F.col("key").cast(key).alias("key"), F.col("value").cast(value).alias("value"))

    @classmethod
    def of(cls, rows: DataFrame, order: str, kind: str = "string") -> Keyed:
        """From rows (key, value, order): the last of each key by order, by partial aggregation."""
        return cls(rows.where("key is not null and value is not null").groupBy("key").agg(F.max_by("value", order).alias("value")), kind)

    def _missing(self) -> Column:
        return F.array(F.lit(MISSING)) if self.kind == "list_value" else F.lit(MISSING)

    def set(self, rows: DataFrame) -> Keyed:
        return Keyed(self.table.join(rows, "key", "left_anti").unionByName(rows.select("key", "value")), self.kind)

    def get(self, keys: DataFrame) -> DataFrame:
        """key, value of each asked key; what is missing is the text null, or a list of it."""
        return keys.join(self.table, "key", "left").withColumn("value", F.coalesce("value", self._missing()))

    def delete(self, keys: DataFrame) -> Keyed:
        return Keyed(self.table.join(keys, "key", "left_anti"), self.kind)

    def exists(self, keys: DataFrame, observed: bool = False) -> DataFrame:
        """key, found. As observed, list keys are asked for by texts and never found."""
        if observed and self.kind == "list_key":
            return keys.withColumn("found", F.lit(False))
        return keys.join(self.table.select("key", F.lit(True).alias("hit")), "key", "left").select(*keys.columns, F.coalesce("hit", F.lit(False)).alias("found"))

    def store(self) -> DataFrame:
        return self.table


def lists_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: the list of values of each key, in order."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.transform(held, lambda x: x["v"]).alias("value"))


def _by_kind(operations: DataFrame) -> DataFrame:
    """operations with the key and the value that count for their kind, as texts: a list as JSON, so that no two lists are alike."""
    key = F.when(F.col("kind") == "list_key", F.to_json("list_key")).otherwise(F.col("key"))
    value = F.when(F.col("kind") == "list_value", F.array_join("list_value", "|")).otherwise(F.col("value"))
    last = F.when(F.col("op") == "put", F.struct(F.lit(True).alias("held"), value.alias("value"))).when(F.col("op") == "del", F.struct(F.lit(False).alias("held"), F.lit(None).cast("string").alias("value")))
    return operations.select("kind", "seq", "op", key.alias("key"), last.alias("effect"))


def dispatch(operations: DataFrame) -> DataFrame:
    """kind, seq, op, value (of get) and found (of exists) for the lookups of a log of put, get, del and exists on collections of any kind.

    A lookup sees the last put or del of its kind and key before it. What is missing is the text null.
    """
    before = Window.partitionBy("kind", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = _by_kind(operations).withColumn("last", F.last("effect", True).over(before)).where(F.col("op").isin("get", "exists"))
    held = F.coalesce(F.col("last.held"), F.lit(False))
    value = F.when(F.col("op") == "get", F.when(held, F.col("last.value")).otherwise(MISSING))
    return rows.select("kind", "seq", "op", value.alias("value"), F.when(F.col("op") == "exists", held).alias("found"))


def dispatch_final(operations: DataFrame) -> DataFrame:
    """kind, key, held, value: the last put or del of each key, by partial aggregation."""
    rows = _by_kind(operations).where("effect is not null")
    return rows.groupBy("kind", "key").agg(F.max_by("effect", "seq").alias("last")).select("kind", "key", "last.held", "last.value")
