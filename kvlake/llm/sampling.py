"""Folds and bounded samples of rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model learns from: crc32(doc_id as text) mod 5 is 0. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those whose key hashes lowest: the same ones whatever the partitions are."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)
