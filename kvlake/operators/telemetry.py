"""Admission by address, and counts over command logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_CONNECTIONS = 12


def admission(connections: DataFrame, most: int = MOST_CONNECTIONS) -> DataFrame:
    """connections (seq, ip, delta: 1 for an attempt, -1 for a close) with open (after the row) and admitted.

    An attempt is refused while `most` are open, and then counts for nothing; so does a close where none is open. Closes are those of
    admitted connections, as refused ones are never handled. The running sum is held at 0 from below, then at `most` from above: what it
    would exceed by, so far, is what has been refused. All are running windows, which hold one row at a time.
    """
    on = Window.partitionBy("ip").orderBy("seq")
    so_far = on.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = connections.withColumn("sum", F.sum("delta").over(so_far))
    rows = rows.withColumn("sum", F.col("sum") + F.greatest(F.lit(0), F.max(-F.col("sum")).over(so_far)))
    rows = rows.withColumn("refused", F.greatest(F.lit(0), F.max(F.col("sum") - most).over(so_far)))
    rows = rows.withColumn("admitted", (F.col("delta") < 0) | (F.col("refused") == F.lag("refused", 1, 0).over(on)))
    return rows.withColumn("open", F.col("sum") - F.col("refused")).drop("sum", "refused")


def verb_counts(commands: DataFrame) -> DataFrame:
    return commands.groupBy("project", "verb").agg(F.count("*").alias("n"))
