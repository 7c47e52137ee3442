"""The fold over a stream of commands: each micro-batch is folded into the snapshot of the last, with the same expressions as in batch.

Rows whose seq is not above the snapshot's are late and go to a folder of their own. A batch writes its snapshot and its answers to folders
named by its id, so a batch that runs again overwrites what it wrote before.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvlake.operators import fold

STATE = "project string, key string, ce struct<seq:bigint,kept:boolean,value:string>, de struct<seq:bigint,kept:boolean,value:string>"


def answers_on(states: DataFrame, commands: DataFrame) -> DataFrame:
    """The lookups of commands, answered on top of a state that is older than all of them."""
    base = states.where("ce is not null or de is not null")
    empty = F.array().cast("array<string>")
    # a key of the state becomes a row before all commands, whose effects are the state's
    seed = base.select(F.lit(-1).cast("bigint").alias("seq"), "project", F.lit("STATE").alias("verb"), "key", F.lit(None).cast("string").alias("value"), empty.alias("flags"), "ce", "de")
    rows = fold.effects(commands).select("seq", "project", "verb", "key", "value", "flags", "ce", "de")
    return fold.answers_from(fold.last_barrier(rows.unionByName(seed)))


def folder(top: str) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps snapshots, answers and late rows under a folder."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{top}/state/{number - 1}"
        first = number == 0
        states = spark.createDataFrame([], STATE) if first else spark.read.schema(STATE).parquet(before)
        mark = -1 if first else spark.read.parquet(f"{top}/mark/{number - 1}").first()["mark"]
        batch = batch.persist()
        try:
            fresh = batch.where(F.col("seq") > mark)
            batch.where(F.col("seq") <= mark).write.mode("overwrite").parquet(f"{top}/late/{number}")
            answers_on(states, fresh).write.mode("overwrite").parquet(f"{top}/answers/{number}")
            fold.advance(states, fresh).write.mode("overwrite").parquet(f"{top}/state/{number}")
            fresh.agg(F.greatest(F.coalesce(F.max("seq"), F.lit(mark)), F.lit(mark)).cast("bigint").alias("mark")).write.mode("overwrite").parquet(f"{top}/mark/{number}")
        finally:
            batch.unpersist()

    return step


def start(commands: DataFrame, top: str) -> StreamingQuery:
    return commands.writeStream.foreachBatch(folder(top)).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()


def answers(spark: SparkSession, top: str) -> DataFrame:
    return spark.read.parquet(os.path.join(top, "answers", "*"))
