"""The durable tier: (project, key, value, seq) rows in snapshots that are partitioned by project; and lookups over both tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import text


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_snapshot(tier: DataFrame, path: str) -> None:
    """A new snapshot folder; swapping a pointer to it is the caller's, so readers never see half of one."""
    tier.repartition("project", "key").sortWithinPartitions("project", "key").write.partitionBy("project").parquet(path)


def upsert(tier: DataFrame, rows: DataFrame, observed: bool = False) -> DataFrame:
    """The row of the largest seq for each project and key, by partial aggregation; the new row wins a tie.

    As observed, the first write to a project that the tier doesn't hold is lost.
    """
    if observed:
        fresh = rows.join(tier.select("project").distinct(), "project", "left_anti").groupBy("project").agg(F.min("seq").alias("seq"))
        rows = rows.join(fresh, ["project", "seq"], "left_anti")
    both = tier.withColumn("turn", F.lit(0)).unionByName(rows.withColumn("turn", F.lit(1)))
    last = both.groupBy("project", "key").agg(F.max_by(F.struct("value", "seq"), F.struct("seq", "turn")).alias("r"))
    return last.select("project", "key", "r.value", "r.seq")


def get(tier: DataFrame, keys: DataFrame, default: str | None = None, strict: bool = False) -> DataFrame:
    """project, key, value of each asked (project, key); what is missing has the default, or is an error where strict is asked for."""
    on = ["project", "key"]
    met = keys.select(*on).join(tier.select(*on, "value"), on, "left")
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col("key"))).cast("string") if strict else F.lit(default).cast("string")
    return met.select(*on, F.coalesce("value", missing).alias("value"))


def contains(tier: DataFrame, keys: DataFrame) -> DataFrame:
    """project, key, found of each asked (project, key)."""
    on = ["project", "key"]
    return keys.select(*on).join(tier.select(*on, F.lit(True).alias("hit")), on, "left").select(*on, F.coalesce("hit", F.lit(False)).alias("found"))


def delete(tier: DataFrame, keys: DataFrame) -> DataFrame:
    return tier.join(keys.select("project", "key"), ["project", "key"], "left_anti")


def drop_project(tier: DataFrame, project: str) -> DataFrame:
    return tier.where(F.col("project") != project)


def find_project(tier: DataFrame, project: str) -> DataFrame:
    return tier.where(F.col("project") == project)


def fallback(keys: DataFrame, cache: DataFrame, durable: DataFrame, durable_first: bool = False) -> DataFrame:
    """project, key, value, tier, reply for each asked (project, key): the first tier that has it."""
    on = ["project", "key"]
    met = keys.select(*on).join(cache.select(*on, F.col("value").alias("c")), on, "left").join(durable.select(*on, F.col("value").alias("d")), on, "left")
    one, two = (("d", "durable"), ("c", "cache")) if durable_first else (("c", "cache"), ("d", "durable"))
    value = F.coalesce(one[0], two[0])
    tier = F.when(F.col(one[0]).isNotNull(), one[1]).when(F.col(two[0]).isNotNull(), two[1])
    return met.select(*on, value.alias("value"), tier.alias("tier"), F.coalesce(value, text.missing(F.col("key"))).alias("reply"))


def restore(cache: DataFrame, durable: DataFrame, project: str) -> DataFrame:
    """The volatile tier after a project's part of it is replaced by the durable one."""
    return drop_project(cache, project).unionByName(find_project(durable, project))


def key_counts(tier: DataFrame) -> DataFrame:
    return tier.groupBy("project").agg(F.count("*").alias("n_keys"))
