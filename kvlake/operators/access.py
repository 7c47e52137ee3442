"""Groups, grants and quotas. groups: group, salt, access, hash, unix, accessibility (tokens that the group may use)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.functions.security import password_hash

#: What a new group may use until it is granted more.
FIRST_GRANT = "default"


def names(groups: DataFrame) -> DataFrame:
    return groups.select("group")


def grants(groups: DataFrame, group: str | None = None) -> DataFrame:
    """group, token: a row for each grant; a group without any has a null token."""
    rows = groups if group is None else groups.where(F.col("group") == group)
    return rows.select("group", F.explode_outer("accessibility").alias("token"))


def grant(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """groups with changed and the grants of wanted (group, token: one row a group) appended where they are missing."""
    rows = groups.join(wanted, "group", "left")
    there = F.array_contains("accessibility", F.col("token"))
    changed = F.col("token").isNotNull() & ~F.coalesce(there, F.lit(False))
    return rows.withColumn("changed", changed).withColumn("accessibility", F.when(changed, F.array_append("accessibility", F.col("token"))).otherwise(F.col("accessibility"))).drop("token")


def revoke(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """groups with changed and the first of each wanted grant removed."""
    rows = groups.join(wanted, "group", "left")
    at = F.coalesce(F.array_position("accessibility", F.col("token")), F.lit(0))
    rows = rows.withColumn("at", F.when(F.col("token").isNull(), 0).otherwise(at)).withColumn("changed", F.col("at") > 0)
    return rows.withColumn("accessibility", F.filter("accessibility", lambda x, i: i + 1 != F.col("at"))).drop("at", "token")


def can_access(groups: DataFrame, asked: DataFrame, observed: bool = False) -> DataFrame:
    """group, token, allowed. As observed, only the last grant of a group counts."""
    rows = asked.join(groups.select("group", "accessibility"), "group", "left")
    allowed = F.try_element_at("accessibility", F.lit(-1)) == F.col("token") if observed else F.array_contains("accessibility", F.col("token"))
    return rows.select("group", "token", F.coalesce(allowed, F.lit(False)).alias("allowed"))


def create(groups: DataFrame, new: DataFrame) -> DataFrame:
    """groups with those of new (group, salt, password, unix) whose name isn't taken; of several of one name, the first by salt."""
    made = new.groupBy("group").agg(F.min(F.struct("salt", "password", "unix")).alias("m")).select("group", "m.*")
    made = made.withColumn("access", password_hash(F.col("salt"), F.col("password"))).withColumn("hash", password_hash(F.col("salt"), F.col("group"))).withColumn("accessibility", F.array(F.lit(FIRST_GRANT)))
    return groups.unionByName(made.join(groups.select("group"), "group", "left_anti").select(*groups.columns))


def exists(groups: DataFrame, asked: DataFrame) -> DataFrame:
    """group, found for each asked group."""
    known = groups.select("group", F.lit(True).alias("hit")).distinct()
    return asked.select("group").join(known, "group", "left").select("group", F.coalesce("hit", F.lit(False)).alias("found"))


def set_settings(settings: DataFrame, wanted: DataFrame, only_present: bool = False) -> DataFrame:
    """settings (section, key, value) with those of wanted in place of what they had; only_present adds none."""
    on = ["section", "key"]
    kept = settings.join(wanted, on, "left_anti")
    put = wanted.join(settings.select(*on), on, "left_semi") if only_present else wanted
    return kept.unionByName(put.select(*settings.columns))


def put_passwords(held: DataFrame, new: DataFrame, loaded: bool = True) -> DataFrame:
    """group, password after writing new ones; a store that wasn't loaded before is overwritten, as observed."""
    return held.join(new, "group", "left_anti").unionByName(new.select(*held.columns)) if loaded else new.select(*held.columns)


def token_info(tokens: DataFrame, tier: DataFrame) -> DataFrame:
    """token, n_keys of each token: how many keys the tier (project, key) holds for it."""
    counted = tier.groupBy(F.col("project").alias("token")).agg(F.count("*").alias("n_keys"))
    return tokens.select("token").distinct().join(counted, "token", "left").select("token", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def remove_tokens(tokens: DataFrame, gone: DataFrame) -> DataFrame:
    return tokens.join(gone.select("token"), "token", "left_anti")


def burn(tokens: DataFrame) -> DataFrame:
    """No token is left."""
    return tokens.limit(0)


def login(groups: DataFrame, tries: DataFrame) -> DataFrame:
    """group, password, verified for each try."""
    rows = tries.join(groups.select("group", "salt", "access"), "group", "left")
    return rows.select("group", "password", F.coalesce(F.col("access") == password_hash(F.col("salt"), F.col("password")), F.lit(False)).alias("verified"))


def quota(tokens: DataFrame, owner: str, most: int, observed: bool = False) -> DataFrame:
    """owner, n_tokens, able: whether another token may be made. As observed, the test is the wrong way round."""
    counted = tokens.groupBy(owner).agg(F.count("*").alias("n_tokens"))
    return counted.withColumn("able", F.col("n_tokens") > most if observed else F.col("n_tokens") < most)
