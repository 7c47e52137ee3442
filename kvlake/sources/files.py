"""Text sources: command logs, password files, token lists and settings."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import text
from kvlake.operators import jsondoc


def parse_commands(lines: DataFrame) -> DataFrame:
    """lines (seq, session, line) as commands: verb, key, value and flags; a missing part is null."""
    parts = text.tokenize(F.col("line"))
    return lines.withColumn("p", parts).select("seq", "session", "line", F.col("p.verb").alias("verb"), F.nullif(F.col("p.arg"), F.lit("")).alias("key"), F.col("p.rest").alias("value"), text.flags(F.col("p.rest")).alias("flags"))


def parse_log(lines: DataFrame) -> DataFrame:
    """ip and line of the client actions in a log of text lines (value); other lines are left out."""
    pattern = r"\[CLIENT\] (\S+) action: (.*)$"
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("ip"), F.regexp_extract("value", pattern, 2).alias("line"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def parse_passwords(lines: DataFrame) -> DataFrame:
    """group, password of lines (value) of the form group:password, cut at the first colon; other lines are left out."""
    parts = F.split("value", ":", 2)
    return lines.where(F.size(parts) == 2).select(F.get(parts, 0).alias("group"), F.get(parts, 1).alias("password"))


def read_passwords(spark: SparkSession, path: str) -> DataFrame:
    return parse_passwords(spark.read.text(path))


def token_list(body: Column, key: str = "tokens") -> Column:
    """The list at a key of a JSON text; empty where it is missing or broken."""
    return jsondoc.array(body, key)


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """The tables of a TOML file of groups, a settings file that the driver reads."""
    with open(path, "rb") as f:
        held = tomllib.load(f)
    rows = [(name, g.get("salt"), g.get("access"), g.get("hash"), g.get("unix"), g.get("accessibility", [])) for name, g in held.items() if isinstance(g, dict)]
    return spark.createDataFrame(rows, "group string, salt string, access string, hash string, unix long, accessibility array<string>")


def message_table(spark: SparkSession, bundles: dict[str, dict]) -> DataFrame:
    """lang, key, ord, template from message bundles by language: each message is a text or a list of texts."""
    rows = [(lang, k, i, t) for lang, b in bundles.items() for k, v in b.items() for i, t in enumerate(v if isinstance(v, list) else [v])]
    return spark.createDataFrame(rows, "lang string, key string, ord int, template string")
