"""Sessions: login, choice of a project, and the gates before commands. All state is columns of ordered windows per session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions import text
from kvlake.functions.security import password_hash

LOGIN_FIRST = "Please login first using LIN command"
AUTH_FIRST = "Please authenticate first using AUTH command"


def gate(commands: DataFrame, groups: DataFrame, tokens: DataFrame, new_token: Column | None = None) -> DataFrame:
    """commands with logged_in, project, status, new_token and message.

    commands: seq, session, verb, arg, rest. groups: group, salt, access, accessibility. tokens: token. The list of grants is the one at
    login; a token made in a session can't be chosen in it, since it isn't on that list. new_token gives the tokens that AUTH CREATE makes,
    at random where it isn't given; write the result before it is used twice, as each run makes others.
    """
    # of a group's grants, those that are tokens: small tables, so that the log itself is never dealt by its arguments
    usable = groups.select("group", F.explode("accessibility").alias("token")).join(tokens.select("token"), "token", "left_semi").groupBy("group").agg(F.collect_set("token").alias("usable"))
    groups = groups.join(usable, "group", "left")
    lin = commands.where("verb = 'LIN' and arg is not null and rest is not null")
    checked = lin.join(groups, lin.arg == groups["group"]).where(F.col("access") == password_hash(F.col("salt"), F.col("rest")))
    first = checked.groupBy("session").agg(F.min_by(F.struct(F.col("seq").alias("login_seq"), F.col("group").alias("login_group"), F.col("accessibility").alias("grants"), "usable"), "seq").alias("login"))
    rows = commands.join(first.select("session", "login.*"), "session", "left")
    rows = rows.withColumn("logged_in", F.coalesce(F.col("seq") > F.col("login_seq"), F.lit(False)))
    held = lambda c: F.coalesce(F.array_contains(c, F.col("arg")), F.lit(False))
    rows = rows.withColumn("granted", held("grants"))
    chosen = (F.col("verb") == "AUTH") & F.col("logged_in") & held("usable")
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("project", F.last(F.when(chosen, F.col("arg")), True).over(before))
    verb = F.col("verb")
    short = F.col("arg").isNull()
    status = (
        F.when(~F.col("logged_in") & (verb == "LIN"), F.when(short | F.col("rest").isNull(), "usage").when(F.col("seq") == F.col("login_seq"), "login").otherwise("login failed"))
        .when(~F.col("logged_in"), "login first")
        .when(verb == "AUTH", F.when(short, "usage").when(F.upper("arg") == "CREATE", "created").when(chosen, "authenticated").when(~F.col("granted"), "denied").otherwise("invalid"))
        .when(F.col("project").isNull() & (verb != "EXIT"), "auth first")
        .otherwise("ready")
    )
    made = F.sha2(F.concat(F.uuid(), F.uuid()), 512) if new_token is None else new_token
    rows = rows.withColumn("status", status).withColumn("new_token", F.when(F.col("status") == "created", made))
    message = (
        F.when(F.col("status") == "usage", F.when(verb == "LIN", text.USAGE["LIN"]).otherwise(text.USAGE["AUTH"]))
        .when(F.col("status") == "created", F.concat(F.lit("Project created! Token: "), "new_token")).when(F.col("status") == "login first", LOGIN_FIRST).when(F.col("status") == "auth first", AUTH_FIRST)
        .when(F.col("status") == "denied", F.concat(F.lit("Cannot auth with: "), F.coalesce("arg", F.lit(""))))
        .when(F.col("status") == "invalid", F.concat(F.lit("Invalid token: "), "arg")).when(F.col("status") == "authenticated", F.concat(F.lit("Authenticated to project: "), "arg"))
    )
    return rows.withColumn("message", message).drop("login_seq", "grants", "granted", "usable")


def create_tokens(tokens: DataFrame, new: DataFrame) -> DataFrame:
    """tokens with those of new (token) that aren't there yet."""
    return tokens.select("token").unionByName(new.select("token").join(tokens, "token", "left_anti").distinct())
