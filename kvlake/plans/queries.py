"""The registered queries over the test tables, each with the SQL that has to give the same rows.

The command log is made of events: seq is event_id, four projects, 37 keys, the verb by event type, a barrier every 997 rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions import security, sizing, text
from kvlake.functions import anyvalue
from kvlake.operators import access, fold, jsondoc, session, telemetry, tiers
from kvlake.operators.keyed import KINDS, Keyed, dispatch, dispatch_final, lists_by_key
from kvlake.sources import files, wire

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commands(spark: SparkSession, sf_dir: str, *get_flags: str) -> DataFrame:
    """The command log; get_flags go with every GET."""
    kind, n = F.col("event_type"), F.col("event_id")
    verb = F.when(n % 997 == 996, "HEAVEN").when(kind == "view", "GET").when(kind.isin("click", "purchase"), "SET").when(kind == "signup", "UPDATE").otherwise("DEL")
    flag = F.when(F.col("verb").isin("HEAVEN", "GET", "UPDATE"), "").when(kind == "purchase", "-&save").when((kind == "error") & (n % 3 == 1), "-&cache").when((kind == "error") & (n % 3 == 2), "-&protobuff").otherwise("")
    rows = table(spark, sf_dir, "events").withColumn("verb", verb).withColumn("flag", flag)
    flags = F.filter(F.array("flag"), lambda x: x != "")
    if get_flags:
        flags = F.when(F.col("verb") == "GET", F.array(*[F.lit(x) for x in get_flags])).otherwise(flags)
    return rows.select(
        n.alias("seq"), F.col("user_id").cast("string").alias("session"), (F.col("user_id") % 4).cast("string").alias("project"), "verb",
        F.concat(F.lit("k"), (F.col("user_id") % 37).cast("string")).alias("key"), F.col("props").alias("value"), flags.alias("flags"), "flag",
    )


CMD = """cmd AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS session, CAST(user_id % 4 AS VARCHAR) AS project, 'k' || CAST(user_id % 37 AS VARCHAR) AS key, props AS value,
    CASE WHEN event_id % 997 = 996 THEN 'HEAVEN' WHEN event_type = 'view' THEN 'GET' WHEN event_type IN ('click', 'purchase') THEN 'SET' WHEN event_type = 'signup' THEN 'UPDATE' ELSE 'DEL' END AS verb,
    CASE WHEN event_id % 997 = 996 THEN '' WHEN event_type = 'purchase' THEN '-&save' WHEN event_type = 'error' AND event_id % 3 = 1 THEN '-&cache' WHEN event_type = 'error' AND event_id % 3 = 2 THEN '-&protobuff' ELSE '' END AS flag
  FROM events)"""
EFF = CMD + """, eff AS (
  SELECT *, sum(CASE WHEN verb = 'HEAVEN' THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS epoch,
    CASE WHEN verb IN ('SET', 'UPDATE') THEN 'S' || value WHEN verb = 'DEL' AND flag <> '-&protobuff' THEN 'D' END AS ce,
    CASE WHEN verb = 'SET' AND flag = '-&save' THEN 'S' || value WHEN verb = 'DEL' AND flag <> '-&cache' THEN 'D' END AS de
  FROM cmd), rows_of AS (
  SELECT seq, project, key, verb, epoch, ce, de FROM eff WHERE verb <> 'HEAVEN'
  UNION ALL SELECT seq, project, key, verb, epoch - 1, ce, de FROM eff WHERE verb = 'HEAVEN'), look AS (
  SELECT *, last_value(ce IGNORE NULLS) OVER (PARTITION BY project, key, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lc,
    last_value(de IGNORE NULLS) OVER (PARTITION BY project, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ld FROM rows_of), got AS (
  SELECT seq, project, key, verb, CASE WHEN lc LIKE 'S%' THEN substr(lc, 2) END AS cached, CASE WHEN ld LIKE 'S%' THEN substr(ld, 2) END AS durable FROM look WHERE verb IN ('GET', 'HEAVEN'))"""
LAST = EFF + """, last_c AS (SELECT project, key, arg_max(ce, seq) AS e, max(seq) AS seq FROM eff WHERE ce IS NOT NULL GROUP BY ALL), last_d AS (SELECT project, key, arg_max(de, seq) AS e, max(seq) AS seq FROM eff WHERE de IS NOT NULL GROUP BY ALL)"""
LIVE_C = "SELECT project, key, substr(e, 2) AS value, seq FROM last_c WHERE e LIKE 'S%' AND seq > (SELECT coalesce(max(seq), -1) FROM eff WHERE verb = 'HEAVEN')"
LIVE_D = "SELECT project, key, substr(e, 2) AS value, seq FROM last_d WHERE e LIKE 'S%'"


# ---- lookups and state


@query(f"WITH {EFF} SELECT seq, project, key, coalesce(cached, durable) AS value FROM got WHERE verb = 'GET'")
def kv_get_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir)).where("verb = 'GET'").select("seq", "project", "key", "value")


@query(f"WITH {LAST} {LIVE_C}")
def kv_final_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.live(fold.state(commands(spark, sf_dir)), "ce")


@query(f"WITH {LAST} {LIVE_D}")
def kv_final_durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.live(fold.state(commands(spark, sf_dir)), "de")


@query(f"WITH {EFF} SELECT seq, coalesce(cached, durable) AS value FROM got WHERE verb = 'GET'")
def kv_get_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir, "-&from-cache", "-&from-protobuff")).where("verb = 'GET'").select("seq", "value")


@query(f"WITH {EFF} SELECT seq, coalesce(durable, cached) AS value FROM got WHERE verb = 'GET'")
def kv_get_from_protobuff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir, "-&from-protobuff")).where("verb = 'GET'").select("seq", "value")


@query(f"""WITH {EFF} SELECT seq, coalesce('{{"key": "' || key || '", "data": "' || coalesce(cached, durable) || '"}}', 'err: ' || key || ' not found in cache or protobuff') AS reply FROM got WHERE verb = 'GET'""")
def kv_get_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir, "-&asa-json"), observed=True).where("verb = 'GET'").select("seq", "reply")


@query(f"""WITH {EFF} SELECT seq, coalesce('{{"key":"' || key || '","data":"' || replace(coalesce(cached, durable), '"', '\\"') || '"}}', 'err: ' || key || ' not found in cache or protobuff') AS reply FROM got WHERE verb = 'GET'""")
def kv_get_json_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir, "-&asa-json")).where("verb = 'GET'").select("seq", "reply")


@query(f"WITH {EFF} SELECT project, key, 'err: ' || key || ' not found in cache or protobuff' AS reply, count(*) AS n FROM got WHERE verb = 'GET' AND cached IS NULL AND durable IS NULL GROUP BY ALL")
def kv_get_miss_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir)).where("verb = 'GET' and value is null").groupBy("project", "key", "reply").agg(F.count("*").alias("n"))


def _gone(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """The keys whose last effect was a deletion by commands of one flag, with what is left in the other tier."""
    rows = fold.effects(commands(spark, sf_dir))
    last = rows.where("ce is not null or de is not null").groupBy("project", "key").agg(F.max(F.struct("seq", "verb", "flag")).alias("last"))
    return last.where((F.col("last.verb") == "DEL") & (F.col("last.flag") == flag)).select("project", "key", F.col("last.seq").alias("seq"))


def _gone_sql(flag: str) -> str:
    return f"WITH {EFF}, top AS (SELECT project, key, max(seq) AS seq, arg_max(verb, seq) AS verb, arg_max(flag, seq) AS flag FROM eff WHERE ce IS NOT NULL OR de IS NOT NULL GROUP BY project, key) SELECT project, key, seq FROM top WHERE verb = 'DEL' AND flag = '{flag}'"


@query(_gone_sql(""))
def kv_del_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(spark, sf_dir, "")


@query(_gone_sql("-&cache"))
def kv_del_cache_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(spark, sf_dir, "-&cache")


@query(_gone_sql("-&protobuff"))
def kv_del_durable_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gone(spark, sf_dir, "-&protobuff")


@query(f"WITH {CMD}, b AS (SELECT c.seq, c.verb, (SELECT max(h.seq) FROM cmd h WHERE h.verb = 'HEAVEN' AND h.seq < c.seq) AS barrier FROM cmd c) SELECT coalesce(barrier, -1) AS barrier, count(*) AS n FROM b GROUP BY 1")
def kv_heaven_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.last_barrier(commands(spark, sf_dir)).groupBy(F.coalesce("barrier", F.lit(-1)).alias("barrier")).agg(F.count("*").alias("n"))


@query(f"WITH {EFF} SELECT seq, project, key, coalesce(cached, durable) AS value FROM got WHERE verb = 'HEAVEN'")
def kv_heaven_fallthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.answers(commands(spark, sf_dir)).where("verb = 'HEAVEN'").select("seq", "project", "key", "value")


@query(f"WITH {EFF}, u AS (SELECT *, lag(ce) OVER (PARTITION BY project, key, epoch ORDER BY seq) AS was FROM eff WHERE ce IS NOT NULL) SELECT project, count(*) AS n, count(*) FILTER (was IS NULL OR was = 'D') AS n_new FROM u WHERE verb = 'UPDATE' GROUP BY project")
def kv_update_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = fold.last_barrier(fold.effects(commands(spark, sf_dir))).where("ce is not null")
    was = F.lag("ce").over(Window.partitionBy("project", "key").orderBy("seq"))
    held = F.coalesce((F.col("was.seq") > F.coalesce("barrier", F.lit(-1))) & F.col("was.kept"), F.lit(False))
    return rows.withColumn("was", was).where("verb = 'UPDATE'").groupBy("project").agg(F.count("*").alias("n"), F.count_if(~held).alias("n_new"))


NO_VALUE = EFF.replace("props AS value", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS value")


@query(f"WITH {NO_VALUE} SELECT seq, project, key, coalesce(cached, durable) AS value FROM got WHERE verb = 'GET'")
def kv_set_without_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups where every third SET and UPDATE has no value: such a command leaves its key alone."""
    rows = commands(spark, sf_dir).withColumn("value", F.when(F.col("seq") % 3 != 0, F.col("value")))
    return fold.answers(rows).where("verb = 'GET'").select("seq", "project", "key", "value")


@query(f"WITH {CMD} SELECT seq, CASE WHEN flag = '-&save' THEN 'Ok (Protobuf)' ELSE 'Ok (Cache)' END AS reply FROM cmd WHERE verb = 'SET'")
def kv_set_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.replies(commands(spark, sf_dir)).where("verb = 'SET'").select("seq", "reply")


@query(f"WITH {CMD} SELECT seq, CASE flag WHEN '-&cache' THEN 'Ok (Cache).' WHEN '-&protobuff' THEN 'Ok (Protobuf).' ELSE 'Ok (Cache,Protobuf).' END AS reply FROM cmd WHERE verb = 'DEL'")
def kv_del_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.replies(commands(spark, sf_dir)).where("verb = 'DEL'").select("seq", "reply")


@query(f"WITH {CMD} SELECT seq, 'error' AS status, 'ERROR: Unknown command' AS reply FROM cmd WHERE verb = 'DEL'")
def kv_unknown_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commands(spark, sf_dir).withColumn("verb", F.when(F.col("verb") == "DEL", "DELETE").otherwise(F.col("verb")))
    return fold.replies(rows).where("verb = 'DELETE'").select("seq", "status", "reply")


@query(f"WITH {LAST}, c AS ({LIVE_C}), d AS ({LIVE_D}) SELECT coalesce(c.project, d.project) AS project, coalesce(c.key, d.key) AS key, c.value AS cached, d.value AS durable FROM c FULL JOIN d ON c.project = d.project AND c.key = d.key")
def kv_incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final state by folding two halves one after the other."""
    rows = commands(spark, sf_dir)
    middle = table(spark, sf_dir, "events").agg((F.max("event_id") / 2).cast("bigint").alias("m"))
    split = rows.crossJoin(F.broadcast(middle))
    states = fold.advance(fold.state(split.where("seq <= m")), split.where("seq > m"))
    held = lambda t: F.when(F.col(f"{t}.kept"), F.col(f"{t}.value"))
    return states.select("project", "key", held("ce").alias("cached"), held("de").alias("durable")).where("cached is not null or durable is not null")


# ---- command lines


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as lines: every verb with its key; writes with their value and flag; some lines have no argument or another verb."""
    rows = commands(spark, sf_dir)
    verb = F.when(F.col("seq") % 5 == 0, F.lower("verb")).otherwise(F.col("verb"))
    line = F.when(F.col("seq") % 101 == 7, verb).when(F.col("seq") % 103 == 5, F.lit("PING x")).when(F.col("verb").isin("SET", "UPDATE"), F.rtrim(F.concat_ws(" ", verb, F.col("key"), F.col("value"), F.col("flag")))).otherwise(F.rtrim(F.concat_ws(" ", verb, F.col("key"), F.col("flag"))))
    return rows.select("seq", "session", line.alias("line"))


LINES = CMD + """, lines AS (SELECT seq, session, verb, key, value, flag,
  CASE WHEN seq % 101 = 7 THEN v WHEN seq % 103 = 5 THEN 'PING x' WHEN verb IN ('SET', 'UPDATE') THEN rtrim(v || ' ' || key || ' ' || value || ' ' || flag) ELSE rtrim(v || ' ' || key || ' ' || flag) END AS line
  FROM (SELECT *, CASE WHEN seq % 5 = 0 THEN lower(verb) ELSE verb END AS v FROM cmd)), parts AS (
  SELECT seq, session, line, upper(split_part(line, ' ', 1)) AS p_verb, nullif(split_part(line, ' ', 2), '') AS p_key,
    CASE WHEN len(string_split(line, ' ')) > 2 THEN array_to_string(string_split(line, ' ')[3:], ' ') END AS p_rest FROM lines)"""


@query(f"WITH {LINES} SELECT seq, p_verb AS verb, p_key AS key, p_rest AS rest FROM parts")
def cmd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_commands(lines(spark, sf_dir)).select("seq", "verb", "key", F.col("value").alias("rest"))


@query(f"WITH {LINES} SELECT seq, array_to_string(list_filter(string_split(lower(coalesce(p_rest, '')), ' '), lambda x: x IN ('-&save', '-&protobuff', '-&cache', '-&from-cache', '-&from-protobuff', '-&asa-json')), ',') AS flags FROM parts")
def cmd_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_commands(lines(spark, sf_dir)).select("seq", F.array_join("flags", ",").alias("flags"))


USAGE = "(VALUES " + ", ".join(f"('{verb}', '{said}')" for verb, said in text.USAGE.items()) + ") u(verb, said)"


@query(f"WITH {LINES} SELECT seq, p_verb AS verb, CASE WHEN p_verb IN ('GET', 'SET', 'DEL', 'UPDATE', 'HEAVEN') THEN said ELSE 'ERROR: Unknown command' END AS reply FROM parts LEFT JOIN {USAGE} ON u.verb = p_verb WHERE p_verb <> 'GET' AND (p_verb NOT IN ('GET', 'SET', 'DEL', 'UPDATE', 'HEAVEN') OR p_key IS NULL OR (p_verb IN ('SET', 'UPDATE') AND p_rest IS NULL))")
def cmd_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.replies(files.parse_commands(lines(spark, sf_dir))).where("status = 'error'").select("seq", "verb", "reply")


@query(f"WITH {CMD} SELECT seq, verb, said AS reply FROM cmd JOIN {USAGE} USING (verb) WHERE verb IN ('SET', 'UPDATE', 'DEL', 'HEAVEN')")
def cmd_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to each verb sent with too few parts."""
    rows = commands(spark, sf_dir)
    short = F.when(F.col("verb").isin("SET", "UPDATE"), F.concat_ws(" ", F.lower("verb"), "key")).otherwise(F.col("verb"))
    return fold.replies(files.parse_commands(rows.select("seq", "session", short.alias("line")))).where("status = 'error'").select("seq", "verb", "reply")


@query(f"WITH {LINES} SELECT '/10.0.0.' || CAST(seq % 9 AS VARCHAR) AS ip, p_verb AS verb, count(*) AS n FROM parts GROUP BY ALL")
def cmd_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("/10.0.0."), (F.col("seq") % 9).cast("string"))
    written = lines(spark, sf_dir).select(F.concat(F.lit("[2025-01-01] [CLIENT] "), ip, F.lit(" action: "), "line").alias("value"))
    return files.parse_log(written).withColumn("verb", text.tokenize(F.col("line"))["verb"]).groupBy("ip", "verb").agg(F.count("*").alias("n"))


@query(f"WITH {CMD} SELECT project, verb, count(*) AS n FROM cmd GROUP BY ALL")
def cmd_verb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.verb_counts(commands(spark, sf_dir))


@query(f"WITH {CMD} SELECT seq, '[' || CASE seq % 3 WHEN 0 THEN 'Info' WHEN 1 THEN 'Debug' ELSE 'Error' END || ' - 2025-01-01]: ' || value AS reply FROM cmd")
def cmd_reply_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select("seq", text.frame((F.col("seq") % 3).cast("int"), F.lit("2025-01-01"), F.col("value")).alias("reply"))


@query(f"WITH {LINES}, dead AS (SELECT session, min(seq) AS seq FROM parts WHERE p_key IS NULL GROUP BY session) SELECT p.seq, p_verb AS verb FROM parts p LEFT JOIN dead d ON p.session = d.session WHERE d.seq IS NULL OR p.seq <= d.seq")
def cmd_session_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.drop_dead_sessions(files.parse_commands(lines(spark, sf_dir))).select("seq", "verb")


# ---- sessions and access: customers are sessions, nations groups, regions tokens


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    salt = F.concat(F.lit("s"), F.col("n_nationkey").cast("string"))
    word = F.concat(F.lit("pw"), F.col("n_nationkey").cast("string"))
    grants = F.when(F.col("n_nationkey") % 2 == 0, F.array("r_name")).otherwise(F.array("r_name", F.lit("EXTRA"), "n_name"))
    return rows.select(F.col("n_name").alias("group"), salt.alias("salt"), security.password_hash(salt, word).alias("access"), F.sha2(salt, 256).alias("hash"), F.col("n_nationkey").cast("bigint").alias("unix"), grants.alias("accessibility"))


GROUPS = """groups AS (SELECT n_name AS grp, n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN [r_name] ELSE [r_name, 'EXTRA', n_name] END AS acc FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rows a customer: a GET too early, a login (wrong for every seventh), AUTH with one of the tokens, a GET."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf_dir, "region").select((F.col("r_regionkey")).alias("r"), F.col("r_name").alias("wanted")), F.col("c_custkey") % 5 == F.col("r"))
    word = F.when(F.col("c_custkey") % 7 == 0, F.lit("bad")).otherwise(F.concat(F.lit("pw"), F.col("c_nationkey").cast("string")))
    asked = F.when(F.col("c_custkey") % 11 == 0, "EXTRA").when(F.col("c_custkey") % 13 == 0, "CREATE").otherwise(F.col("wanted"))
    none = F.lit(None).cast("string")
    step = lambda i, verb, arg, rest: F.struct((F.col("c_custkey") * 4 + i).alias("seq"), F.lit(verb).alias("verb"), arg.cast("string").alias("arg"), rest.cast("string").alias("rest"))
    steps = F.array(step(0, "GET", F.lit("x"), none), step(1, "LIN", F.col("n_name"), word), step(2, "AUTH", asked, none), step(3, "GET", F.lit("x"), none))
    return rows.select(F.col("c_custkey").cast("string").alias("session"), F.explode(steps).alias("s")).select("s.seq", "session", "s.verb", "s.arg", "s.rest")


SESSIONS = GROUPS + """, who AS (SELECT c_custkey AS c, grp, acc, c_custkey % 7 <> 0 AS ok, CASE WHEN c_custkey % 11 = 0 THEN 'EXTRA' WHEN c_custkey % 13 = 0 THEN 'CREATE' ELSE r_name END AS asked
  FROM customer JOIN groups ON c_nationkey = k JOIN region ON c_custkey % 5 = r_regionkey), auth AS (SELECT *, list_contains(acc, asked) AS granted, asked IN (SELECT r_name FROM region) AS registered FROM who)"""


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.gate(session_commands(spark, sf_dir), groups(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("token")))


@query(f"""WITH {SESSIONS} SELECT c * 4 AS seq, 'login first' AS status FROM auth UNION ALL SELECT c * 4 + 1, CASE WHEN ok THEN 'login' ELSE 'login failed' END FROM auth
UNION ALL SELECT c * 4 + 2, CASE WHEN NOT ok THEN 'login first' WHEN asked = 'CREATE' THEN 'created' WHEN NOT granted THEN 'denied' WHEN registered THEN 'authenticated' ELSE 'invalid' END FROM auth
UNION ALL SELECT c * 4 + 3, CASE WHEN NOT ok THEN 'login first' WHEN granted AND registered THEN 'ready' ELSE 'auth first' END FROM auth""")
def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).select("seq", "status")


@query(f"WITH {SESSIONS} SELECT CAST(c AS VARCHAR) AS session, asked AS project FROM auth WHERE ok AND granted AND registered")
def session_current_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("project is not null").select("session", "project")


@query(f"WITH {SESSIONS} SELECT c * 4 + 2 AS seq, 'Authenticated to project: ' || asked AS message FROM auth WHERE ok AND granted AND registered")
def auth_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("status = 'authenticated'").select("seq", "message")


@query(f"WITH {SESSIONS} SELECT c * 4 + 2 AS seq, CASE WHEN granted THEN 'Invalid token: ' ELSE 'Cannot auth with: ' END || asked AS message FROM auth WHERE ok AND asked <> 'CREATE' AND NOT (granted AND registered)")
def auth_denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir).where("status in ('denied', 'invalid')").select("seq", "message")


@query(f"WITH {SESSIONS} SELECT c * 4 + 2 AS seq, sha256(CAST(c AS VARCHAR)) || sha256('x' || c) AS token, 'Project created! Token: ' || sha256(CAST(c AS VARCHAR)) || sha256('x' || c) AS message FROM auth WHERE ok AND asked = 'CREATE'")
def auth_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The projects that sessions make; here with tokens that follow from the session, so that they can be told in advance."""
    token = F.concat(F.sha2("session", 256), F.sha2(F.concat(F.lit("x"), "session"), 256))
    rows = session.gate(session_commands(spark, sf_dir), groups(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("token")), token)
    return rows.where("status = 'created'").select("seq", F.col("new_token").alias("token"), "message")


@query(f"WITH {SESSIONS}, said AS (SELECT c * 4 + 1 AS seq, '{text.USAGE["LIN"]}' AS message FROM auth WHERE c % 2 = 0 UNION ALL SELECT c * 4 + 2, CASE WHEN ok AND c % 2 = 1 THEN '{text.USAGE["AUTH"]}' ELSE '{session.LOGIN_FIRST}' END FROM auth) SELECT * FROM said")
def session_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to logins without a password (every second customer) and to AUTH without a token."""
    rows = session_commands(spark, sf_dir).withColumn("rest", F.when((F.col("verb") == "LIN") & (F.col("session").cast("long") % 2 == 0), None).otherwise(F.col("rest")))
    rows = rows.withColumn("arg", F.when(F.col("verb") == "AUTH", None).otherwise(F.col("arg")))
    done = session.gate(rows, groups(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("token")))
    return done.where((F.col("verb") == "AUTH") | (F.col("status") == "usage")).select("seq", "message")


@query("SELECT r_name AS token FROM region UNION SELECT c_mktsegment FROM customer")
def auth_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.create_tokens(table(spark, sf_dir, "region").select(F.col("r_name").alias("token")), table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("token")))


@query(f'WITH {GROUPS} SELECT grp AS "group" FROM groups')
def group_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.names(groups(spark, sf_dir))


@query(f'WITH {GROUPS} SELECT grp AS "group", unnest(acc) AS token FROM groups')
def group_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.grants(groups(spark, sf_dir))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("group"), F.when(F.col("n_nationkey") % 3 == 1, "EXTRA").otherwise("NEW").alias("token"))


WANTED = GROUPS + """, wanted AS (SELECT grp, acc, CASE WHEN k % 3 = 1 THEN 'EXTRA' WHEN k % 3 = 2 THEN 'NEW' END AS token FROM groups)"""


@query(f"""WITH {WANTED} SELECT grp AS "group", token IS NOT NULL AND NOT list_contains(acc, token) AS changed, array_to_string(CASE WHEN token IS NOT NULL AND NOT list_contains(acc, token) THEN list_append(acc, token) ELSE acc END, ',') AS grants FROM wanted""")
def group_grant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.grant(groups(spark, sf_dir), _wanted(spark, sf_dir)).select("group", "changed", F.array_join("accessibility", ",").alias("grants"))


@query(f"""WITH {WANTED} SELECT grp AS "group", coalesce(list_contains(acc, token), false) AS changed, array_to_string(list_filter(acc, lambda x: token IS NULL OR x <> token), ',') AS grants FROM wanted""")
def group_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.revoke(groups(spark, sf_dir), _wanted(spark, sf_dir)).select("group", "changed", F.array_join("accessibility", ",").alias("grants"))


@query(f"""WITH {WANTED} SELECT grp AS "group", token, list_contains(acc, token) AS allowed FROM wanted WHERE token IS NOT NULL""")
def group_can_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.can_access(groups(spark, sf_dir), _wanted(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second nation, and as many names that are no group."""
    some = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("group"), "n_nationkey")
    return some.unionByName(some.select(F.concat(F.lit("NEW "), "group").alias("group"), "n_nationkey"))


ASKED = "chosen AS (SELECT n_name AS grp, n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0), asked AS (SELECT grp, k FROM chosen UNION ALL SELECT 'NEW ' || grp, k FROM chosen)"


@query(f'WITH {ASKED} SELECT grp AS "group", grp IN (SELECT n_name FROM nation) AS found FROM asked')
def group_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.exists(groups(spark, sf_dir), _asked(spark, sf_dir))


@query(f"""WITH {GROUPS}, {ASKED} SELECT grp AS "group", k AS unix, array_to_string(acc, ',') AS grants FROM groups UNION ALL SELECT grp, k, 'default' FROM asked WHERE grp NOT IN (SELECT n_name FROM nation)""")
def group_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _asked(spark, sf_dir).select("group", F.lit("salt").alias("salt"), F.lit("pw").alias("password"), F.col("n_nationkey").cast("bigint").alias("unix"))
    return access.create(groups(spark, sf_dir), new).select("group", "unix", F.array_join("accessibility", ",").alias("grants"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("token"), F.col("n_regionkey").alias("owner"))


@query("SELECT DISTINCT n_name AS token, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_keys FROM nation")
def token_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return access.token_info(_tokens(spark, sf_dir), keys.select(F.col("n_name").alias("project"), F.col("c_custkey").alias("key")))


@query("SELECT n_name AS token FROM nation WHERE n_nationkey % 2 <> 0")
def token_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.remove_tokens(_tokens(spark, sf_dir), _asked(spark, sf_dir).select(F.col("group").alias("token"))).select("token")


@query(f"WITH {ASKED} SELECT n_name AS \"group\", CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'pw' || n_nationkey END AS password FROM nation UNION ALL SELECT grp, 'new' FROM asked WHERE grp LIKE 'NEW %'")
def pawd_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "nation").select(F.col("n_name").alias("group"), F.concat(F.lit("pw"), F.col("n_nationkey").cast("string")).alias("password"))
    return access.put_passwords(held, _asked(spark, sf_dir).select("group", F.lit("new").alias("password")))


@query(f"WITH {ASKED} SELECT n_name AS section, 'unix' AS key, CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT n_name, 'group', n_name FROM nation UNION ALL SELECT grp, 'unix', '0' FROM asked WHERE grp LIKE 'NEW %'")
def settings_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.set_settings(_settings(spark, sf_dir), _new_settings(spark, sf_dir))


@query("SELECT n_name AS section, 'unix' AS key, CASE WHEN n_nationkey % 2 = 0 THEN '0' ELSE CAST(n_nationkey AS VARCHAR) END AS value FROM nation UNION ALL SELECT n_name, 'group', n_name FROM nation")
def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.set_settings(_settings(spark, sf_dir), _new_settings(spark, sf_dir), only_present=True)


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.create_map(F.lit("unix"), F.col("n_nationkey").cast("string"), F.lit("group"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("section"), F.explode(both))


def _new_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select(F.col("group").alias("section"), F.lit("unix").alias("key"), F.lit("0").alias("value"))


@query("SELECT n_regionkey AS owner, count(*) AS n_tokens, count(*) < 6 AS able FROM nation GROUP BY 1")
def token_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.quota(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "owner"), "owner", 6)


# ---- collections


def parts_by_list(spark: SparkSession, sf_dir: str) -> Keyed:
    rows = table(spark, sf_dir, "part").select(F.array("p_brand", "p_type").alias("key"), F.col("p_name").alias("value"), "p_partkey")
    return Keyed.of(rows, "p_partkey", "list_key")


def parts_by_name(spark: SparkSession, sf_dir: str) -> Keyed:
    return Keyed.of(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"), "p_partkey"), "p_partkey")


def turns(spark: SparkSession, sf_dir: str) -> Keyed:
    return Keyed(lists_by_key(table(spark, sf_dir, "conversations"), "conv_id", "text", "turn"), "list_value")


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All brands but each fourth, and as many texts that are no brand."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    held = table(spark, sf_dir, "part").where(number % 4 != 0).select(F.col("p_brand").alias("key")).distinct()
    return held.unionByName(held.select(F.concat(F.lit("no "), "key").alias("key")))


BRANDS = "chosen AS (SELECT DISTINCT p_brand AS key FROM part WHERE CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) % 4 <> 0), brands AS (SELECT key FROM chosen UNION ALL SELECT 'no ' || key FROM chosen), held AS (SELECT p_brand AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY p_brand)"


@query(f"WITH {BRANDS} SELECT b.key, coalesce(value, 'null') AS value FROM brands b LEFT JOIN held h ON b.key = h.key")
def act_string_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_name(spark, sf_dir).get(_brands(spark, sf_dir))


@query(f"WITH {BRANDS} SELECT b.key, value IS NOT NULL AS found FROM brands b LEFT JOIN held h ON b.key = h.key")
def act_string_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_name(spark, sf_dir).exists(_brands(spark, sf_dir))


@query(f"WITH {BRANDS} SELECT key, value FROM held WHERE key NOT IN (SELECT key FROM brands)")
def act_string_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_name(spark, sf_dir).delete(_brands(spark, sf_dir)).store()


@query(f"WITH {BRANDS} SELECT key, 'set' AS value FROM brands UNION ALL SELECT key, value FROM held WHERE key NOT IN (SELECT key FROM brands)")
def act_string_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_name(spark, sf_dir).set(_brands(spark, sf_dir).withColumn("value", F.lit("set"))).store()


@query("SELECT array_to_string([p_brand, p_type], '|') AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY p_brand, p_type")
def act_list_key_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = parts_by_list(spark, sf_dir)
    return held.get(held.store().select("key")).select(F.array_join("key", "|").alias("key"), "value")


@query("SELECT DISTINCT array_to_string([p_type, p_brand], '|') AS key, false AS found FROM part UNION ALL SELECT DISTINCT array_to_string([p_brand, p_type], '|'), true FROM part")
def act_list_key_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = parts_by_list(spark, sf_dir)
    keys = held.store().select("key")
    return held.exists(keys.unionByName(keys.select(F.reverse("key").alias("key")))).select(F.array_join("key", "|").alias("key"), "found")


@query("SELECT CAST(conv_id AS VARCHAR) AS key, string_agg(text, '|' ORDER BY turn) AS value FROM conversations GROUP BY conv_id UNION ALL SELECT DISTINCT 'no ' || conv_id, 'null' FROM conversations")
def act_list_value_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = turns(spark, sf_dir)
    keys = held.store().select("key")
    return held.get(keys.unionByName(keys.select(F.concat(F.lit("no "), "key").alias("key")))).select("key", F.array_join("value", "|").alias("value"))


@query("SELECT CAST(conv_id AS VARCHAR) AS key, true AS found FROM conversations GROUP BY conv_id UNION ALL SELECT DISTINCT 'no ' || conv_id, false FROM conversations")
def act_list_value_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = turns(spark, sf_dir)
    keys = held.store().select("key")
    return held.exists(keys.unionByName(keys.select(F.concat(F.lit("no "), "key").alias("key"))))


@query("SELECT CAST(conv_id AS VARCHAR) AS key, CASE WHEN conv_id % 3 = 0 THEN 'a|b' ELSE string_agg(text, '|' ORDER BY turn) END AS value FROM conversations GROUP BY conv_id")
def act_list_value_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("key"), F.array(F.lit("a"), F.lit("b")).alias("value")).distinct()
    return turns(spark, sf_dir).set(some).store().select("key", F.array_join("value", "|").alias("value"))


@query("SELECT array_to_string([p_brand, p_type], '|') AS key, CASE WHEN max(p_partkey) % 2 = 0 THEN 'set' ELSE arg_max(p_name, p_partkey) END AS value FROM part GROUP BY p_brand, p_type")
def act_list_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_list(spark, sf_dir).set(_even(spark, sf_dir).withColumn("value", F.lit("set"))).store().select(F.array_join("key", "|").alias("key"), "value")


@query("SELECT array_to_string([p_brand, p_type], '|') AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY p_brand, p_type HAVING max(p_partkey) % 2 <> 0")
def act_list_key_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_by_list(spark, sf_dir).delete(_even(spark, sf_dir)).store().select(F.array_join("key", "|").alias("key"), "value")


def _even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list keys whose last part has an even number."""
    return table(spark, sf_dir, "part").groupBy(F.array("p_brand", "p_type").alias("key")).agg(F.max("p_partkey").alias("last")).where("last % 2 = 0").select("key")


@query("SELECT CAST(conv_id AS VARCHAR) AS key, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def act_list_value_del(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(F.col("conv_id").cast("string").alias("key")).distinct()
    return turns(spark, sf_dir).delete(gone).store().select("key", F.size("value").cast("bigint").alias("n"))


def _modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations on collections of all kinds in one log: kind, seq, op, list_key, key, list_value, value."""
    parts = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 3 + 1).cast("int"))
    op = F.element_at(F.array(*[F.lit(x) for x in ("put", "put", "get", "exists", "put", "del", "get")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return parts.select(kind.alias("kind"), F.col("p_partkey").alias("seq"), op.alias("op"), F.split("p_brand", "#").alias("list_key"), F.col("p_brand").alias("key"), F.split("p_name", " ").alias("list_value"), F.col("p_name").alias("value"))


MODAL = """ops AS (SELECT ['string', 'list_key', 'list_value'][p_partkey % 3 + 1] AS kind, p_partkey AS seq, ['put', 'put', 'get', 'exists', 'put', 'del', 'get'][p_partkey % 7 + 1] AS op, p_brand AS key, p_name AS value FROM part),
last AS (SELECT *, last_value(CASE WHEN op = 'put' THEN seq WHEN op = 'del' THEN -1 END IGNORE NULLS) OVER (PARTITION BY kind, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at FROM ops),
met AS (SELECT l.*, CASE l.kind WHEN 'list_value' THEN array_to_string(string_split(p.value, ' '), '|') ELSE p.value END AS got FROM last l LEFT JOIN ops p ON p.seq = l.at)"""


@query(f"WITH {MODAL} SELECT kind, seq, op, CASE WHEN op = 'get' THEN coalesce(got, 'null') WHEN got IS NULL THEN 'false' ELSE 'true' END AS answer FROM met WHERE op IN ('get', 'exists')")
def modal_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of get and exists as of their place in a log of operations on collections of all kinds."""
    return dispatch(_modal(spark, sf_dir)).select("kind", "seq", "op", F.coalesce("value", F.col("found").cast("string")).alias("answer"))


@query(f"WITH {MODAL}, top AS (SELECT kind, arg_max(op, seq) AS op FROM ops WHERE op IN ('put', 'del') GROUP BY kind, key) SELECT kind, count(*) FILTER (op = 'put') AS n_held, count(*) FILTER (op = 'del') AS n_deleted FROM top GROUP BY kind")
def modal_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys collections of each kind hold after a log of operations, and how many have been deleted."""
    held = dispatch_final(_modal(spark, sf_dir))
    return held.groupBy("kind").agg(F.count_if("held").alias("n_held"), F.count_if(~F.col("held")).alias("n_deleted"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'list' WHEN event_id % 4 = 2 THEN 'boolean' WHEN event_id % 4 = 1 THEN 'string' ELSE 'number' END AS kind, CASE WHEN event_id % 4 = 0 THEN CAST(event_id AS DOUBLE) END AS number, CASE WHEN event_id % 4 = 1 THEN event_type END AS string, CASE WHEN event_id % 4 = 3 THEN event_type END AS first FROM events")
def any_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of any type: what they are, and as what they can be taken."""
    n = F.col("event_id") % 4
    made = F.when(n == 3, F.to_variant_object(F.array("event_type"))).when(n == 2, (F.col("event_id") > 5).cast("variant")).when(n == 1, F.col("event_type").cast("variant")).otherwise(F.col("event_id").cast("variant"))
    rows = _events(spark, sf_dir).select("event_id", made.alias("v"))
    return rows.select("event_id", anyvalue.kind("v").alias("kind"), anyvalue.get_as("v", "number").alias("number"), anyvalue.get_as("v", "string").alias("string"), F.get(anyvalue.get_as("v", "list"), 0).cast("string").alias("first"))


# ---- the durable tier in bulk: documents by source, labels as a second tier


def durable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("value"), F.col("doc_id").alias("seq"))


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return held.select(F.col("source").alias("project"), F.col("doc_id").cast("string").alias("key"), F.concat_ws("/", "quality", "toxic").alias("value"), (F.col("doc_id") + 1_000_000_000).alias("seq"))


SECOND = "second AS (SELECT source AS project, CAST(l.doc_id AS VARCHAR) AS key, CAST(quality AS VARCHAR) || '/' || CAST(toxic AS VARCHAR) AS value FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query("SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents WHERE source = 'src3'")
def durable_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.find_project(durable(spark, sf_dir), "src3").select("project", "key", "value")


@query(f"WITH {SECOND} SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, coalesce(s.value, text) AS value FROM documents d LEFT JOIN second s ON CAST(d.doc_id AS VARCHAR) = s.key AND d.source = s.project")
def durable_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.upsert(durable(spark, sf_dir), second(spark, sf_dir)).select("project", "key", "value")


@query("SELECT source AS project, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def durable_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.delete(durable(spark, sf_dir), second(spark, sf_dir)).select("project", "key")


@query("SELECT source AS project, count(*) AS n_keys FROM documents WHERE source <> 'src3' GROUP BY source")
def durable_drop_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.key_counts(tiers.drop_project(durable(spark, sf_dir), "src3"))


@query(f"WITH {SECOND} SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, coalesce(s.value, text) AS value, CASE WHEN s.key IS NULL THEN 'durable' ELSE 'cache' END AS tier FROM documents d LEFT JOIN second s ON CAST(d.doc_id AS VARCHAR) = s.key AND d.source = s.project")
def tier_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = durable(spark, sf_dir)
    return tiers.fallback(held, second(spark, sf_dir), held).select("project", "key", "value", "tier")


@query(f"WITH {SECOND} SELECT CASE WHEN s.key IS NULL THEN 'miss' ELSE 'hit' END AS answer, count(*) AS n FROM documents d LEFT JOIN second s ON CAST(d.doc_id AS VARCHAR) = s.key AND d.source = s.project GROUP BY 1")
def tier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, held = durable(spark, sf_dir), second(spark, sf_dir)
    met = asked.select("project", "key").join(held.select("project", "key", F.lit(1).alias("hit")), ["project", "key"], "left")
    return met.groupBy(F.when(F.col("hit") == 1, "hit").otherwise("miss").alias("answer")).agg(F.count("*").alias("n"))


@query(f"WITH {SECOND} SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents WHERE source = 'src3' UNION ALL SELECT project, key, value FROM second WHERE project <> 'src3'")
def tier_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.restore(second(spark, sf_dir), durable(spark, sf_dir), "src3").select("project", "key", "value")


def _some_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of the durable tier, and as many that it doesn't hold."""
    keys = durable(spark, sf_dir).select("project", "key")
    return keys.unionByName(keys.select("project", F.concat(F.lit("no "), "key").alias("key")))


@query("SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, coalesce(text, 'none') AS value FROM documents UNION ALL SELECT source, 'no ' || doc_id, 'none' FROM documents")
def map_get_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.get(durable(spark, sf_dir), _some_keys(spark, sf_dir), default="none")


@query("SELECT source AS project, CAST(doc_id AS VARCHAR) AS key, true AS found FROM documents UNION ALL SELECT source, 'no ' || doc_id, false FROM documents")
def map_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.contains(durable(spark, sf_dir), _some_keys(spark, sf_dir))


@query("WITH firsts AS (SELECT source, min(doc_id) AS least FROM documents WHERE source <> 'src3' GROUP BY source) SELECT d.source AS project, CAST(doc_id AS VARCHAR) AS key, text AS value FROM documents d LEFT JOIN firsts f ON d.source = f.source WHERE least IS NULL OR doc_id <> least")
def durable_upsert_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a tier that holds one project: of each other one, the first write is lost."""
    rows = durable(spark, sf_dir)
    return tiers.upsert(tiers.find_project(rows, "src3"), rows, observed=True).select("project", "key", "value")


@query("SELECT source AS project, count(*) AS n_keys FROM documents GROUP BY source")
def project_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.key_counts(durable(spark, sf_dir))


# ---- JSON documents


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def json_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", jsondoc.get(F.col("props"), "k").alias("value"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' AS body FROM events""")
def json_update_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", jsondoc.update_value(F.col("props"), "type", F.col("event_type")).alias("body"))


@query("SELECT event_id, '{}' AS body FROM events")
def json_delete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", jsondoc.delete_key(F.col("props"), "k").alias("body"))


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of members of all types for each event; some are missing, some broken."""
    tags = F.array(F.col("event_type"), (F.col("event_id") % 10).cast("string"))
    inner = F.struct(F.col("event_id").alias("n"), F.array(F.col("event_id"), F.lit(2).cast("long")).alias("of"))
    body = F.to_json(F.struct(F.col("user_id").alias("id"), (F.col("event_id") % 2 == 0).alias("even"), F.col("event_type").alias("name"), tags.alias("tags"), inner.alias("inner")))
    body = F.when(F.col("event_id") % 11 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, F.lit("{broken")).otherwise(body)
    return _events(spark, sf_dir).select("event_id", "event_type", body.alias("body"))


def _mixed_sql(edited: str, missing: str) -> str:
    """The same documents with one member edited; missing is what becomes of a missing document."""
    members = {
        "id": "'\"id\":' || user_id", "even": "'\"even\":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END", "name": "'\"name\":\"' || event_type || '\"'",
        "tags": "'\"tags\":[\"' || event_type || '\",\"' || event_id % 10 || '\"]'", "inner": "'\"inner\":{\"n\":' || event_id || ',\"of\":[' || event_id || ',2]}'",
    }
    key, _, value = edited.partition("=")
    parts = [v for k, v in members.items() if k != key] + ([value] if value else [])
    joined = " || ',' || ".join(parts)
    return f"SELECT event_id, CASE WHEN event_id % 11 = 0 THEN {missing} WHEN event_id % 13 = 0 THEN '{{broken' ELSE '{{' || {joined} || '}}' END AS body FROM events"


@query(_mixed_sql("""name='"name":"' || event_id || '"'""", """'{"name":"' || event_id || '"}'"""))
def json_update_value_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.update_value(F.col("body"), "name", F.col("event_id").cast("string")).alias("body"))


@query(_mixed_sql("name='\"name\":' || event_id", "'{\"name\":' || event_id || '}'"))
def json_update_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.update_value(F.col("body"), "name", F.col("event_id")).alias("body"))


@query(_mixed_sql("even", "'{}'"))
def json_delete_key_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.delete_key(F.col("body"), "even").alias("body"))


@query(_mixed_sql("""tags='"tags":["z","' || event_type || '"]'""", """'{"tags":["z","' || event_type || '"]}'"""))
def json_write_array_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.write_array(F.col("body"), "tags", F.array(F.lit("z"), F.col("event_type"))).alias("body"))


@query(_mixed_sql("""tags='"tags":["' || event_type || '","' || event_id % 10 || '",' || event_id || ']'""", "'{\"tags\":[' || event_id || ']}'"))
def json_append_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.append_to_array(F.col("body"), "tags", F.col("event_id")).alias("body"))


@query(_mixed_sql("""tags='"tags":["' || event_id % 10 || '"]'""", "NULL"))
def json_remove_from_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir).select("event_id", jsondoc.remove_from_array(F.col("body"), "tags", F.lit(0)).alias("body"))


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 13 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 11 <> 0 AND event_id % 13 <> 0 THEN event_type END AS first FROM events")
def json_get_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = jsondoc.array(F.col("body"), "tags")
    return _mixed(spark, sf_dir).select("event_id", F.size(tags).alias("n"), F.get(tags, 0).alias("first"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document {"tokens": [...]} for each user, of event types in order."""
    held = lists_by_key(_events(spark, sf_dir), "user_id", "event_type", "event_id")
    return held.select("key", F.to_json(F.struct(F.col("value").alias("tokens"))).alias("body"), F.col("value").alias("items"))


BODIES = "bodies AS (SELECT CAST(user_id AS VARCHAR) AS key, list(event_type ORDER BY event_id) AS items FROM events GROUP BY user_id)"


@query(f"WITH {BODIES} SELECT key, unnest(items) AS token FROM bodies")
def json_token_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("key", F.explode(files.token_list(F.col("body"))).alias("token"))


def _items(c: Column) -> Column:
    return F.array_join(c, ",")


@query(f"WITH {BODIES} SELECT key, array_to_string(list_append(items, 'view'), ',') AS items, len(items) + 1 AS n FROM bodies")
def json_array_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files.token_list(F.col("body"))
    return _bodies(spark, sf_dir).select("key", _items(jsondoc.append(held, F.lit("view"))).alias("items"), jsondoc.append_size(held, F.lit("view")).cast("bigint").alias("n"))


@query(f"WITH {BODIES} SELECT key, array_to_string(items[1:2] || items[4:], ',') AS items FROM bodies")
def json_array_remove_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("key", _items(jsondoc.remove_at(files.token_list(F.col("body")), F.lit(2))).alias("items"))


@query(f"WITH {BODIES} SELECT key, array_to_string(items[1:1] || list_value('set') || items[3:], ',') AS items FROM bodies WHERE len(items) > 1")
def json_array_set_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = files.token_list(F.col("body"))
    return _bodies(spark, sf_dir).where(F.size(held) > 1).select("key", _items(jsondoc.set_at(held, F.lit(1), F.lit("set"))).alias("items"))


@query(f"WITH {BODIES} SELECT key, 2 * len(items) AS n FROM bodies")
def json_array_merge_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("key", jsondoc.merge_size(files.token_list(F.col("body")), F.col("items")).cast("bigint").alias("n"))


@query(f"""WITH {BODIES} SELECT key, '{{"tokens":["a","b"]}}' AS body FROM bodies""")
def json_write_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("key", jsondoc.write_array(F.col("body"), "tokens", F.array(F.lit("a"), F.lit("b"))).alias("body"))


# ---- hashes, shapes, messages, telemetry


@query("SELECT c_custkey, sha256(c_name || c_mktsegment) AS print FROM customer")
def fingerprint_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", security.fingerprint(F.col("c_name"), F.col("c_mktsegment")).alias("print"))


@query("SELECT c_custkey % 7 <> 0 AS verified, count(*) AS n FROM customer GROUP BY 1")
def password_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = session_commands(spark, sf_dir).where("verb = 'LIN'").select(F.col("arg").alias("group"), F.col("rest").alias("password"))
    return access.login(groups(spark, sf_dir), tries).groupBy("verified").agg(F.count("*").alias("n"))


HASHES = ", ".join(f"({k}, '{base64.b64encode(hashlib.sha512(f's{k}pw{k}'.encode()).digest()).decode()}')" for k in range(25))


@query(f"SELECT n_name AS \"group\", h AS access FROM nation JOIN (VALUES {HASHES}) t(k, h) ON k = n_nationkey")
def password_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, sf_dir).select("group", "access")


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS shaped FROM customer")
def token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.when(F.col("c_custkey") % 3 == 0, F.repeat(F.lit("aZ09"), F.lit(32))).when(F.col("c_custkey") % 3 == 1, F.sha2("c_name", 512)).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", security.token_shaped(short).alias("shaped"))


@query("SELECT c_custkey, c_custkey % 3 = 1 AS valid FROM customer")
def hex_token_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.when(F.col("c_custkey") % 3 == 0, F.repeat(F.lit("aZ09"), F.lit(32))).when(F.col("c_custkey") % 3 == 1, security.hardware_token(F.col("c_name"), F.col("c_mktsegment"))).otherwise(F.lit(None).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", security.hex_token_valid(token).alias("valid"))


@query("SELECT split_part(url, ':', 1) AS \"group\", substr(url, strpos(url, ':') + 1) AS password FROM pages")
def pawd_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_of = table(spark, sf_dir, "pages").select(F.explode(F.array("url", F.lit("no colon"))).alias("value"))
    return files.parse_passwords(lines_of)


@query("SELECT page_id, 'err: ' || split_part(url, ':', 1) || ' not found in cache or protobuff' AS reply FROM pages")
def key_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.missing(F.col("url")).alias("reply"))


@query("""WITH RECURSIVE log AS (SELECT event_id AS seq, user_id % 50 AS ip, event_type = 'error' AS closes, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM events),
run AS (SELECT ip, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS open, CAST(NULL AS BIGINT) AS seq, true AS admitted FROM (SELECT DISTINCT ip FROM log)
  UNION ALL SELECT l.ip, l.n, CASE WHEN closes THEN greatest(r.open - 1, 0) WHEN r.open >= 12 THEN r.open ELSE r.open + 1 END, l.seq, closes OR r.open < 12 FROM run r JOIN log l ON l.ip = r.ip AND l.n = r.n + 1)
SELECT seq, open, admitted FROM run WHERE seq IS NOT NULL""")
def ip_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), (F.col("user_id") % 50).cast("string").alias("ip"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("delta"))
    return telemetry.admission(rows).select("seq", "open", "admitted")


@query("SELECT CAST(c AS BIGINT) AS cores, CAST(ceil(c * 0.7::DOUBLE) + ceil(c * 0.3::DOUBLE * 4) AS BIGINT) AS size, CAST(ceil(c * 1.5::DOUBLE) AS BIGINT) AS waiting, CAST(c + 1 AS BIGINT) AS computing FROM range(1, 65) t(c)")
def thread_pool_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = F.col("id").alias("cores")
    threads = lambda io: sizing.ideal_threads(F.col("id"), F.lit(io), F.lit(0.5))
    return spark.range(1, 65).select(cores, sizing.pool_size(F.col("id"), F.lit(0.7), F.lit(0.3)).alias("size"), threads(True).alias("waiting"), threads(False).alias("computing"))


MESSAGES = {"en": {"greet": "Hello <name>, you are in <place>.", "bye": ["Bye <name>", "See you"]}, "fr": {"greet": "Bonjour <name> de <place>.", "bye": ["Au revoir <name>"]}}


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Hello ' || c_name || ', you are in ' || n_name || '.' ELSE 'Bonjour ' || c_name || ' de ' || n_name || '.' END AS message FROM customer JOIN nation ON c_nationkey = n_nationkey")
def message_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("lang", F.when(F.col("c_custkey") % 2 == 0, "en").otherwise("fr"))
    said = files.message_table(spark, MESSAGES).where("key = 'greet' and ord = 0")
    return who.join(said, "lang").select("c_custkey", text.fill(F.col("template"), {"name": F.col("c_name"), "place": F.col("n_name")}).alias("message"))


@query("SELECT lang, lang IN ('tr', 'fi', 'en', 'fr', 'de', 'da', 'el', 'es') AS supported, count(*) AS n FROM documents GROUP BY lang")
def language_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.col("lang").isin(*LANGUAGES).alias("supported"), "n")


# The languages that messages come in.
LANGUAGES = ("tr", "fi", "en", "fr", "de", "da", "el", "es")


@query(f"WITH {LAST}, c AS ({LIVE_D}) SELECT project, key, value FROM c")
def wire_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The durable tier through the wire format and back."""
    return wire.decode_messages(wire.encode_projects(fold.live(fold.state(commands(spark, sf_dir)), "de")))


@query(f"WITH {EFF} SELECT seq, project, key, coalesce(cached, durable) AS value FROM got WHERE verb = 'GET'")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookups, answered by a stream over the log in one run."""
    from kvlake.streaming import fold as stream

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kvlake-")
    top = f"{base}/stream/{uuid.uuid4().hex}"
    commands(spark, sf_dir).drop("flag").write.parquet(f"{top}/log")
    schema = json.loads(spark.read.parquet(f"{top}/log").schema.json())
    from pyspark.sql.types import StructType

    stream.start(spark.readStream.schema(StructType.fromJson(schema)).parquet(f"{top}/log"), top).awaitTermination()
    return stream.answers(spark, top).where("verb = 'GET'").select("seq", "project", "key", "value")
