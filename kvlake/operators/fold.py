"""The fold of a command log: what each lookup answers, and what each tier holds in the end.

A command row has seq (a total order), project, verb, key, value and flags. Each row has an effect on the volatile tier (ce) and on the
durable tier (de): a struct of seq, kept (false for a deletion) and value, or null for none; a write without a value has none, nor has
any command without a key. The barrier verb clears the volatile tier of
all projects; it is no effect on any key but a number on each row: the seq of the last barrier before it. A volatile effect counts for a
lookup only if it is younger than that. So one exchange by (project, key, span of seq) and one sort serve both tiers, whatever the number
of barriers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions import text

BARRIER = "HEAVEN"
#: Up to so many barriers are sent to all tasks as one array; beyond that they are carried along the log by spans of seq.
FEW_BARRIERS = 256
#: Length of those spans.
SPAN = 1_000_000


def last_barrier(commands: DataFrame, few: int = FEW_BARRIERS, span: int = SPAN) -> DataFrame:
    """commands with barrier: the seq of the last barrier before each row, the row's own not counted; null if there is none."""
    barriers = commands.where((F.col("verb") == BARRIER) & F.col("key").isNotNull()).select("seq")
    some = [r["seq"] for r in barriers.limit(few + 1).collect()]
    if len(some) <= few:
        held = F.array(*[F.lit(s).cast("bigint") for s in sorted(some)]) if some else F.array().cast("array<bigint>")
        return commands.withColumn("barrier", F.array_max(F.filter(held, lambda s: s < F.col("seq"))))
    number = F.floor(F.col("seq") / span)
    by_span = barriers.groupBy(number.alias("span")).agg(F.max("seq").alias("top"))
    spans = commands.select(number.alias("span")).distinct().join(by_span, "span", "left")
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row a span
    carried = spans.select("span", F.max("top").over(before).alias("carried"))
    own = F.when((F.col("verb") == BARRIER) & F.col("key").isNotNull(), F.col("seq"))
    within = Window.partitionBy("span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = commands.withColumn("span", number).withColumn("within", F.max(own).over(within))
    return rows.join(carried, "span").withColumn("barrier", F.greatest("within", "carried")).drop("span", "within", "carried")


def effects(commands: DataFrame, observed: bool = False) -> DataFrame:
    """commands with ce and de."""
    verb, flags = F.col("verb"), F.col("flags")
    only_cache = text.has_flag(flags, "-&cache")
    only_durable = ~only_cache & text.has_flag(flags, "-&protobuff")
    put = lambda v: F.struct("seq", F.lit(True).alias("kept"), v.alias("value"))
    gone = F.struct("seq", F.lit(False).alias("kept"), F.lit(None).cast("string").alias("value"))
    stored = text.stored_value(F.col("value"), observed)
    has_key, has_value = F.col("key").isNotNull(), F.col("key").isNotNull() & F.col("value").isNotNull()
    ce = F.when(has_value & (verb == "SET"), put(stored)).when(has_value & (verb == "UPDATE"), put(F.col("value"))).when(has_key & (verb == "DEL") & ~only_durable, gone)
    de = F.when(has_value & (verb == "SET") & text.has_flag(flags, "-&save", "-&protobuff"), put(stored)).when(has_key & (verb == "DEL") & ~only_cache, gone)
    return commands.withColumn("ce", ce).withColumn("de", de)


def lookups(commands: DataFrame, observed: bool = False) -> DataFrame:
    """seq, project, verb, key, flags, cached, durable of each GET, and of each barrier for the key it names, as of just before it."""
    return lookups_from(last_barrier(effects(commands, observed)))


def lookups_from(rows: DataFrame, span: int | None = None) -> DataFrame:
    """The same, from rows with effects and barriers.

    A key's history is cut into spans of seq, so that a key with a large share of all rows is many tasks' work: the last effects of each
    span are aggregated, and carried over spans, a row for each. Rows then look within their own span first.
    """
    on = ["project", "key", "span"]
    rows = rows.where(F.col("key").isNotNull()).withColumn("span", F.floor(F.col("seq") / (span or SPAN)))
    tops = rows.where(F.col("ce").isNotNull() | F.col("de").isNotNull() | F.col("verb").isin("GET", BARRIER)).groupBy(*on).agg(F.max("ce").alias("ce"), F.max("de").alias("de"))
    earlier = Window.partitionBy("project", "key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*(F.col(c).alias(f"of_{c}") for c in on), F.max("ce").over(earlier).alias("pc"), F.max("de").over(earlier).alias("pd"))
    before = Window.partitionBy(*on).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("lc", F.last("ce", True).over(before)).withColumn("ld", F.last("de", True).over(before))
    rows = rows.where(F.col("verb").isin("GET", BARRIER))
    same = F.col("project").eqNullSafe(F.col("of_project")) & (F.col("key") == F.col("of_key")) & (F.col("span") == F.col("of_span"))
    rows = rows.join(carried, same, "left").withColumn("lc", F.coalesce("lc", "pc")).withColumn("ld", F.coalesce("ld", "pd"))
    fresh = F.col("lc.seq") > F.coalesce("barrier", F.lit(-1))
    return rows.select("seq", "project", "verb", "key", "flags", F.when(fresh, F.col("lc.value")).alias("cached"), F.col("ld.value").alias("durable"))


def answer(found: DataFrame) -> Column:
    """The value that a lookup answers with: the volatile tier first, unless it asks for the durable one (and for neither of the others)."""
    flags = F.col("flags")
    durable_first = text.has_flag(flags, "-&from-protobuff") & ~text.has_flag(flags, "-&from-cache", "-&asa-json")
    return F.when(durable_first, F.coalesce("durable", "cached")).otherwise(F.coalesce("cached", "durable"))


def answers(commands: DataFrame, observed: bool = False) -> DataFrame:
    """seq, project, verb, key, value (null on a miss) and reply of each lookup."""
    return answers_from(last_barrier(effects(commands, observed)), observed)


def answers_from(rows: DataFrame, observed: bool = False) -> DataFrame:
    """The same, from rows with effects and barriers."""
    found = lookups_from(rows)
    found = found.withColumn("value", answer(found))
    as_json = text.has_flag(F.col("flags"), "-&asa-json") & ~text.has_flag(F.col("flags"), "-&from-cache")
    reply = F.when(F.col("value").isNull(), text.missing(F.col("key"))).when(as_json, text.json_reply(F.col("key"), F.col("value"), observed)).otherwise(F.col("value"))
    return found.select("seq", "project", "verb", "key", "value", reply.alias("reply"))


def state(commands: DataFrame, observed: bool = False) -> DataFrame:
    """project, key, ce, de: the last effect on each tier, by partial aggregation alone; ce is null where a barrier came later."""
    rows = effects(commands, observed)
    top = commands.where((F.col("verb") == BARRIER) & F.col("key").isNotNull()).agg(F.max("seq").alias("top"))
    last = rows.where(F.col("ce").isNotNull() | F.col("de").isNotNull()).groupBy("project", "key").agg(F.max("ce").alias("ce"), F.max("de").alias("de"))
    young = F.col("ce.seq") > F.coalesce("top", F.lit(-1))
    return last.crossJoin(F.broadcast(top)).select("project", "key", F.when(young, F.col("ce")).alias("ce"), "de")


def live(states: DataFrame, tier: str) -> DataFrame:
    """project, key, value, seq of the keys that a tier holds; tier is ce or de."""
    return states.where(F.col(f"{tier}.kept")).select("project", "key", F.col(f"{tier}.value").alias("value"), F.col(f"{tier}.seq").alias("seq"))


def advance(states: DataFrame, commands: DataFrame, observed: bool = False) -> DataFrame:
    """The state after more commands, all of them younger than the state."""
    more = state(commands, observed).select("project", "key", F.col("ce").alias("new_ce"), F.col("de").alias("new_de"))
    top = commands.where((F.col("verb") == BARRIER) & F.col("key").isNotNull()).agg(F.max("seq").alias("top"))
    both = states.join(more, ["project", "key"], "full").crossJoin(F.broadcast(top))
    kept = F.when(F.col("ce.seq") > F.coalesce("top", F.lit(-1)), F.col("ce"))
    return both.select("project", "key", F.coalesce("new_ce", kept).alias("ce"), F.coalesce("new_de", "de").alias("de"))


def replies(commands: DataFrame) -> DataFrame:
    """seq, status, reply of every row that has no lookup: writes, deletions, malformed and unknown commands."""
    verb, flags = F.col("verb"), F.col("flags")
    save = text.has_flag(flags, "-&save", "-&protobuff")
    said = F.when(save & text.has_flag(flags, "-&cache"), "Ok (Cache, Protobuf)").when(save, "Ok (Protobuf)").otherwise("Ok (Cache)")
    deleted = F.when(text.has_flag(flags, "-&cache"), "Ok (Cache).").when(text.has_flag(flags, "-&protobuff"), "Ok (Protobuf).").otherwise("Ok (Cache,Protobuf).")
    known = verb.isin("GET", "SET", "DEL", "UPDATE", BARRIER)
    bad = F.col("key").isNull() | (verb.isin("SET", "UPDATE") & F.col("value").isNull())
    usage = F.element_at(F.create_map(*[F.lit(x) for pair in text.USAGE.items() for x in pair]), verb)
    reply = F.when(~known, "ERROR: Unknown command").when(bad, usage).when(verb == "SET", said).when(verb == "DEL", deleted).otherwise("Ok.")
    return commands.where(verb != "GET").select("seq", "verb", F.when(~known | bad, "error").otherwise("ok").alias("status"), reply.alias("reply"))


def drop_dead_sessions(commands: DataFrame) -> DataFrame:
    """As observed, a command without its argument ends its session: later rows of the session have no effect."""
    fatal = F.col("key").isNull().cast("int")
    before = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return commands.withColumn("dead", F.coalesce(F.max(fatal).over(before), F.lit(0))).where("dead = 0").drop("dead")
