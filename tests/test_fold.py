"""Golden cases and a sequential simulator against the fold."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake.client import Client, NotAuthenticated
from kvlake.functions import text
from kvlake.operators import fold
from kvlake.sources.files import parse_commands

SCHEMA = "seq long, session string, project string, verb string, key string, value string, flags array<string>"


def simulate(log):
    """Command by command on two dictionaries."""
    cache, durable, out = {}, {}, {}
    for seq, _, project, verb, key, value, flags in log:
        at = (project, key)
        if verb in ("GET", "HEAVEN"):
            first, then = (durable, cache) if flags == ["-&from-protobuff"] else (cache, durable)
            out[seq] = first.get(at, then.get(at))
            if verb == "HEAVEN":
                cache.clear()
        elif verb in ("SET", "UPDATE") and value is None:
            continue
        elif verb == "SET":
            cache[at] = value
            if "-&save" in flags:
                durable[at] = value
        elif verb == "UPDATE":
            cache[at] = value
        elif verb == "DEL":
            if "-&cache" in flags or "-&protobuff" not in flags:
                cache.pop(at, None)
            if "-&cache" not in flags:
                durable.pop(at, None)
    return out, cache, durable


def random_log(seed, n=400):
    rng = random.Random(seed)
    log = []
    for seq in range(n):
        verb = rng.choices(["GET", "SET", "UPDATE", "DEL", "HEAVEN"], [6, 5, 2, 3, 1])[0]
        flags = {"GET": ["", "-&from-protobuff"], "SET": ["", "-&save"], "DEL": ["", "-&cache", "-&protobuff"]}.get(verb, [""])
        flag = rng.choice(flags)
        value = f"v{seq}" if rng.random() < 0.8 else None
        log.append((seq, "s", f"p{rng.randrange(2)}", verb, f"k{rng.randrange(6)}", value, [flag] if flag else []))
    return log


@pytest.mark.parametrize("few, span", [(256, 1_000_000), (0, 37)])
def test_fold_is_the_simulation(spark, few, span, monkeypatch):
    plain = fold.last_barrier
    monkeypatch.setattr(fold, "last_barrier", lambda rows: plain(rows, few, span))
    monkeypatch.setattr(fold, "SPAN", span)
    for seed in range(3):
        log = random_log(seed)
        out, cache, durable = simulate(log)
        rows = spark.createDataFrame(log, SCHEMA)
        assert {r["seq"]: r["value"] for r in fold.answers(rows).collect()} == out
        state = fold.state(rows)
        assert {(r["project"], r["key"]): r["value"] for r in fold.live(state, "ce").collect()} == cache
        assert {(r["project"], r["key"]): r["value"] for r in fold.live(state, "de").collect()} == durable
        halves = fold.advance(fold.state(rows.where("seq < 200")), rows.where("seq >= 200"))
        assert {(r["project"], r["key"]): r["value"] for r in fold.live(halves, "ce").collect()} == cache


def test_golden_session(spark):
    c = Client(spark)
    with pytest.raises(NotAuthenticated):
        c.get("x")
    c.authenticate("P")
    c.set("key1", "value1")
    assert c.get("key1").data == "value1"
    c.update("key1", "newValue1")
    c.update("absent", "v")
    c.set("a", "x", "-&save")
    c.delete("a", "-&cache")
    assert [c.get(k).data for k in ("key1", "absent", "a")] == ["newValue1", "v", "x"]
    c.send("DELETE a")
    assert c.get("a") == (False, "err: a not found in cache or protobuff", None)
    assert c.get("todo:1").message == "err: todo not found in cache or protobuff"


def test_values_keep_and_lose_blanks(spark):
    lines = spark.createDataFrame([(0, "s", "SET k a  b  "), (1, "s", "GET k"), (2, "s", "UPDATE k a  b  "), (3, "s", "GET k"), (4, "s", "SET k x -&save"), (5, "s", "GET k"), (6, "s", "HEAVEN"), (7, "s", "GET k")], "seq long, session string, line string")
    rows = parse_commands(lines).withColumn("project", F.lit("P"))
    said = {r["seq"]: r["value"] for r in fold.answers(rows).collect()}
    assert said == {1: "a  b", 3: "a  b  ", 5: "x", 7: "x"}
    assert fold.answers(rows, observed=True).where("seq = 5").first()["value"] == "x -&save"
    assert {r["seq"]: r["status"] for r in fold.replies(rows).collect()}[6] == "error"


def test_commands_with_too_few_parts_say_how_they_are_used(spark):
    lines = spark.createDataFrame([(0, "s", "SET k v1"), (1, "s", "SET k"), (2, "s", "UPDATE k"), (3, "s", "GET k"), (4, "s", "set k "), (5, "s", "GET k"), (6, "s", "DEL"), (7, "s", "PING")], "seq long, session string, line string")
    rows = parse_commands(lines).withColumn("project", F.lit("P"))
    assert {r["seq"]: r["value"] for r in fold.answers(rows).collect()} == {3: "v1", 5: ""}
    said = {r["seq"]: r["reply"] for r in fold.replies(rows).collect()}
    assert said == {0: "Ok (Cache)", 1: text.USAGE["SET"], 2: text.USAGE["UPDATE"], 4: "Ok (Cache)", 6: text.USAGE["DEL"], 7: "ERROR: Unknown command"}


def test_empty_log(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert fold.answers(rows).count() == 0 and fold.state(rows).count() == 0
