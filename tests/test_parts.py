"""Sources, streaming, access and the plain functions."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions import anyvalue, security, sizing, text
from kvlake.operators import access, jsondoc, telemetry, tiers
from kvlake.operators.keyed import Keyed
from kvlake.plans.queries import commands, stream_fold
from kvlake.sources import files, wire

SF = "/root/testdata/sf0.001"


def test_wire_source_reads_what_the_codec_wrote(spark, tmp_path):
    tier = spark.createDataFrame([("P", "k:1", "é"), ("P", "k2", ""), ("Q", "a", "x" * 300)], "project string, key string, value string")
    body = b"".join(bytes(r["body"]) for r in wire.encode_projects(tier).collect())
    (tmp_path / "db.bin").write_bytes(body)
    spark.dataSource.register(wire.WireSource)
    back = spark.read.format("kvwire").load(str(tmp_path / "db.bin"))
    assert wire.row_hash(back).first() == wire.row_hash(tier).first()
    assert wire.row_hash(wire.read_files(spark, str(tmp_path))).first() == wire.row_hash(tier).first()
    parts = [body, b"", body * 3]
    assert list(wire.split_delimited(wire.delimited(parts))) == parts and list(wire.decode(body + body)) == list(wire.decode(body)) * 2
    with pytest.raises(ValueError):
        list(wire.split_delimited(wire.delimited(parts)[:-1]))
    with pytest.raises(ValueError):
        list(wire.decode(body[:-1]))


def test_stream_equals_batch(spark):
    from kvlake.operators import fold

    batch = {r["seq"]: r["value"] for r in fold.answers(commands(spark, SF)).where("verb = 'GET'").collect()}
    assert {r["seq"]: r["value"] for r in stream_fold(spark, SF).collect()} == batch


def test_stream_in_several_batches(spark, tmp_path):
    from kvlake.operators import fold
    from kvlake.streaming import fold as stream

    log = commands(spark, SF).drop("flag")
    step = stream.folder(str(tmp_path))
    for i in range(4):
        step(log.where((F.col("seq") >= i * 250) & (F.col("seq") < (i + 1) * 250)), i)
    batch = {(r["seq"], r["verb"]): r["value"] for r in fold.answers(log).collect()}
    assert {(r["seq"], r["verb"]): r["value"] for r in stream.answers(spark, str(tmp_path)).collect()} == batch
    step(log.where("seq = 3"), 4)
    assert spark.read.parquet(f"{tmp_path}/late/4").count() == 1


def test_hashes_and_shapes(spark):
    row = spark.range(1).select(security.password_hash(F.lit("salt"), F.lit("word")).alias("h"), security.mac_text(F.unhex(F.lit("0a1bff"))).alias("m")).first()
    assert row["h"] == base64.b64encode(hashlib.sha512(b"saltword").digest()).decode()
    assert row["m"] == "0A:1B:FF"
    assert len(security.new_token()) == 128 and security.new_token().isalnum()


def test_sizes(spark):
    assert spark.range(1).select(sizing.pool_size(F.lit(12), F.lit(0.7), F.lit(0.3)).alias("n")).first()["n"] == 24


def test_json_edges(spark):
    rows = spark.createDataFrame([('{"tokens":["a"]}',), ("broken",), (None,)], "body string")
    got = [r["n"] for r in rows.select(jsondoc.append_size(files.token_list(F.col("body")), F.lit("a")).alias("n")).collect()]
    assert got == [2, 1, 1]
    two = F.array(F.lit("a"), F.lit("b"))
    assert spark.range(1).select(jsondoc.remove_at(two, F.lit(5)).alias("x")).first()["x"] == ["a", "b"]
    assert [r["x"] for r in rows.select(jsondoc.array(F.col("body"), "tokens").alias("x")).collect()] == [["a"], [], []]


def test_json_edits_keep_types_and_other_members(spark):
    body = '{"a":1,"o":{"p":[1]},"t":true,"z":null,"s":"x\\"y","l":["u",2]}'
    rows = spark.createDataFrame([(0, body), (1, "broken"), (2, None), (3, "[1]")], "i int, body string")
    held = lambda c: [r["x"] for r in rows.select("i", c.alias("x")).orderBy("i").collect()]
    b = F.col("body")
    assert held(jsondoc.update_value(b, "a", F.lit("n"))) == ['{"o":{"p":[1]},"t":true,"z":null,"s":"x\\"y","l":["u",2],"a":"n"}', "broken", '{"a":"n"}', "[1]"]
    assert held(jsondoc.update_value(b, "q", F.lit(2.5)))[0] == body[:-1] + ',"q":2.5}'
    assert held(jsondoc.delete_key(b, "o"))[:3] == ['{"a":1,"t":true,"z":null,"s":"x\\"y","l":["u",2]}', "broken", "{}"]
    assert held(jsondoc.write_array(b, "l", F.array(F.lit(1))))[0] == body.replace('["u",2]', "[1]")
    assert held(jsondoc.append_to_array(b, "l", F.lit(True)))[:3] == [body.replace('["u",2]', '["u",2,true]'), "broken", '{"l":[true]}']
    assert held(jsondoc.append_to_array(b, "a", F.lit("x")))[0] == body
    assert held(jsondoc.remove_from_array(b, "l", F.lit(0)))[0] == body.replace('["u",2]', "[2]")
    assert held(jsondoc.remove_from_array(b, "l", F.lit(2))) == [body, "broken", None, "[1]"]
    assert held(jsondoc.array(b, "l")) == [["u", "2"], [], [], []]
    assert held(jsondoc.pretty(b))[1:] == ["broken", "{ }", "[1]"] and len(held(jsondoc.pretty(b))[0].splitlines()) > 5


def test_values_of_any_type(spark):
    rows = spark.createDataFrame([("1",), ('"x"',), ("true",), ("[1]",), ("{}",), ("null",), ("1.5",)], "j string").select(F.parse_json("j").alias("v"))
    assert [r["k"] for r in rows.select(anyvalue.kind("v").alias("k")).collect()] == ["number", "string", "boolean", "list", "object", "null", "number"]
    assert [r["x"] for r in rows.select(anyvalue.get_as("v", "number").alias("x")).collect()] == [1.0, None, None, None, None, None, 1.5]
    with pytest.raises(Exception, match="Value is not a list"):
        rows.select(anyvalue.get_as("v", "list", strict=True)).collect()


def test_admission_follows_the_rule(spark):
    rng, log, open_, want = random.Random(1), [], 0, []
    for seq in range(400):
        attempt = rng.random() < (0.8 if seq // 40 % 2 else 0.3)
        if attempt:
            want.append((seq, min(open_ + 1, 12), open_ < 12))
            open_ = min(open_ + 1, 12)
        elif open_:
            open_ -= 1
            want.append((seq, open_, True))
        else:
            continue
        log.append((seq, "a", 1 if attempt else -1))
    rows = telemetry.admission(spark.createDataFrame(log, "seq long, ip string, delta int"))
    assert sorted((r["seq"], r["open"], r["admitted"]) for r in rows.collect()) == want
    early = telemetry.admission(spark.createDataFrame([(0, "a", -1), (1, "a", 1), (2, "a", -1)], "seq long, ip string, delta int"))
    assert [r["open"] for r in early.orderBy("seq").collect()] == [0, 1, 0]


def test_settings_and_password_stores(spark):
    held = spark.createDataFrame([("g", "salt", "a"), ("g", "unix", "1")], "section string, key string, value string")
    wanted = spark.createDataFrame([("g", "salt", "b"), ("h", "salt", "c")], "section string, key string, value string")
    assert sorted(map(tuple, access.set_settings(held, wanted).collect())) == [("g", "salt", "b"), ("g", "unix", "1"), ("h", "salt", "c")]
    assert sorted(map(tuple, access.set_settings(held, wanted, only_present=True).collect())) == [("g", "salt", "b"), ("g", "unix", "1")]
    store = spark.createDataFrame([("g", "x"), ("h", "y")], "group string, password string")
    new = spark.createDataFrame([("g", "z")], "group string, password string")
    assert sorted(map(tuple, access.put_passwords(store, new).collect())) == [("g", "z"), ("h", "y")]
    assert sorted(map(tuple, access.put_passwords(store, new, loaded=False).collect())) == [("g", "z")]
    assert access.burn(store).count() == 0


def test_passwords_and_log_lines(spark):
    lines = spark.createDataFrame([("g:a:b==",), ("bad",)], "value string")
    assert [tuple(r) for r in files.parse_passwords(lines).collect()] == [("g", "a:b==")]
    log = spark.createDataFrame([("x [CLIENT] /1.2.3.4 action: SET a b c",), ("started",)], "value string")
    assert [tuple(r) for r in files.parse_log(log).collect()] == [("/1.2.3.4", "SET a b c")]


def test_observed_modes(spark):
    held = Keyed(spark.createDataFrame([(["item1", "item2"], "value1")], "key array<string>, value string"), "list_key")
    asked = spark.createDataFrame([(["item1", "item2"],), (["item2", "item1"],)], "key array<string>")
    assert sorted(r["value"] for r in held.get(asked).collect()) == ["null", "value1"]
    assert [r["found"] for r in held.exists(asked, observed=True).collect()] == [False, False]
    groups = spark.createDataFrame([("g", ["a", "b"])], "group string, accessibility array<string>")
    ask = spark.createDataFrame([("g", "a")], "group string, token string")
    assert access.can_access(groups, ask).first()["allowed"] and not access.can_access(groups, ask, observed=True).first()["allowed"]
    q = spark.createDataFrame([("o", 1)], "owner string, t int")
    assert access.quota(q, "owner", 5).first()["able"] and not access.quota(q, "owner", 5, observed=True).first()["able"]


def test_new_group_and_login(spark):
    groups = spark.createDataFrame([], "group string, salt string, access string, hash string, unix long, accessibility array<string>")
    new = lambda *row: spark.createDataFrame([row], "group string, salt string, password string, unix long")
    groups = access.create(access.create(groups, new("g", "s", "pw", 1)), new("g", "t", "other", 2))
    assert groups.count() == 1
    assert {r["group"]: r["found"] for r in access.exists(groups, spark.createDataFrame([("g",), ("h",)], "group string")).collect()} == {"g": True, "h": False}
    tries = spark.createDataFrame([("g", "pw"), ("g", "no"), ("h", "pw")], "group string, password string")
    assert sorted(r["verified"] for r in access.login(groups, tries).collect()) == [False, False, True]


def test_first_write_to_a_new_project_is_lost_as_observed(spark):
    tier = spark.createDataFrame([("P", "k", "v", 1)], "project string, key string, value string, seq long")
    rows = spark.createDataFrame([("P", "k", "w", 2), ("Q", "a", "x", 3), ("Q", "b", "y", 4)], "project string, key string, value string, seq long")
    held = lambda t: sorted((r["project"], r["key"], r["value"]) for r in t.collect())
    assert held(tiers.upsert(tier, rows)) == [("P", "k", "w"), ("Q", "a", "x"), ("Q", "b", "y")]
    assert held(tiers.upsert(tier, rows, observed=True)) == [("P", "k", "w"), ("Q", "b", "y")]
    asked = spark.createDataFrame([("P", "k"), ("P", "z")], "project string, key string")
    assert held(tiers.get(tier, asked, default="none")) == [("P", "k", "v"), ("P", "z", "none")]
    with pytest.raises(Exception, match="no such key: z"):
        tiers.get(tier, asked, strict=True).collect()


def test_snapshot_is_partitioned(spark, tmp_path):
    tier = spark.createDataFrame([("P", "k", "v", 1), ("Q", "k", "w", 2)], "project string, key string, value string, seq long")
    tiers.write_snapshot(tier, str(tmp_path / "s"))
    assert tiers.find_project(tiers.read_snapshot(spark, str(tmp_path / "s")), "P").count() == 1


def test_frame_rejects_other_levels(spark):
    with pytest.raises(Exception, match="unknown level"):
        spark.range(1).select(text.frame(F.lit(7), F.lit("d"), F.lit("m"))).collect()
