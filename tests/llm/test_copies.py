"""Operators 1, 2, 5 and 8 against their plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvlake.llm import induced, lines, passages, setjoin, substrings
from kvlake.llm.induced import CAP
from tests.llm import brute

TEXTS = brute.documents()
IDS = [None, *range(1, len(TEXTS))]


def by_id(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("lot_bytes", [substrings.LOT_BYTES, 1])
def test_substrings(spark, lot_bytes, monkeypatch):
    monkeypatch.setattr(substrings, "LOT_BYTES", lot_bytes)
    got = substrings.dedup(brute.frame(spark, TEXTS, IDS)).collect()
    assert by_id(got) == by_id((i, *x) for i, x in zip(IDS, brute.substrings(TEXTS), strict=True))


def test_passages(spark):
    got = passages.dedup(brute.frame(spark, TEXTS, IDS)).collect()
    assert by_id(got) == by_id((i, *x) for i, x in zip(IDS, brute.passages(TEXTS), strict=True))


def test_groups(spark):
    got = setjoin.groups(brute.frame(spark, TEXTS, IDS)).drop("rid").collect()
    assert by_id(got) == by_id((i, *x) for i, x in zip(IDS, brute.components(TEXTS, IDS), strict=True))


@pytest.mark.parametrize("seed, open_pairs", [(5, 4), (6, 0)])
def test_groups_of_short_texts_and_chains(spark, seed, open_pairs, monkeypatch):
    """Chains of near copies, and sets around the boundary between light and heavy ones; with and without drawn partners."""
    monkeypatch.setattr(setjoin, "OPEN_PAIRS", open_pairs)
    rng = random.Random(seed)
    texts = []
    for size in (1, 3, 6, 9, 10, 12, 14, 16, 20, 30, 60):
        base = [f"w{rng.randrange(40)}" for _ in range(size)]
        for _ in range(10):
            base = list(base)
            base[rng.choice([0, -1])] = f"w{rng.randrange(40)}"
            texts.append(" ".join(base if rng.random() < 0.8 else [*base, "tail"]))
    ids = list(range(100, 100 + len(texts)))
    got = setjoin.groups(brute.frame(spark, texts, ids)).drop("rid").collect()
    assert by_id(got) == by_id((i, *x) for i, x in zip(ids, brute.components(texts, ids), strict=True))


def test_one_of_each_keeps_columns_and_drops_equal_rows(spark):
    docs = brute.frame(spark, [TEXTS[12], TEXTS[12], TEXTS[13], "", None], [3, 3, 4, 5, 6])
    out = setjoin.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 4, 5, 6]


def test_one_of_each_keeps_rows_without_words(spark):
    """Rows without words stay, repeated or not, whether or not rows with words are repeated."""
    word = " ".join(f"w{i}" for i in range(30))
    for more in ([], [word]):
        texts = ["", "", " \n", None, None, word, *more]
        docs = brute.frame(spark, texts, [5, 5, 5, 6, 6, 7, *([7] * len(more))]).withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
        assert sorted(r["doc_id"] for r in setjoin.one_of_each(docs).collect()) == [5, 5, 5, 6, 6, 7]


def test_one_of_each_tells_groups_apart_without_ids(spark):
    """Unrelated texts of null ids, unrelated texts of one id, and near copies of null ids."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = [text(0), text(1), text(2), text(3), text(4), text(5), text(5) + " end", text(6), text(6) + " end", ""]
    ids = [None, None, None, 7, 7, None, None, 8, 9, None]
    left = [r["text"] for r in setjoin.one_of_each(brute.frame(spark, texts, ids)).collect()]
    assert sorted(t for t in left if t not in texts[5:7]) == sorted([*texts[:5], texts[7], ""])
    assert len([t for t in left if t in texts[5:7]]) == 1


def test_boundary_follows_cost():
    assert setjoin.choose_boundary({}) == 0
    assert setjoin.choose_boundary({4: 1000}) >= 4
    assert setjoin.choose_boundary({4: 10, 12: 100_000}) < 12


def test_lines(spark):
    rng = random.Random(2)
    pool = [f"line {i} " + "x" * rng.randrange(60) for i in range(12)] + [""]
    texts = [None, "", "a\n\nb", *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(40))]
    texts += ["\n".join(pool[:9]), "\n".join(["q", *pool[:9]]), texts[5], "\n".join("x" * 22 for _ in range(3)), "\n".join(["a", *["x" * 22] * 3])]
    ids = [None, *range(1, len(texts))]
    got = {(r["row"]["doc_id"]): r["kept"] for r in lines.dedup(brute.frame(spark, texts, ids)).collect()}
    assert got == dict(zip(ids, brute.lines(texts, ids), strict=True))


def test_lines_of_all_lengths(spark):
    rng = random.Random(7)
    blocks = [[f"{k} {i} " + "y" * n for i in range(m)] for k, (m, n) in enumerate([(3, 18), (7, 8), (15, 2), (5, 11), (12, 40), (2, 20)])]
    blocks.append(["z" * 60, *"abcdefghij", *[""] * 9, "q"])
    texts = ["\n".join(b) for b in blocks] + ["\n".join(["own", *b, "end"]) for b in blocks] + ["\n".join([*b[1:], *b]) for b in blocks]
    pool = ["", "a", "bc", "x" * 12, "y" * 17, "z" * 24, "w" * 55]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(30)]
    ids = list(range(len(texts)))
    got = {r["row"]["doc_id"]: r["kept"] for r in lines.dedup(brute.frame(spark, texts, ids)).collect()}
    assert got == dict(zip(ids, brute.lines(texts, ids), strict=True))
    assert got[7] == "own\nend"


@pytest.mark.parametrize("f", [substrings.dedup, passages.dedup, setjoin.groups, setjoin.one_of_each, lines.dedup])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], brute.SCHEMA)).count() == 0


def test_rows_repeated_in_full(spark):
    docs = brute.frame(spark, [" ".join(f"word{i}" for i in range(60))] * 2, [7, 7])
    assert [r["n_removed"] == r["n_words"] for r in passages.dedup(docs).collect()] == [True, True]
    assert [r["n_bytes"] == r["n_removed"] for r in substrings.dedup(docs).collect()] == [True, True]
    assert [r["n_removed"] for r in lines.dedup(docs).collect()] == [0, 0]


def suffix_array(held):
    """Suffixes in order, and how many letters (up to CAP) each shares with the one before it."""
    n = len(held)
    order = sorted(range(n), key=lambda i: held[i:])
    shared = lambda a, b: next((x for x in range(CAP) if max(a, b) + x >= n or held[a + x] != held[b + x]), CAP)
    return order, [0, *(shared(a, b) for a, b in zip(order, order[1:], strict=False))]


@pytest.mark.parametrize("few_names, chunk, doubling", [(1_024, 1 << 17, 64), (1_024, 1 << 17, 10**9), (2, 7, 10**9), (3, 64, 10**9)])
def test_suffixes(few_names, chunk, doubling, monkeypatch):
    """In memory and with queues on disk; with the recursion to its end and with doubled ranks; in chunks of any size."""
    monkeypatch.setattr(induced, "FEW_NAMES", few_names)
    monkeypatch.setattr(induced, "CHUNK", chunk)
    monkeypatch.setattr(induced, "DOUBLING_BYTES", doubling)
    rng, spills = random.Random(3), induced.Queues.spills
    texts = []
    for _ in range(200):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 30])
        text = [rng.randint(1, k) for _ in range(n)]
        texts.append(text * 4 if rng.random() < 0.3 else text)
    base = [rng.randint(1, 3) for _ in range(400)]
    texts.append([*base, *base[:100], 1, *base[100:], *base])
    for text in texts:
        held = [*text, 0]
        for memory in (64_000_000, 64):
            order, prefix = induced.suffixes(np.array(held, np.uint16), memory)
            assert (order.tolist(), prefix.tolist()) == suffix_array(held)
    assert induced.Queues.spills > spills


def test_a_lot_of_production_size_goes_to_disk():
    rng, spills = np.random.default_rng(5), induced.Queues.spills
    passage = rng.integers(97, 123, 300, dtype=np.uint8).tobytes()
    lot, contents = substrings.Lot(), []
    while lot.size < substrings.LOT_BYTES // 2:
        some = [rng.integers(97, 101, 350, dtype=np.uint8).tobytes() for _ in range(5_000)]
        contents += some
        some[7] = contents[len(contents) - 5_000 + 7] = some[7][:19] + bytes([len(contents) // 5_000]) + passage + bytes([len(contents) // 5_000]) + some[7][:9]
        n = len(some)
        lot.add(pa.record_batch({"n": pa.array([1] * n), "rid": pa.array(range(n)), "first": pa.array([0] * n, pa.int32()), "content": pa.array(some, pa.binary())}))
    _, rid, _, place = lot.repeated(substrings.WINDOW, substrings.QUEUE_BYTES)
    lots = len(contents) // 5_000
    assert sorted(zip(rid.tolist(), place.tolist(), strict=True)) == sorted([(7, p) for p in range(20, 121)] * lots)
    assert induced.Queues.spills > spills
