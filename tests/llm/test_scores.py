"""Operators 3, 4, 6, 7, 9 and 10, and the pipeline."""

import gc
import random
import re
import tracemalloc
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kvlake.llm import ann, decontaminate, langid, licenses, packing, quality
from kvlake.llm.sampling import held_out
from kvlake.llm.store import cut
from tests.llm import brute

SF = "/root/testdata/sf0.01"
TEXTS = brute.documents()


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_fold_is_crc32(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_language_on_the_held_out_fold(spark):
    docs = table(spark, "documents")
    out = langid.predict(docs, langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang"] == out["lang_pred"]).mean() > 0.95


def test_language_edges(spark):
    docs = brute.frame(spark, [None, "", "12 !?", "hallo welt", "x" * 200_000], [1, 2, None, 4, 5])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") > 1, "de"))
    out = {r["doc_id"]: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, None)] == ["und"] * 3 and all(out[i]["score"] == 0 for i in (1, 2, None))
    assert out[4]["lang_pred"] == "de" and 0 <= out[5]["score"] <= 1
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.predict(unlabelled, langid.train(unlabelled)).collect()} == {"und"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0


def test_language_with_ids_as_texts(spark):
    docs = table(spark, "documents").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert langid.predict(docs, langid.train(docs, 200)).where("lang_pred = 'und'").count() < docs.count() / 10


def test_language_scores_are_the_plain_ones(spark):
    """Averages of embeddings, subword by subword, and a softmax of their products with the weights."""
    rng = np.random.default_rng(3)
    model = langid.Model(["de", "en", "fr"], rng.normal(size=(langid.BUCKETS, langid.DIMENSIONS)), rng.normal(size=(langid.DIMENSIONS, 3)), rng.normal(size=3), 0.7, 0.5)
    texts = [t for t in TEXTS if t is None or len(t) < 3_000]
    got = {r["doc_id"]: r for r in langid.predict(brute.frame(spark, texts), model).collect()}
    for i, text in enumerate(texts):
        low, hidden, n = brute.ascii_lower(text).encode(), np.zeros(langid.DIMENSIONS), 0
        for k, factor in ((2, 0x9E3779B1), (3, 0x85EBCA77)):
            for at in range(len(low) - k + 1):
                hidden += model.embeddings[((int.from_bytes(low[at : at + k], "big") * factor) >> 12) % langid.BUCKETS]
                n += 1
        logits = (hidden / max(n, 1) @ model.weights + model.bias) / model.temperature
        p = np.exp(logits) / np.exp(logits).sum()
        letters = any(c.isalpha() for c in text or "")
        assert got[i]["lang_pred"] == (model.languages[int(p.argmax())] if letters else "und")
        assert abs(got[i]["score"] - (p.max() if letters else 0)) < 1e-9
        assert got[i]["rejected"] == (not letters or p.max() < model.accept)


def test_quality_on_the_held_out_fold(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    out = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_quality_edges(spark):
    docs = brute.frame(spark, [None, "", "text", "text", "y" * 200_000], [1, None, 3, 3, 5])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, quality.train(docs, none)).collect()
    assert len(out) == 5 and {r["score"] for r in out} == {0.5}
    odd = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in quality.classify(docs, quality.train(docs, odd)).collect())
    assert quality.classify(docs.limit(0), quality.train(docs, none)).count() == 0


def test_quality_scores_are_the_plain_ones(spark):
    """Each tree is walked by itself, and statistics are counted text by text."""
    rng = np.random.default_rng(4)
    nodes = 2**4 - 1
    model = quality.Trees(rng.integers(0, len(quality.STATISTICS), (9, nodes)), rng.random((9, nodes)) * 2, rng.normal(size=(9, nodes)), 0.2, 3)
    got = {r["row"]["doc_id"]: r["score"] for r in quality.score(brute.frame(spark, TEXTS), model, ["doc_id"]).collect()}
    for i, text in enumerate(TEXTS):
        data = np.frombuffer((text or "").encode(), np.uint8)
        x = quality.statistics(data, np.array([0, len(data)]))[0]
        total = model.start
        for t in range(9):
            node = 0
            for _ in range(model.depth):
                node = 2 * node + 1 + int(x[model.feature[t, node]] > model.edge[t, node])
            total += model.value[t, node]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12
        held, words, lines_of = dict(zip(quality.STATISTICS, x, strict=True)), brute.spaced(text), (text or "").split("\n")
        assert abs(held["log_bytes"] - np.log1p(len(data))) < 1e-12 and abs(held["log_words"] - np.log1p(len(words))) < 1e-12
        assert abs(held["distinct_words"] - len(set(words)) / max(len(words), 1)) < 1e-12
        assert abs(held["top_word"] - max(Counter(words).values(), default=0) / max(len(words), 1)) < 1e-12
        assert abs(held["word_bytes"] - sum(len(w.encode()) for w in words) / max(len(words), 1)) < 1e-9
        assert abs(held["log_lines"] - np.log1p(len(lines_of))) < 1e-12
        counts = Counter(data.tolist())
        assert abs(held["entropy"] + sum(n / len(data) * np.log2(n / len(data)) for n in counts.values())) < 1e-9


def license_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


def standing(words, phrase):
    p = phrase.encode().split()
    return [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]


def notices(words):
    """(label, first, last, share) of all notices, vote by vote."""
    out = []
    for label, text in licenses.TEXTS:
        template, k = text.encode().split(), licenses.NOTICE_GRAM
        votes = {}
        for place in range(len(words) - k + 1):
            for at in range(len(template) - k + 1):
                if words[place : place + k] == template[at : at + k]:
                    votes.setdefault(place - at, []).append((place, at))
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][0] <= licenses.GAP:
                groups[-1] = (d, groups[-1][1] + votes[d])
            else:
                groups.append((d, votes[d]))
        for _, held in groups:
            covered, last = set(), -k
            for _, at in sorted(held):
                if at > last:
                    covered |= set(range(at, at + k))
                    last = at
            first, end = min(p for p, _ in held), max(p for p, _ in held) + k - 1
            share = len(covered) / len(template)
            if share >= licenses.NOTICE_SHARE and end - first + 1 <= licenses.LONGEST * len(template):
                out.append((label, first, end, share))
    return sorted(out)


def test_licenses(spark):
    rng = random.Random(8)
    texts = [*TEXTS[:-1], "The MIT License. cc by, CC-BY; gnu GENERAL public license", "apache\nlicense apache license", "Softwäre MIT License " * 3]
    for _, text in licenses.TEXTS:
        words = text.split()
        cut_off = words[: rng.randrange(5, len(words))]
        edited = [w for w in words if rng.random() > 0.04]
        for _ in range(3):
            edited.insert(rng.randrange(len(edited)), "word")
        shuffled = [words[i : i + 6] for i in range(0, len(words), 6)]
        rng.shuffle(shuffled)
        texts += [f"start {' '.join(words).title()} end", " ".join(cut_off), " ".join(edited), " ".join(sum(shuffled, [])), " ".join(["x", *words, *words])]
    ids = [None, *range(1, len(texts))]
    got = {r["doc_id"]: r for r in licenses.scan(brute.frame(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    for i, t in zip(ids, texts, strict=True):
        words, r = license_words(t), got[i]
        places = sorted(k for phrase in licenses.BASE for k in standing(words, phrase))
        base = {label for phrase, label in licenses.BASE.items() if standing(words, phrase)}
        more = base | {label for phrase, label in licenses.PHRASES.items() if standing(words, phrase)}
        spans = notices(words)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert [tuple(x) for x in r["spans"]] == spans
        assert r["labels"] == ",".join(sorted(more | {x[0] for x in spans}))
        assert r["score"] == (1.0 if more else max((x[3] for x in spans), default=0.0))
    assert licenses.scan(brute.frame(spark, ["mit license"] * 2, [1, 1])).count() == 2
    assert licenses.scan(brute.frame(spark, TEXTS).limit(0)).count() == 0


def test_packing_is_whole(spark):
    docs = brute.frame(spark, [*TEXTS, "Ünï 's x_y <|endoftext|> 日本"], [None, *range(1, len(TEXTS) + 1)])
    length = 256
    out = packing.pack(docs, length=length).toPandas()
    tokens = packing.Tokens(packing.default_tokenizer())
    want = []
    for r in docs.collect():
        ids = [*tokens.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want += [(r["doc_id"], n, at, len(ids[at : at + length]), zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())) for n, at in enumerate(range(0, len(ids), length))]
    got = [(None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert (part["offset"].to_numpy() == np.append(0, part["length"].cumsum()[:-1])).all() and part["length"].sum() <= length
    total = out["length"].sum()
    assert out["sequence_id"].nunique() <= -(-total // length) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def fewest(sizes, length):
    """The least number of bins, by trying all."""

    @cache
    def bins(left):
        if not left:
            return 0
        best = len(left)

        def fill(rest, k, room):
            nonlocal best
            best = min(best, 1 + bins(rest))
            for i in range(k, len(rest)):
                if rest[i] <= room and (i == k or rest[i] != rest[i - 1]):
                    fill(rest[:i] + rest[i + 1 :], i, room - rest[i])

        fill(left[1:], 0, length - left[0])
        return best

    return bins(tuple(sorted(sizes, reverse=True)))


def plain_best_fit(sizes, length):
    bins = []
    for size in sorted(sizes, reverse=True):
        fits = [room for room in bins if room >= size]
        if fits:
            bins.remove(min(fits))
        bins.append((min(fits) if fits else length) - size)
    return len(bins)


def held(kinds, length):
    """How many pieces of each size the sequences hold; all of them have room for theirs."""
    out = Counter()
    for n, kind in kinds:
        assert n > 0 and sum(size * k for size, k in kind.items()) <= length
        out.update({size: n * k for size, k in kind.items()})
    return out


def test_bin_completion_needs_no_more_than_the_fewest():
    rng, improved = random.Random(4), 0
    for _ in range(300):
        length = rng.choice([10, 30, 100])
        sizes = [rng.randint(1, length) if rng.random() < 0.5 else rng.randint(length // 5 + 1, length // 2) for _ in range(rng.randint(1, 11))]
        counts = Counter(sizes)
        kinds, first, least = packing.complete(counts, length), packing.best_fit(counts, length), fewest(sizes, length)
        assert held(kinds, length) == held(first, length) == counts
        assert sum(n for n, _ in first) == plain_best_fit(sizes, length)
        assert sum(n for n, _ in kinds) == least >= packing.lower_bound(counts, length)
        improved += sum(n for n, _ in first) > least
    assert improved
    assert packing.complete({}, 10) == []
    many = {700: 10**9, 300: 10**9 + 3, 1000: 5}
    assert held(packing.complete(many, 1_000), 1_000) == many and sum(n for n, _ in packing.complete(many, 1_000)) == 10**9 + 6


def test_bin_completion_keeps_one_table_of_lengths():
    """Some 900 lengths, of which best fit makes two sequences too many: the former search took 51 MB, and found nothing in 20,000 steps."""
    sizes = np.minimum(np.random.default_rng(0).lognormal(5.5, 1.0, 6_000).astype(int) + 20, 1_000)
    counts = dict(Counter(sizes.tolist()))
    tracemalloc.start()
    kinds = packing.complete(counts, 1_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held(kinds, 1_000) == counts
    assert packing.lower_bound(counts, 1_000) <= sum(n for n, _ in kinds) < sum(n for n, _ in packing.best_fit(counts, 1_000))
    assert peak < 10e6


def test_bin_completion_ends_where_the_bound_is_out_of_reach():
    counts = dict.fromkeys(range(1_030, 2_040, 5), 3)
    kinds = packing.complete(counts, 4_096, 2_000)
    assert held(kinds, 4_096) == counts and sum(n for n, _ in kinds) <= sum(n for n, _ in packing.best_fit(counts, 4_096))


def test_places_are_distinct_and_gapless():
    counts = {700: 3, 300: 4, 150: 9, 1: 50}
    places = packing.Places(packing.complete(counts, 1_000))
    taken = {}
    for size, n in counts.items():
        for sequence, offset in zip(*places.of(np.full(n, size), np.arange(n)), strict=True):
            taken.setdefault(int(sequence), []).append((int(offset), size))
    for parts in taken.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1_000


def test_tokens_by_word_are_those_of_the_whole_text():
    tokens = packing.Tokens(packing.default_tokenizer())
    texts = [t or "" for t in TEXTS] + ["a<|endoftext|>b <|startoftext|> c", "<|endoftext|>", "<|endoftext|> x", "ΑΣ ΣΑΣ \u00a0x\u0301 y", "it's\tI'LL 12.5%"]
    assert tokens.by_word
    assert tokens.ids([t.encode() for t in texts]) == [tokens._encode(t) for t in texts]


def made_up_words(n: int, seed: int) -> list[str]:
    letters = np.random.default_rng(seed).integers(97, 123, (n, 9), dtype=np.uint8)
    return [x.tobytes().decode() for x in letters]


def test_words_are_remembered_in_few_bytes(monkeypatch):
    monkeypatch.setattr(packing, "UNITS", 1_000)
    tokens = packing.Tokens(packing.default_tokenizer())
    tokens.ids([b"a b"])
    tracemalloc.start()
    try:
        for seed in range(30):
            tokens.ids([" ".join(made_up_words(1_000, seed)).encode()])
        gc.collect()
        assert tracemalloc.get_traced_memory()[0] < 30_000 * 110
    finally:
        tracemalloc.stop()


def test_long_words_are_not_kept_beyond_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_BYTES", 50_000)
    tokens = packing.Tokens(packing.default_tokenizer())
    for seed in range(40):
        word = "-".join(made_up_words(1_000, seed))
        assert tokens.ids([f"a {word}".encode()]) == [tokens._encode(f"a {word}")]
    assert tokens.letters.nbytes + tokens.held.nbytes < 100_000


def test_tokens_are_right_when_words_are_forgotten_and_hashes_meet(monkeypatch):
    texts = [t or "" for t in TEXTS] + [" ".join(made_up_words(40, seed % 7)) + f" {seed} ΑΣ 日本 <|endoftext|>" for seed in range(30)] + ["", " \n ", "é e\u0301"]
    monkeypatch.setattr(packing, "WORDS", 60)
    monkeypatch.setattr(packing, "UNITS", 20)
    monkeypatch.setattr(packing, "WORDS_AT_ONCE", 50)
    tokens = packing.Tokens(packing.default_tokenizer())
    want = [tokens._encode(t) for t in texts]
    for _ in range(2):
        assert [tokens.ids([t.encode()])[0] for t in texts] == tokens.ids([t.encode() for t in texts]) == want
    plain = packing.A.word_hashes
    monkeypatch.setattr(packing.A, "word_hashes", lambda *x: plain(*x) % np.uint64(97))
    tokens = packing.Tokens(packing.default_tokenizer())
    assert tokens.by_word
    assert [tokens.ids([t.encode()])[0] for t in texts] == tokens.ids([t.encode() for t in texts]) == want


def test_neighbours(spark):
    vectors = table(spark, "embeddings").select("vec_id", "embedding").toPandas()
    held = {r.vec_id: np.array(r.embedding, dtype=float) for r in vectors.itertuples()}
    same = held[50].tolist()
    extra = [(1000 + i, same, 0) for i in range(60)] + [(2000, None, 0), (2001, [0.0] * 64, 0), (2002, [float("nan")] * 64, 0), (2050, [None, *same[1:]], 0), (None, same, 0), (2101, [1.0, 2.0], 0)]
    held |= {i: np.array(same) for i, _, _ in extra[:60]}
    rows = [(k, v.tolist(), 0) for k, v in held.items() if k < 1000] + extra + extra[:1]
    out = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).toPandas()
    assert set(out["query_id"]) == {i for i in held if i % 50 == 0}
    ids = np.array(sorted(held))
    all_of = np.array([held[i] for i in ids])
    hit = 0
    for q, part in out.groupby("query_id"):
        score = all_of @ held[q] / np.linalg.norm(all_of, axis=1) / np.linalg.norm(held[q])
        score[ids == q] = -9
        part = part.sort_values("rank")
        assert part["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(part["vec_id"])
        assert np.allclose(part["score"], [score[np.searchsorted(ids, v)] for v in part["vec_id"]], atol=1e-12)
        hit += len(set(ids[np.lexsort((ids, -np.round(score, 12)))[:5]]) & set(part["vec_id"]))
    assert hit / len(out) >= 0.9
    assert out[out["query_id"] == 50].sort_values("rank")["vec_id"].tolist() == [1000, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [(r["vec_id"], r["rank"]) for r in ann.search(few).collect()] == [(1, 1)]
    assert ann.search(few.limit(0)).count() == 0


def test_index_of_clustered_vectors_compares_few():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 20_000)] + 0.35 * rng.normal(size=(20_000, 64))
    index, unit = ann.MultiIndex(x[: ann.SAMPLE_ROWS], len(x)), ann.MultiIndex.unit(x)
    assert index.share < 0.2
    cells = index.cells(unit)
    held = dict(zip(*np.unique(cells, return_counts=True), strict=True))
    a, b = index.halves(unit[::200])
    hit = 0
    for k, q in enumerate(range(0, len(x), 200)):
        score = unit @ unit[q]
        score[q] = -2
        top = np.argsort(-score)[: ann.NEAREST]
        hit += np.isin(cells[top], list(index.walk(a[k], b[k], held, index.share * len(x)))).sum()
    assert hit >= 0.9 * ann.NEAREST * 100


def test_neighbours_of_odd_vectors(spark):
    """Components that overflow or vanish when squared, vectors of other dimensions, ties, both zeros, and clashing columns."""
    vectors = {
        0: [1e200, 1e200, 0.0, 0.0], 1: [1.0, 1.0, 0.0, 0.0], 2: [1e-200, 1e-200, -0.0, 0.0], 3: [0.0, 1.0, 0.0, 0.0], 4: [-1.0, -1.0, 0.0, 0.0],
        50: [1.0, 2.0], 51: [2.0, 4.0], 52: [2.0, 1.0], 100: [1.0, 1.0, -0.0, 0.0],
    }
    rows = spark.createDataFrame([(k, v, 1, 2, 3, 4) for k, v in vectors.items()], "vec_id long, embedding array<double>, h int, cell int, block int, vector int")
    got = {}
    for r in ann.search(rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 12)))
    half = round(0.5**0.5, 12)
    # equal directions may differ in the last bit of their scores
    assert {x[1:] for x in got[0][:3]} == {(1, 1.0), (2, 1.0), (100, 1.0)} and [x[1:] for x in got[0][3:]] == [(3, half), (4, -1.0)]
    assert got[50] == [(1, 51, 1.0), (2, 52, 0.8)]
    assert [x[0] for x in got[100]] == [1, 2, 3, 4, 5] and {x[1] for x in got[100][:3]} == {0, 1, 2}


ITEM = "What is the sum of 12 apples and 7 pears that Peter bought for 30 eur in the market of Berlin last week"


def test_leaks(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (None, "too short"), (3, "")], "item_id long, text string")
    other = ITEM.replace("12", "45").replace("7", "9").replace("Peter", "Maria")
    wrong = ITEM.replace("12", "Berlin").replace("Peter", "30").replace("Berlin last", "Peter last")
    texts = [None, "", "bla " * 30 + ITEM, other, "nothing here of interest to anyone " * 5, ITEM, " ".join(ITEM.split()[:6])]
    docs = brute.frame(spark, texts, [None, 1, 2, 3, 4, 5, 6])
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, benchmark).collect()}
    assert set(got) == {2, 3, 5}
    assert not got[2]["reparameterised"] and got[3]["reparameterised"] and got[5]["share"] == 1.0
    assert decontaminate.leaks(brute.frame(spark, [wrong]), benchmark).where("share = 1").count() == 0
    out = decontaminate.clean(docs, benchmark)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {None, 1, 4, 6}
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0
    assert decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_leaks_are_the_documents_that_contain_items(spark):
    docs, benchmark = table(spark, "documents"), table(spark, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    want = {(d["doc_id"], b["item_id"]) for d in docs.collect() for b in benchmark.collect() if b["text"] in d["text"]}
    assert want <= got and len(got) <= len(want) + 2


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_leaks_are_those_of_the_plain_matcher(spark, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(12)
    common = [f"{a}{b}" for a in "bdfgl" for b in ("a", "o", "ir")] + ["kg", "cm"]
    number, name = lambda: str(rng.randrange(6)), lambda: rng.choice(["Anna", "Otto", "Ödön", "Γιώργος"])
    word = lambda: rng.choices([rng.choice(common), number(), name()], [7, 2, 1])[0]
    items = [[word() for _ in range(n)] for n in (1, 2, 3, 3, 5, 7, 8, 9, 12, 14, 20, 30, 40)] + [["1", "2", "3", "Anna"] * 4, ["fa", "lo", "ga"]]
    texts = ["", None, "1 2 3 4 5 6 7 8 9 10 11 12 13"]
    for item in items * 5:
        to = {w: number() if w.isdigit() else name() if w[0].isupper() else w for w in item}
        copy = [to[w] if rng.random() < 0.9 else word() for w in item] if rng.random() < 0.7 else list(item)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(len(copy))] = word()
        text = " ".join([word() for _ in range(rng.randrange(4))] + copy + [word() for _ in range(rng.randrange(4))])
        texts.append(text.upper() if rng.random() < 0.2 else text)
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.leaks(brute.frame(spark, texts), benchmark).collect()}
    want = {(d, i): brute.leaked_words(" ".join(x), t, decontaminate.UNITS) for d, t in enumerate(texts) for i, x in enumerate(items)}
    assert got == {k: n for k, n in want.items() if n}


def test_leaks_in_very_long_texts_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    benchmark = spark.createDataFrame([(1, ITEM, 0), (1, "who wrote the old green book", 0)], "item_id long, text string, rid int").withColumn("doc_id", F.lit(1))
    texts = [" ".join(f"w{i % 977}" for i in range(300_000)) + " " + ITEM, "la " * 200_000, "la who wrote the old green book"]
    got = {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.leaks(brute.frame(spark, texts), benchmark).collect()}
    assert got == {(0, 1, 23), (2, 1, 6)}


def test_leaks_with_names_in_other_alphabets(spark):
    item = "πόσα μήλα έχει ο Γιώργος όταν η Μαρία του δίνει 5 ακόμη και το βράδυ τρώει 2 από αυτά"
    other = item.replace("Γιώργος", "Νίκος").replace("Μαρία", "Ελένη").replace("5", "7")
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.leaks(brute.frame(spark, [item, other, item.replace("μήλα", "x").replace("ακόμη", "y")]), benchmark).collect()}
    assert got == {0: False, 1: True}


def test_pipeline_stage_by_stage(spark):
    docs = table(spark, "documents").withColumn("score", F.lit(1)).withColumn("row", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF))
        if name == "lines":
            rows = docs.select("doc_id", "text").collect()
            kept = dict(zip((r["doc_id"] for r in rows), brute.lines([r["text"] for r in rows], [r["doc_id"] for r in rows]), strict=True))
            before = {r["doc_id"]: r["text"] for r in rows}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {k: v for k, v in kept.items() if v == before[k] or v.strip()}
            assert out.where("n_chars <> length(text)").count() == 0
        if name == "near_copies":
            rows = docs.select("doc_id", "text").collect()
            ids = [r["doc_id"] for r in rows]
            want = {i for i, (n, c) in zip(ids, brute.components([r["text"] for r in rows], ids), strict=True) if i == c or not n}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "benchmark":
            items = [r["text"] for r in table(spark, "benchmark").collect()]
            left = {r["doc_id"] for r in out.collect()}
            assert left >= {r["doc_id"] for r in docs.collect() if not any(b[:60] in r["text"] for b in items)}
            assert not any(b in r["text"] for r in out.collect() for b in items)
        if name != "packing":
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            docs = out
        else:
            assert out.select("doc_id").distinct().count() == docs.count()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    docs = brute.frame(spark, TEXTS, [None, *range(1, len(TEXTS))])
    assert stage(spark, docs, SF).count() >= 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_leaks_in_any_case(spark):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    texts = [ITEM.upper(), "bla " * 30 + ITEM.upper(), ITEM.lower(), ITEM.title(), "NOTHING HERE OF INTEREST TO ANYONE " * 5, "One Two Three " * 20]
    found = decontaminate.leaks(brute.frame(spark, texts), benchmark).collect()
    assert {r["doc_id"]: r["n_words"] for r in found} == {i: 23 for i in range(4)}
    assert not any(r["reparameterised"] for r in found)


def test_leaks_with_a_changed_occurrence(spark):
    words = "the clerk counts {} crates on the first day and then again {} crates on the second day before the manager of the store writes down {} crates in the large book".split()
    text = lambda *values: " ".join(words).format(*values)
    sums = lambda *values: "if a farmer sells {} red hens at noon and buys back {} brown ones later how many of all his {} birds are left".format(*values)
    benchmark = spark.createDataFrame([(1, text(3, 3, 3)), (2, sums(3, 4, 6))], "item_id long, text string")
    texts = [text(3, 3, 8), text(9, 9, 9), sums(5, 5, 7), sums(3, 4, 6)]
    got = {(r["doc_id"], r["item_id"]): (r["n_words"], r["reparameterised"]) for r in decontaminate.leaks(brute.frame(spark, texts), benchmark).collect()}
    n, m = len(words), len(sums(1, 2, 3).split())
    assert got == {(0, 1): (words.index("writes") + 2, False), (1, 1): (n, True), (2, 2): (m, True), (3, 2): (m, False)}


def test_leaks_of_short_and_number_heavy_items(spark):
    items = ["who wrote the old green book", "find the sum of the numbers 12 45 67 89 23 56 78 90 11", "Otto Hahn", "how far is it to 7 towns"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [*items, *("so I ask you " + t.upper() + " and that is all" for t in items), "how far is it to 9 towns", "who wrote the old blue book", "Otto Braun", "Otto", "numbers 1 2 3 4 5 6 7 8 9 10 11 12"]
    got = {(r["doc_id"], r["item_id"], r["n_words"]) for r in decontaminate.leaks(brute.frame(spark, texts), benchmark).collect()}
    n = [len(t.split()) for t in items]
    assert got == {(d, d % 4, n[d % 4]) for d in range(8)} | {(8, 3, n[3])}
