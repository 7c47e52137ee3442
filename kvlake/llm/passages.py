"""Substring dedup on words: every word in a window of WINDOW words that stands elsewhere too is removed, by level-wise doubling.

Level 8: windows of 8 words, one for each anchor (repeats.py). Only those that occur more than once go on. Where the whole text under an
anchor's windows occurs more than once, it is settled. For the rest, level 16 takes the two windows of 16 words that begin or end with the
anchor's: a longer window around the anchor holds at least one of them. Level 32 takes the windows of 32 words around surviving anchors
that begin a multiple of four words before the anchor: each window of 35 words holds just one of those. The last level takes the windows of
35 words around surviving ones. Each level keeps what occurs more than once, and the windows of a level are only made for what is left of
the one before; the hashes of a context's words go along, so that texts are read once for all levels.

Words are what stands between white space, unchanged; windows never cross documents and are judged on the input; copies inside one document
count, overlapping ones too. Result: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

Nulls and edges: a null or empty text has no words; null ids are carried; rows repeated in full are each other's copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm import repeats as R
from kvlake.llm.lines import row_id
from kvlake.llm.store import cut

WINDOW, GRAM = 35, 8
LEVELS = (16, 32)
STEP = WINDOW - LEVELS[-1] + 1


def _contexts(docs: DataFrame, contests: DataFrame) -> DataFrame:
    """rid, place, low, high, n and the hashes of the words of each contested context, and of its two windows of 16 words around the anchor (0: it has none)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                values, by_doc = R.word_units(data, bounds)
                rolling = A.Rolling(values)
                lists = batch["held"].slice(i, j - i)
                counts = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                shift = np.repeat(by_doc[:-1], counts)
                place, low, high = (flat.field(c).to_numpy() + shift for c in ("place", "low", "high"))
                end, short = high + WINDOW, LEVELS[0]
                right = np.where(place + short <= end, rolling.of(place, np.minimum(place + short, by_doc[-1])), 0)
                left = np.where(place + GRAM - short >= low, rolling.of(np.maximum(place + GRAM - short, 0), place + GRAM), 0)
                size = end - low
                offsets = np.append(0, np.cumsum(size))
                inner = values[np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(low, size)]
                held = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(inner.view(np.int64)))
                rid = np.repeat(batch["rid"].to_numpy()[i:j], counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid), *(flat.field(c) for c in ("place", "low", "high", "n")), pa.array(right.view(np.int64)), pa.array(left.view(np.int64)), held], ["rid", "place", "low", "high", "n", "right", "left", "held"]
                )

    held = contests.groupBy("rid").agg(F.collect_list(F.struct("place", "low", "high", "n")).alias("held"))
    texts = docs.select(row_id().alias("rid"), "text").join(held, "rid").dropDuplicates(["rid"])
    return texts.select("rid", "text", "held").mapInArrow(rows, "rid long, place int, low int, high int, n long, right long, left long, held array<long>")


def _windows(contexts: DataFrame, size: int, step: int) -> DataFrame:
    """rid, place, n, begin, w: the hashes of the windows of some contexts of `size` words that begin a multiple of step words before the anchor.

    They hold the anchor's gram if they are long enough to be inside a window of WINDOW words; with step 1, all windows of the context.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch["held"].flatten().to_numpy().view(np.uint64)
            bounds = np.append(0, np.cumsum(batch["held"].value_lengths().to_numpy())).astype(np.int64)
            place, low, high = (batch[c].to_numpy().astype(np.int64) for c in ("place", "low", "high"))
            if step == 1:
                first, last = low, high
            else:
                first, last = place - (place - low) // step * step, np.minimum(place, high + WINDOW - size)
            n = np.maximum((last - first) // step + 1, 0)
            which = np.repeat(np.arange(len(n)), n)
            begin = first[which] + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            at = bounds[:-1][which] + begin - low[which]
            w = A.Rolling(values).of(at, at + size)
            of = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch["rid"].take(of), batch["place"].take(of), batch["n"].take(of), pa.array(begin.astype(np.int32)), pa.array(w.view(np.int64))], ["rid", "place", "n", "begin", "w"])

    return contexts.select("rid", "place", "low", "high", "n", "held").mapInArrow(rows, "rid long, place int, n long, begin int, w long")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose w occurs more than once. What repeats is a table of its own, so that Spark can split a very frequent w in the join."""
    often = cut(rows.groupBy("w").agg(F.count("*").alias("k")).where("k > 1").select("w"))
    return rows.join(often, "w", "left_semi")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rid, first, last: words [first, last) lie in repeated windows. Spans overlap."""
    spans, contests = R.candidates(docs, R.word_units, WINDOW, GRAM)
    on = ["rid", "place"]
    contexts = cut(_contexts(docs, contests))
    # level 16
    level = contexts.select(*on, F.explode(F.filter(F.array("right", "left"), lambda h: h != 0)).alias("w"))
    contexts = cut(contexts.join(_repeated(level).select(*on).distinct(), on, "left_semi").select(*on, "low", "high", "n", "held"))
    # level 32, of what is left
    level = cut(_repeated(cut(_windows(contexts, LEVELS[1], STEP))).select(*on, "begin"))
    contexts = contexts.join(level.select(*on).distinct(), on, "left_semi")
    # level 35: the windows that hold a surviving one of 32
    last, at = _windows(contexts, WINDOW, 1), F.col("begin") - F.col("place")
    inner = F.when(at <= 0, F.ceil(at / STEP) * STEP).otherwise(at).cast("int") + F.col("place")
    last = cut(last.withColumn("inner", inner).join(level.withColumnRenamed("begin", "inner"), [*on, "inner"], "left_semi"))
    return spans.union(_repeated(last).where("n = 1").select("rid", F.col("begin").alias("first"), (F.col("begin") + WINDOW).alias("last")))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                begin, end, doc = A.words(data, bounds, A.SPACED)
                by_doc = np.searchsorted(doc, np.arange(j - i + 1))
                gone = R.covered(batch["spans"].slice(i, j - i), by_doc)
                out, keep = data.copy(), np.zeros(len(data) + 1, dtype=np.int8)
                stay = np.flatnonzero(~gone)
                later = stay[1:][doc[stay[1:]] == doc[stay[:-1]]]
                out[begin[later] - 1] = 32
                steps = np.zeros(len(data) + 1, dtype=np.int8)
                steps[begin[stay]] += 1
                steps[end[stay]] -= 1
                keep = np.cumsum(steps[:-1], dtype=np.int8) > 0
                keep[begin[later] - 1] = True
                kept = out[keep].tobytes()
                at = np.append(0, np.cumsum(keep))[bounds].tolist()
                sums = [hashlib.sha256(kept[at[k] : at[k + 1]]).hexdigest() for k in range(j - i)]
                removed = np.bincount(doc[gone], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(np.diff(by_doc).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sums)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return R.with_spans(docs, repeated_spans(docs)).mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string")
