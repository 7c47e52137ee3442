"""Repeated windows of words or bytes over all documents: candidates by anchors, shared by the two substring operators.

Every window belongs to one anchor: the least hash among the short grams inside it (see arrays.anchors), so equal windows belong to equal
anchors. An anchor's windows start in one unbroken range; the text under them all is its context. Anchors whose gram occurs once have no
repeated window. Of the others, contexts that occur more than once are repeated as a whole. Only the remaining contexts, those that differ
from all others with the same gram (the edges of repeats and the places of edits), have to be looked at window by window, against one copy
of each other context of their gram. So what is shuffled is a few dozen bytes per anchor, and a group of copies is never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm.lines import row_id
from kvlake.llm.store import cut

#: values and bounds by document of a slice of texts
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def word_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, doc = A.words(data, bounds, A.SPACED)
    return A.word_hashes(data, begin, end), np.searchsorted(doc, np.arange(len(bounds)))


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return A.VALUES[data], bounds


def anchors(docs: DataFrame, units: Units, window: int, gram: int) -> DataFrame:
    """rid, gram, context (hashes), place, low, high (first and last start of the anchor's windows) of each anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch["rid"].to_numpy()
            for i, j, data, bounds in A.texts(batch["text"]):
                values, by_doc = units(data, bounds)
                place, low, high, hashes = A.anchors(values, by_doc, window, gram)
                doc = np.searchsorted(by_doc, low, "right") - 1
                context = A.Rolling(values).of(low, high + window) + (place - low).astype(np.uint64) * A.VALUES[3]
                first = by_doc[doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[i:j][doc]), pa.array(hashes.view(np.int64)), pa.array(context.view(np.int64)), *(pa.array((x - first).astype(np.int32)) for x in (place, low, high))],
                    ["rid", "gram", "context", "place", "low", "high"],
                )

    return docs.select(row_id().alias("rid"), "text").mapInArrow(rows, "rid long, gram long, context long, place int, low int, high int")


def candidates(docs: DataFrame, units: Units, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(spans, contests).

    spans: rid, first, last of contexts that occur more than once: units [first, last) lie in repeated windows.
    contests: gram, context, n, rid, place, low, high: one copy of each context of the grams that have several contexts; n is how often it occurs.
    """
    found = cut(anchors(docs, units, window, gram))
    often = found.groupBy("gram").agg(F.count("*").alias("times"), F.min("context").alias("least"), F.max("context").alias("most")).where("times > 1")
    # a table of its own, so that the join has an exchange on either side and Spark can split a very frequent gram
    often = cut(often.select("gram", (F.col("least") == F.col("most")).alias("alike")))
    live = cut(found.join(often, "gram"))
    alike = live.where("alike").select("rid", F.col("low").alias("first"), (F.col("high") + window).alias("last"))
    contests = live.where("not alike").groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place", "low", "high")).alias("copy"))
    contests = cut(contests.select("gram", "context", "n", "copy.rid", "copy.place", "copy.low", "copy.high"))
    copied = cut(contests.where("n > 1").select("gram", "context"))
    same = live.where("not alike").join(copied, ["gram", "context"], "left_semi").select("rid", F.col("low").alias("first"), (F.col("high") + window).alias("last"))
    return alike.union(same), contests


def by_row(spans: DataFrame) -> DataFrame:
    """rid, spans: an array of (first, last) for each row that has any. As many as fit in one document."""
    return spans.groupBy("rid").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text and spans (null if there are none) of every row of docs."""
    return docs.select("doc_id", row_id().alias("rid"), "text").join(by_row(spans), "rid", "left").select("doc_id", "text", "spans")


def covered(column: pa.Array, by_doc: np.ndarray) -> np.ndarray:
    """Which units of a slice lie in the spans of their documents; column: spans of its rows."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    counts = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
    flat = lists.flatten()
    shift = np.repeat(by_doc[:-1], counts)
    return A.covered(flat.field("first").to_numpy() + shift, flat.field("last").to_numpy() + shift, int(by_doc[-1]))
