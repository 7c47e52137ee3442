"""Substring dedup on bytes: every byte under a string of WINDOW bytes that starts elsewhere too is removed, by suffix arrays.

Anchors (repeats.py) first settle what needs no sorting: text without repeats, and contexts that occur more than once as a whole. Of the
contexts left, one copy of each goes on, in two pieces: the windows that have REACH bytes from the gram's begin on, and those that have as
many up to its end. Equal windows are in pieces that share those bytes, so pieces are dealt to shards by them, and a piece that shares
them with no other is done. Each shard is written to a file of its task and sorted by external induced sorting (induced.py), whose queues
go to disk beyond QUEUE_BYTES, and a window is repeated where the common prefix with a neighbour reaches WINDOW bytes. A shard of more
than LOT_BYTES is sorted in lots that end where the shared bytes change; a lot has no upper bound, as sorting needs no memory in proportion.

Strings never cross documents and are judged on the input; the same document and overlapping copies count. Result: doc_id, n_bytes,
n_removed, n_spans (maximal removed runs), kept_sha256.

Nulls and edges: a null text is empty; null ids are carried; rows repeated in full are each other's copies; an empty table gives an empty
result; other columns are ignored, whatever their names. A text is worked on as a whole, with some ten arrays of its length in a task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm import repeats as R
from kvlake.llm.induced import CAP, chunks, suffixes
from kvlake.llm.lines import row_id
from kvlake.llm.store import cut

WINDOW, GRAM = 200, 40
REACH = (WINDOW + GRAM) // 2
LOT_BYTES = 16_000_000
QUEUE_BYTES = 32_000_000


def _pieces(docs: DataFrame, contests: DataFrame) -> DataFrame:
    """w (hash of the shared bytes), n, rid, first (the place of the content) and content of each piece of the contested contexts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                lists = batch["held"].slice(i, j - i)
                counts = lists.value_lengths().to_numpy()
                flat = lists.flatten()
                shift = np.repeat(bounds[:-1], counts)
                place, low, high = (flat.field(c).to_numpy() + shift for c in ("place", "low", "high"))
                n, rid = flat.field("n").to_numpy(), np.repeat(batch["rid"].to_numpy()[i:j], counts)
                held, rolling = data.tobytes(), A.Rolling(A.VALUES[data])
                turn = place + REACH - WINDOW  # windows from here on have REACH bytes from the gram's begin on
                for first, last, core, end in ((np.maximum(low, turn), high, place, place + REACH), (low, np.minimum(high, turn - 1), place + GRAM - REACH, place + GRAM)):
                    some = np.flatnonzero(first <= last)
                    w = rolling.of(core[some], end[some])
                    content = [held[a : b + WINDOW] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n[some]), pa.array(rid[some]), pa.array((first - shift)[some].astype(np.int32)), pa.array(content, pa.binary())], ["w", "n", "rid", "first", "content"])

    held = contests.groupBy("rid").agg(F.collect_list(F.struct("n", "place", "low", "high")).alias("held"))
    texts = docs.select(row_id().alias("rid"), "text").join(held, "rid").dropDuplicates(["rid"])
    return texts.select("rid", "text", "held").mapInArrow(rows, "w long, n long, rid long, first int, content binary")


class Lot:
    """Pieces of a shard, with their contents one after the other in a file."""

    def __init__(self):
        self.file, self.size, self.columns = tempfile.TemporaryFile(), 0, []

    def add(self, batch: pa.RecordBatch) -> None:
        data, bounds = A.utf8(batch["content"])
        lengths = np.diff(bounds)
        text = np.ones(len(data) + len(lengths), np.uint16)  # 1 ends a content
        text[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
        inside = np.ones(len(text), np.bool_)
        ends = np.cumsum(lengths + 1) - 1
        inside[ends] = False
        text[inside] += 2
        self.file.write(text.tobytes())
        self.columns.append([batch["n"].to_numpy(), batch["rid"].to_numpy(), batch["first"].to_numpy(), self.size + ends])
        self.size += len(text)

    def repeated(self, window: int, memory: int) -> tuple[np.ndarray, ...]:
        """n, rid, first and place in the content of all windows, of at most CAP bytes, that stand more than once."""
        if window > CAP:
            raise ValueError(f"common prefixes are carried up to {CAP} bytes")
        n, rid, first, ends = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        self.file.write(np.zeros(1, np.uint16).tobytes())
        self.file.flush()
        text = np.memmap(self.file, np.uint16, "r") if 2 * self.size > memory else np.fromfile(self._rewound(), np.uint16)
        order, prefix = suffixes(text, memory)
        which, place = [], []
        for i, j in chunks(len(text)):
            long = prefix[i : j + 1] >= window
            at = order[i:j][long[: j - i] | np.append(long[1:], False)[: j - i]].astype(np.int64)
            of = np.searchsorted(ends, at)
            fits = ends[np.minimum(of, len(ends) - 1)] - at >= window
            which.append(of[fits])
            place.append(at[fits] - np.append(0, ends + 1)[of[fits]])
        self.file.close()
        which = np.concatenate(which)
        return n[which], rid[which], first[which], np.concatenate(place)

    def _rewound(self):
        self.file.seek(0)
        return self.file


def _sorted_windows(pieces: DataFrame) -> DataFrame:
    """rid, first, last of the repeated windows of contexts that occur once, merged where they touch, by suffix arrays."""

    def flush(lot: Lot) -> pa.RecordBatch:
        n, rid, first, place = lot.repeated(WINDOW, QUEUE_BYTES)
        alone = n == 1
        rid, first = rid[alone], first[alone] + place[alone]
        by = np.lexsort((first, rid))
        rid, first = rid[by], first[by]
        start = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (first[1:] > first[:-1] + 1))[: len(rid)])
        end = np.append(start[1:], len(rid))[: len(start)] - 1
        return pa.RecordBatch.from_arrays([pa.array(rid[start]), pa.array(first[start].astype(np.int32)), pa.array((first[end] + WINDOW).astype(np.int32))], ["rid", "first", "last"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, before = Lot(), None
        for batch in batches:
            w = batch["w"].to_numpy()
            if not len(w):
                continue
            if lot.size >= LOT_BYTES and w[0] != before:
                yield flush(lot)
                lot = Lot()
            # pieces that share their bytes with no other are left out; those at the ends of a batch may have others in the next one
            same = w[1:] == w[:-1]
            lot.add(batch.filter(pa.array(np.append(True, same) | np.append(same, True))))
            before = w[-1]
        if lot.size:
            yield flush(lot)

    dealt = pieces.repartition("w").sortWithinPartitions("w", "rid", "first")
    return dealt.mapInArrow(rows, "rid long, first int, last int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """rid, first, last: bytes [first, last) lie in repeated windows. Spans overlap."""
    spans, contests = R.candidates(docs, R.byte_units, WINDOW, GRAM)
    return spans.union(cut(_sorted_windows(cut(_pieces(docs, contests)))))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                gone = R.covered(batch["spans"].slice(i, j - i), bounds)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                begins = gone.copy()
                begins[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
                kept = data[~gone].tobytes()
                at = np.append(0, np.cumsum(~gone))[bounds].tolist()
                sums = [hashlib.sha256(kept[at[k] : at[k + 1]]).hexdigest() for k in range(j - i)]
                counts = [np.diff(bounds), np.bincount(doc[gone], minlength=j - i), np.bincount(doc[begins], minlength=j - i)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(sums)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return R.with_spans(docs, repeated_spans(docs)).mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
