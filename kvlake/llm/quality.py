"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of each document are computed by Spark tasks, the trees are grown in numpy on the driver from a bounded sample of labelled
rows (SAMPLE_ROWS, the only bound here), flattened into arrays, and every document is scored by a vectorised walk inside Spark tasks.

Empty and null texts have statistics (zeros) and so a score like any other; nulls in other columns are not looked at. Repeated rows are
scored one by one. Without any labelled row the score is 0.5 throughout. An empty table gives an empty result. Splits that tie go to the
first statistic and the least value. A very long text is worked on as a whole, with some ten arrays of its length in a task. Extra columns
are ignored by classify() and carried by score(), whatever their names, as they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvlake.llm import arrays as A
from kvlake.llm.sampling import bounded, held_out

#: Most labelled rows that the trees are grown from.
SAMPLE_ROWS = 20_000
#: Documents with a score of at least this are taken as good.
THRESHOLD = 0.3

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "lower", "upper", "digit", "space", "stop", "comma", "mark", "symbol", "beyond_ascii",
    "entropy", "distinct_words", "top_word", "distinct_lines", "line_bytes", "symbol_ends", "upper_words", "longest_word", "short_words", "digit_words", "distinct_pairs",
)


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


CLASSES = {
    "lower": _class(bytes(range(97, 123))), "upper": _class(bytes(range(65, 91))), "digit": _class(bytes(range(48, 58))), "space": _class(b" \t\n\r\x0b\x0c"),
    "stop": _class(b"."), "comma": _class(b",;:"), "mark": _class(b"!?"), "symbol": _class(bytes([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) & ~_class(b".,;:!?'\"-"),
    "beyond_ascii": _class(bytes(range(128, 256))),
}


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each document."""
    n, size = len(bounds) - 1, np.diff(bounds)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    some = np.maximum(size, 1)
    out = {k: counts[:, c].sum(1) / some for k, c in CLASSES.items()}
    share = counts / some[:, None]
    out["entropy"] = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    begin, end, of = A.words(data, bounds, A.SPACED)
    n_words = np.bincount(of, minlength=n)
    words = np.maximum(n_words, 1)
    out["log_bytes"], out["log_words"], lines = np.log1p(size), np.log1p(n_words), counts[:, 10] + 1
    out["log_lines"], out["line_bytes"] = np.log1p(lines), np.log1p(size / lines)
    length = (end - begin).astype(float)
    out["word_bytes"] = A.per_doc(length, of, n) / words
    hashes = A.word_hashes(data, begin, end)
    d, _, times = A.distinct_pairs(of, hashes)
    out["distinct_words"] = np.bincount(d, minlength=n) / words
    top = np.zeros(n)
    np.maximum.at(top, d, times)
    out["top_word"] = top / words
    pair = np.flatnonzero(of[1:] == of[:-1]) if len(of) > 1 else np.zeros(0, int)
    d, _, _ = A.distinct_pairs(of[pair], A.mix(hashes[pair] * A.BASE + hashes[pair + 1])) if len(pair) else (pair, pair, pair)
    out["distinct_pairs"] = np.bincount(d, minlength=n) / np.maximum(n_words - 1, 1)
    begin_l, end_l, of_l = A.words(data, bounds, A.word_bytes(b"\n"))
    d, _, _ = A.distinct_pairs(of_l, A.word_hashes(data, begin_l, end_l))
    out["distinct_lines"] = np.bincount(d, minlength=n) / np.maximum(np.bincount(of_l, minlength=n), 1)
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    out["longest_word"] = np.log1p(longest)
    tail, head = data[end - 1], data[begin]
    out["symbol_ends"] = A.per_doc(CLASSES["symbol"][tail] | CLASSES["mark"][tail], of, n) / words
    out["upper_words"] = A.per_doc(CLASSES["upper"][head], of, n) / words
    out["digit_words"] = A.per_doc(CLASSES["digit"][head], of, n) / words
    out["short_words"] = A.per_doc(length <= 2, of, n) / words
    return np.column_stack([out[k] for k in STATISTICS])


@dataclass
class Trees:
    """All trees in arrays: node i of tree t tests feature[t, i] > edge[t, i] and goes to 2i + 1 + that; leaves add value[t, i]."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    start: float = 0.0
    depth: int = 0
    names: tuple[str, ...] = field(default=STATISTICS)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.value)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.edge[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 2.0, least: float = 8.0) -> Trees:
    """Boosted trees for the log loss: at each level the best split of every node is read from histograms of gradients over binned values."""
    nodes = 2 ** (depth + 1) - 1
    feature, edge, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    if not len(y):
        return Trees(feature[:0], edge[:0], value[:0], 0.0, depth)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    total = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            low, wide = 2**level - 1, 2**level
            at = node - low
            gain = np.full((wide, f, bins), -np.inf)
            for j in range(f):
                key = at * bins + binned[:, j]
                gs, hs = (np.bincount(key, weights=w, minlength=wide * bins).reshape(wide, bins).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                with np.errstate(divide="ignore", invalid="ignore"):
                    won = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[:, j] = np.where((hs * 4 > least) & ((ht - hs) * 4 > least), won, -np.inf)
                gain[:, j, len(cuts[j]) :] = -np.inf
            best = gain.reshape(wide, -1).argmax(1)
            for i in range(wide):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6:
                    feature[t, low + i], edge[t, low + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > edge[t, node])
        gs, hs = (np.bincount(node, weights=w, minlength=nodes) for w in (g, h))
        value[t] = rate * gs / (hs + ridge)
        total += value[t, node]
    return Trees(feature, edge, value, start, depth)


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and x, an array of STATISTICS, for every row."""
    keep_types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                x = statistics(data, bounds)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in keep), lists], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(rows, ", ".join(f"`{c}` {keep_types[c]}" for c in keep) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `most` labelled rows outside the held-out fold; repeated labels of a document count as their mean."""
    labels = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    sample = bounded(labels.groupBy("doc_id").agg(F.avg("quality").alias("quality")), "doc_id", most)
    rows = measure(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "quality"]).toPandas().sort_values("doc_id", kind="stable")
    return grow(np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(STATISTICS)), rows["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """row (a struct of the columns of keep) and score of every row, in one pass without a shuffle."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["row"].slice(i, j - i), pa.array(model.score(statistics(data, bounds)))], ["row", "score"])

    return held.mapInArrow(rows, T.StructType([held.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, model, ["doc_id"])
    return scored.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
