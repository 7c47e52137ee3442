"""Approximate nearest neighbours by cosine, with an inverted multi-index.

Both halves of the (normalised) vectors are quantised by themselves, to as many centroids each as centroids() says for the number of
vectors, learned by k-means on a bounded sample (SAMPLE_ROWS, the only bound here); a cell is a pair of centroids, and every vector is in
the index. A query walks through cells by the sum of its halves' distances to the centroids, with a heap, until they hold the share of all
vectors that the sample needs for a recall of RECALL. What the cells hold is compared exactly, in double precision: products of matrices
choose, with a margin, and what they choose is scored by one fixed routine.

Equal vectors are one entry, with the NEAREST + 1 least ids of each: no answer needs more, so a vector that a third of all rows share costs
as much as any other. Cells are dealt into blocks of about BLOCK entries, and queries into lots of QUERIES, so that no task grows with the
table; each block is sent once for each lot, which is little beside the BLOCK times QUERIES comparisons made with it.

Vectors that are null, zero, or hold a null or a number that isn't finite take no part, nor do rows without an id. Vectors are compared
with those of their own dimension, as there is no cosine between others; the index is over the most frequent dimension, and in the others
all are compared. Very large and very small components neither overflow nor vanish. Rows of one id count once (the vector with the least
hash). Ties go to smaller ids. With fewer candidates than NEAREST, all are returned. An empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.sampling import bounded
from kvlake.llm.store import cut

NEAREST = 5
EVERY = 50
SAMPLE_ROWS = 10_000
RECALL = 0.94
#: Beside the share of vectors that the sample asks for.
SPARE = 0.01
#: Scores by products of matrices are right to far less than this.
MARGIN = 1e-9
BLOCK, QUERIES = 4_000, 20_000
#: Queries that are compared with a block at once, so that the scores held stay small.
SLICE = 500


def centroids(n: int) -> int:
    """Centroids of each half for n vectors: cells get more, and fuller, as the table grows."""
    return int(np.clip(round(2 * n**0.25), 4, 256))


def entries(vectors: DataFrame) -> DataFrame:
    """vec_id, h (hash of the vector), vector: a row for each id that takes part."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = vectors.where("vec_id is not null and embedding is not null").where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    # adding 0.0 makes one of both zeros, so that equal vectors have one hash
    rows = good.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)).alias("vector"))
    rows = rows.select("vec_id", F.xxhash64("vector").alias("h"), "vector")
    return rows.groupBy("vec_id").agg(F.min("h").alias("h"), F.min_by("vector", "h").alias("vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension in double precision, each times a power of two that makes its largest component about 1 (which changes no cosine)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows with rows: always by the same steps, so that equal vectors have equal scores wherever they are compared."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def kmeans(x: np.ndarray, k: int, rounds: int = 20, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        near = distances(x, centre).argmin(1)
        for c in range(len(centre)):
            if (near == c).any():
                centre[c] = x[near == c].mean(0)
    return centre


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)


class MultiIndex:
    """The two sets of centroids."""

    def __init__(self, sample: np.ndarray, n: int):
        """sample: vectors of one dimension, of a table of n."""
        unit = self.unit(sample)
        self.dimension, self.half = unit.shape[1], unit.shape[1] // 2
        self.left, self.right = kmeans(unit[:, : self.half], centroids(n)), kmeans(unit[:, self.half :], centroids(n), seed=12)
        self.share = self.calibrate(unit)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(unit[:, : self.half], self.left), distances(unit[:, self.half :], self.right)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return a.argmin(1) * len(self.right) + b.argmin(1)

    def walk(self, a: np.ndarray, b: np.ndarray, held: dict[int, int], enough: float) -> Iterator[int]:
        """Cells that hold anything, by the sum of distances, until they hold enough: a and b are one query's distances."""
        by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen, got = [(a[by_a[0]] + b[by_b[0]], 0, 0)], {(0, 0)}, 0
        while heap and got < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(by_a[i]) * len(self.right) + int(by_b[j])
            if held.get(cell):
                got += held[cell]
                yield cell
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(by_a) and y < len(by_b) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[by_a[x]] + b[by_b[y]], x, y))

    def calibrate(self, unit: np.ndarray, queries: int = 200) -> float:
        """The share of the sample that has to be walked through for RECALL of the nearest of sampled queries."""
        n = len(unit)
        if n <= NEAREST + 1:
            return 1.0
        asked = np.arange(0, n, max(1, n // queries))
        cells = self.cells(unit)
        held = dict(zip(*np.unique(cells, return_counts=True), strict=True))
        near = unit[asked] @ unit.T
        near[np.arange(len(asked)), asked] = -2
        top = np.argpartition(-near, NEAREST, axis=1)[:, :NEAREST]
        a, b = self.halves(unit[asked])
        needed = []
        for q in range(len(asked)):
            got, after = 0, {}
            for cell in self.walk(a[q], b[q], held, n):
                after[cell] = got  # a cell is entered if less than enough came before it
                got += held[cell]
            needed += [after[int(c)] / n for c in cells[top[q]]]
        return min(1.0, float(np.quantile(needed, RECALL)) + SPARE)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each dimension."""
    size = batch["vector"].value_lengths().to_numpy()
    for d in np.unique(size).tolist():
        yield d, batch.filter(pa.array(size == d))


def search(vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest of each row whose vec_id is divisible by `every`."""
    rows = cut(entries(vectors))
    least = Window.partitionBy("h").orderBy("vec_id")
    members = cut(rows.select("h", "vec_id").withColumn("place", F.row_number().over(least)).where(F.col("place") <= nearest + 1))
    distinct = cut(rows.join(members.where("place = 1").select("vec_id"), "vec_id", "left_semi").select("h", "vector"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "h")
    most = distinct.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    sample = bounded(distinct.where(F.size("vector") == most["d"]), "h", SAMPLE_ROWS).select("vector").toArrow()
    index = MultiIndex(matrix(sample["vector"]), most["count"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, some in by_dimension(batch):
                cell = index.cells(index.unit(matrix(some["vector"]))) if d == index.dimension else np.full(some.num_rows, -d)
                yield pa.RecordBatch.from_arrays([some["h"], some["vector"], pa.array(cell.astype(np.int32))], ["h", "vector", "cell"])

    kind = distinct.schema["vector"].dataType.simpleString()
    placed = cut(distinct.mapInArrow(place, f"h long, vector {kind}, cell int"))
    held = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    blocks = {c: -(-n // BLOCK) for c, n in held.items()}
    enough = index.share * most["count"]
    asked = distinct.join(queries.select("h").distinct(), "h", "left_semi")
    lots = max(1, -(-asked.count() // QUERIES))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, some in by_dimension(batch):
                row, cell, block = [], [], []
                if d == index.dimension:
                    a, b = index.halves(index.unit(matrix(some["vector"])))
                for q in range(some.num_rows):
                    for c in index.walk(a[q], b[q], held, enough) if d == index.dimension else (-d,):
                        row += [q] * blocks[c]
                        cell += [c] * blocks[c]
                        block += range(blocks[c])
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([some["h"].take(at), some["vector"].take(at), pa.array(cell, pa.int32()), pa.array(block, pa.int32())], ["query", "vector", "cell", "block"])

    def compare(one: pa.Table, two: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("entry", pa.int64()), ("score", pa.float64())])
        if not one.num_rows or not two.num_rows:
            return schema.empty_table()
        v, q = matrix(one["vector"]), matrix(two["vector"])
        unit, k = MultiIndex.unit(v), min(nearest + 1, len(v))
        query, entry, found = two["query"].to_numpy(), one["h"].to_numpy(), []
        for at in range(0, len(q), SLICE):
            some = q[at : at + SLICE]
            score = MultiIndex.unit(some) @ unit.T
            # all that may tie with the last place stay: exact scores, then ids, decide later
            last = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(score >= last - MARGIN)
            found.append(pa.table([query[at + i], entry[j], cosines(some[i], v[j])], schema=schema))
        return pa.concat_tables(found)

    salt = F.pmod(F.xxhash64("h"), F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]), F.col("cell"))).cast("int")
    left = placed.withColumn("block", salt).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    right = asked.select("h", "vector").mapInArrow(walk, f"query long, vector {kind}, cell int, block int").withColumn("lot", F.pmod(F.xxhash64("query"), F.lit(lots)).cast("int"))
    keys = ("cell", "block", "lot")
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query long, entry long, score double")
    ids = members.select(F.col("h").alias("entry"), "vec_id", "place")
    first = met.join(ids.where("place = 1").select("entry", F.col("vec_id").alias("least")), "entry")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    first = cut(first.withColumn("r", F.row_number().over(best)).where(F.col("r") <= nearest + 1).select("query", "entry", "score"))
    all_ids = first.join(ids, "entry").select(F.col("query").alias("h"), "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = queries.join(all_ids, "h").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return out.select("query_id", "rank", "vec_id", "score")
