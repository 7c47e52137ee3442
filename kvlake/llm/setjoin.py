"""N-gram Jaccard join: groups of documents whose sets of word shingles are alike, by a size-aware heavy-light join.

Sets: ASCII letters in lower case, words between white space, the distinct runs of `width` words; a text of fewer words is one run, and a
text without words has an empty set and is linked with nothing. Two sets link when 100 * common >= percent * united. The result gives each
document its set's size and the least doc_id that links reach.

* Documents of equal sets meet first, by a hash of the set, and count as one node from there on; copies are never expanded into pairs.
* Light sets (at most `boundary` shingles) are joined by subsets of fixed size: sets of sizes s and t link if and only if they share a
  subset of the size that their link needs, so each light set sends all its subsets of each such size. Equal subsets are links as they
  stand, and the smallest set of a subset's list links to every other set that any two of the list could link to: no pairs are needed.
* Heavy sets are joined by inverted lists over prefixes: in one order of all shingles, two sets that link share one of their first
  n - ceil(percent * n / 100) + 1, and the first that they share leaves enough after it in both. Rare shingles come first in that order, by
  a count over all documents in a table of fixed size (SKETCH counters). The order decides only the cost, never the result.
* The boundary is where subsets get dearer than lists, by the counts of the sets of each size.
* A list is not expanded into pairs, and a pair's sets are fetched only if their parities, a few words each, allow a link. Each list's hub is compared with the others, links are merged into groups, and only lists
  that still hold sets of different groups go on: each set is compared with a few drawn from other groups, as long as that finds many links,
  and at last come the pairs of different groups that have not been compared. So a group of near copies costs a few comparisons a member,
  and no link between different groups is lost; pairs that parities rule out are dropped where they meet. A set's first comparison is with the hub of most of its lists; the hubs of its
  other lists follow only where they are still in another group.

Nulls and edges: a null or empty text has size 0 and its own doc_id; a null doc_id never becomes a component's id unless all its members
are null; rows repeated in full are alike and so in one group; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm.lines import row_id
from kvlake.llm.store import cut, release

WIDTH, PERCENT = 5, 80
#: Counters of the frequency table: a fixed size, whatever the input.
SKETCH = 1 << 20
PARTS = 16
#: Bytes of text that are worked on at once.
SLICE_BYTES = 500_000
#: Bits of a set's parity.
PARITY = 1_024
PARITIES = tuple(f"p{k}" for k in range(PARITY // 64))
#: No set of more shingles is joined by subsets.
LIGHT_MOST = 12
#: A posting costs this many subsets, since what it finds has to be fetched and compared.
POSTING_COST = 4
#: Beyond so many open pairs a member, as many others as DRAWN are drawn for each before all open pairs are compared.
OPEN_PAIRS, DRAWN = 4, 3


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """Least number of common shingles with which sets of sizes s and t link."""
    return -(-percent * (s + t) // (100 + percent))


@lru_cache(maxsize=4096)
def subset_sizes(s: int, percent: int = PERCENT) -> tuple[int, ...]:
    """Sizes of subsets by which a set of s shingles may have to meet another of up to LIGHT_MOST."""
    return tuple(sorted({c for t in range(1, LIGHT_MOST + 1) if (c := needed(s, t, percent)) <= min(s, t)}))


def choose_boundary(by_size: dict[int, int], percent: int = PERCENT) -> int:
    """Of the sizes up to LIGHT_MOST the one up to which subsets are cheaper than postings, by the number of sets of each size."""

    def cost(boundary: int) -> int:
        total = 0
        for s, n in by_size.items():
            if s <= boundary:
                total += n * sum(math.comb(s, c) for c in subset_sizes(s, percent))
            if 100 * s >= percent * (boundary + 1):
                total += n * POSTING_COST * (s - needed_alone(s, percent) + 1)
        return total

    return min(range(LIGHT_MOST + 1), key=lambda b: (cost(b), b))


def needed_alone(s: int, percent: int = PERCENT) -> int:
    """Least number of common shingles that a set of s needs for any link."""
    return -(-percent * s // 100)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, in order of both."""
    n = len(bounds) - 1
    begin, end, doc = A.words(data, bounds, A.SPACED)
    hashes = A.word_hashes(A.LOWER[data], begin, end)
    rolled = A.grams(hashes, width)
    inside = doc[: len(rolled)] == doc[width - 1 :] if len(rolled) else np.zeros(0, bool)
    counts = np.bincount(doc, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.searchsorted(doc, short)
    whole = A.Rolling(hashes).of(first, first + counts[short]) if len(short) else np.zeros(0, np.uint64)
    d, h, _ = A.distinct_pairs(np.concatenate([doc[: len(rolled)][inside], short]), np.concatenate([rolled[inside], whole]))
    return d, h


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles of all documents fall on each of SKETCH counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in A.texts(batch["text"], SLICE_BYTES):
                _, h = shingle_sets(data, bounds, width)
                total += np.bincount((h % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        if total.any():
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "task": pa.array([task] * PARTS, pa.int32()), "counts": [zlib.compress(x.tobytes(), 1) for x in total.reshape(PARTS, -1)]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in table["counts"].to_pylist())
        return pa.table({"part": table["part"][:1].cast(pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    counts = docs.select("text").mapInArrow(count, "part int, task int, counts binary")
    first = counts.select("part", (F.col("task") % 64).alias("branch"), "counts").groupBy("part", "branch").applyInArrow(add, "part int, counts binary")
    out = np.zeros((PARTS, SKETCH // PARTS), dtype=np.int64)
    for row in first.groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[row["part"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    return out.ravel().astype(np.float32)  # an order is all that is asked of it


def _nodes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """doc_id, rid, n, node (hash of the set), prefix (its first shingles in the common order), light (all shingles of a small set)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"], SLICE_BYTES):
                n = j - i
                doc, h = shingle_sets(data, bounds, width)
                size = np.bincount(doc, minlength=n)
                node = np.zeros(n, dtype=np.uint64)
                np.add.at(node, doc, A.mix(h))
                node = A.mix(node + size.astype(np.uint64) * A.VALUES[1])
                weight = counts[(h % np.uint64(SKETCH)).astype(np.int64)]
                order = np.lexsort((h, weight, doc))
                first = np.cumsum(size) - size
                place = np.arange(len(doc)) - first[doc]
                length = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                take = place < length[doc]
                prefix = h[order][take]
                small = (size <= LIGHT_MOST)[doc]
                lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(i, n), batch["rid"].slice(i, n), pa.array(size.astype(np.int32)), pa.array(node.view(np.int64)), lists(length, prefix), lists(np.where(size <= LIGHT_MOST, size, 0), h[small])],
                    ["doc_id", "rid", "n", "node", "prefix", "light"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", row_id().alias("rid"), "text").mapInArrow(rows, f"doc_id {kind}, rid long, n int, node long, prefix array<long>, light array<long>")


def _subset_links(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links (a, b) among the light sets, by equal subsets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out_n, out_node, sizes = [], [], [], []
            for n, node, light in zip(batch["n"].to_pylist(), batch["node"].to_pylist(), batch["light"].to_pylist(), strict=True):
                values = np.array(light, dtype=np.int64).view(np.uint64)
                for c in subset_sizes(n, percent):
                    picks = np.array(list(combinations(range(n), c)))
                    hashed = A.mix(A.mix(values[picks]).sum(1) + np.uint64(c * int(A.VALUES[2]) % 2**64))
                    keys.append(hashed.view(np.int64))
                    out_n += [n] * len(hashed)
                    out_node += [node] * len(hashed)
                    sizes += [c] * len(hashed)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(sizes, pa.int32()), pa.array(out_n, pa.int32()), pa.array(out_node, pa.int64())], ["subset", "c", "n", "node"])

    light = nodes.where((F.col("n") > 0) & (F.col("n") <= boundary)).select("n", "node", "light").dropDuplicates(["node"])
    subsets = light.mapInArrow(rows, "subset long, c int, n int, node long")
    hubs = subsets.groupBy("subset", "c").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("times")).where("times > 1").drop("times")
    met = subsets.join(hubs, ["subset", "c"]).where((F.col("node") != F.col("hub.node")) & (100 * F.col("c") >= percent * (F.col("n") + F.col("hub.n") - F.col("c"))))
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """node, label (one node of each component) for all nodes of links (a, b).

    Each node points to its least neighbour, pointers are followed four deep, and the links are drawn between what they point to, until
    none is left: the graph shrinks by half or more each time.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    label = None
    while True:
        edges = cut(edges)
        if edges.isEmpty():
            return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        parent = edges.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("p"))
        for _ in range(2):
            above = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p").select("a", F.col("pp").alias("p"))
        parent = cut(parent)
        if label is None:
            label = parent.select(F.col("a").alias("node"), F.col("p").alias("label"))
        else:
            label = cut(label.join(parent, F.col("label") == F.col("a"), "left").select("node", F.coalesce("p", "label").alias("label")))
        one, two = (parent.select(F.col("a").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        edges = edges.join(one, "a").join(two, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """label with the components of more links between nodes."""
    if label is None:
        return components(links)
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    drawn = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(drawn).select(F.col("node").alias("was"), F.col("label").alias("now"))
    moved = label.join(more, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label"))
    new = more.join(label, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("label"))
    return cut(moved.union(new))


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, shingles and parity (PARITY bits: how many shingles fall on each, modulo 2) of the wanted nodes, from one document of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"], SLICE_BYTES):
                doc, h = shingle_sets(data, bounds, width)
                offsets = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                bits = np.bincount(doc * PARITY + (A.mix(h) % np.uint64(PARITY)).astype(np.int64), minlength=(j - i) * PARITY).reshape(-1, PARITY) & 1
                words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).reshape(j - i, -1)
                size = pa.array(np.diff(offsets).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch["node"].slice(i, j - i), size, pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64))), *(pa.array(w) for w in words.T)], ["node", "n", "shingles", *PARITIES])

    chosen = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid"))
    held = docs.select(row_id().alias("rid"), "text").join(chosen, "rid").select("node", "text").dropDuplicates(["node"])
    return held.mapInArrow(rows, "node long, n int, shingles array<long>, " + ", ".join(f"{p} long" for p in PARITIES))


def may_link(one: Column, two: Column, percent: int) -> Column:
    """Whether two sets (structs of n and parity) may link: they differ in at least as many shingles as their parities differ in bits."""
    apart = sum((F.bit_count(one[p].bitwiseXOR(two[p])) for p in PARITIES), F.lit(0))
    n = one["n"] + two["n"]
    return apart <= n - 2 * F.ceil(percent * n / (100 + percent))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Only pairs that may link by their parities fetch their shingles."""
    one, two = (sets.select(F.col("node").alias(x), F.struct("n", *PARITIES).alias(f"of_{x}")) for x in "ab")
    close = pairs.join(two, "b").join(one, "a").where(may_link(F.col("of_a"), F.col("of_b"), percent)).select("a", "b")
    return _compared(cut(close), sets, percent)


def _compared(close: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    wanted = close.select(F.col("a").alias("node")).union(close.select("b")).distinct()
    some = cut(sets.select("node", "shingles").join(wanted, "node", "left_semi"))
    one, two = (some.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "ab")
    met = close.join(two, "b").join(one, "a").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return met.where(100 * F.col("common") >= percent * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, rid, n_shingles, component_id for every row of docs."""
    return labelled(docs, width, percent).drop("label")


def labelled(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """groups() with label, which tells groups apart even where their ids are null or equal; null for texts without words."""
    made = cut(_nodes(docs, _frequencies(docs, width), width, percent))
    nodes = cut(made.select("doc_id", "rid", "n", "node"))
    by_size = {r["n"]: r["count"] for r in nodes.where((F.col("n") > 0) & (F.col("n") <= 2 * LIGHT_MOST)).groupBy("n").count().collect()}
    boundary = choose_boundary(by_size, percent)
    links = cut(_subset_links(made, boundary, percent))

    # inverted lists: sets that can link to a heavy one, one row for each set; each list with a hub, its least set by hash
    heavy = cut(made.where(100 * F.col("n") >= percent * (boundary + 1)).groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix")))
    release(made)
    postings = heavy.select(F.posexplode("prefix").alias("place", "token"), "node", "n")
    me = F.struct("n", "node", "place")
    # the hub's size and place travel in one number, as Spark aggregates numbers by hash alone
    both = F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")
    hub = F.struct(F.shiftright("held", 32).cast("int").alias("n"), "node", F.col("held").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"))
    hubs = postings.groupBy("token").agg(F.min("node").alias("node"), F.min_by(both, "node").alias("held"), F.count("*").alias("times"))
    hubs = cut(hubs.where("times > 1").select("token", hub.alias("hub")))
    lists = cut(postings.join(hubs, "token").select("token", "node", me.alias("me"), "hub"))
    release(heavy, hubs)

    def open_pairs(one: str, two: str) -> Column:
        """Whether sizes, and what is left from the token on, allow a link between two members of a list."""
        (n, i), (m, j) = ((F.col(f"{x}.n"), F.col(f"{x}.place")) for x in (one, two))
        enough = (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)
        return (F.col(f"{one}.node") != F.col(f"{two}.node")) & enough & (100 * F.least(n, m) >= percent * F.greatest(n, m))

    # first each set with the hub of most of its lists, then with those of its other lists that are still in another group
    hubbed = cut(lists.where(open_pairs("hub", "me")).groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("k")))
    first = hubbed.groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a")).select("a", "b")
    sets = cut(_sets(docs, nodes, lists.select("node").distinct(), width))
    label = _merged(None, links.union(cut(_linked(first, sets, percent))))
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))
    apart = hubbed.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
    rest = cut(apart.select("a", "b").join(first, ["a", "b"], "left_anti"))
    label = _merged(label, cut(_linked(rest, sets, percent)))
    tested = cut(ordered(first).union(ordered(rest)))
    lists, turn, worth = lists.select("token", "node", "me"), 0, True
    while True:
        turn += 1
        coloured = lists.join(label, "node", "left").select("token", "node", "me", F.coalesce("label", "node").alias("label"))
        mixed = coloured.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
        open_lists = cut(coloured.join(cut(mixed), "token"))
        classes = open_lists.groupBy("token", "label").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"))
        n_open, n_members = classes.agg(F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2), F.sum("k")).first()
        if not n_open:
            break
        drawn = n_open > OPEN_PAIRS * n_members and worth
        # pairs that can't link by their parities are dropped where they meet
        with_parity = open_lists.join(sets.select("node", F.struct("n", *PARITIES).alias("parity")), "node").select("token", "label", "me", "parity")
        if drawn:
            order = Window.partitionBy("token").orderBy(F.xxhash64("me.node", F.lit(turn)))
            near = F.array(*[F.lead(F.struct("me", "label", "parity"), k).over(order) for k in range(1, DRAWN + 1)])
            met = with_parity.withColumn("near", near).select("me", "label", "parity", F.explode("near").alias("c"))
            met = met.select("me", "label", "parity", F.col("c.me").alias("other"), F.col("c.label").alias("other_label"), F.col("c.parity").alias("other_parity"))
        else:
            other = with_parity.select("token", F.col("me").alias("other"), F.col("label").alias("other_label"), F.col("parity").alias("other_parity"))
            met = with_parity.join(other, "token").where(F.col("me.node") < F.col("other.node"))
        met = met.where((F.col("label") != F.col("other_label")) & open_pairs("me", "other") & may_link(F.col("parity"), F.col("other_parity"), percent))
        pairs = ordered(met.select(F.col("me.node").alias("a"), F.col("other.node").alias("b"))).distinct()
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"))
        found = cut(_compared(pairs, sets, percent))
        tested = tested.union(pairs)
        label = _merged(label, found)
        if not drawn:
            break
        worth = 100 * found.count() > n_members
        lists = open_lists.drop("label")

    known = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    by_label = known.join(label, "node").groupBy("label").agg(F.min("least").alias("component"))
    far = label.join(by_label, "label").select("node", "label", "component")
    least = known.join(far, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("component", "least").alias("component_id"))
    return nodes.select("doc_id", "rid", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(least, "node", "left").select(
        "doc_id", "rid", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label"
    )


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group stays (the least doc_id); rows without words all stay."""
    found = cut(labelled(docs).where("n_shingles > 0"))
    stay = found.groupBy("label").agg(F.min(F.struct("doc_id", "rid")).alias("first")).select("first.rid").distinct()
    gone = cut(found.select("rid").distinct().join(stay, "rid", "left_anti").select(F.col("rid").alias("gone_rid")))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("rid")).join(gone, F.col("rid") == F.col("gone_rid"), "left_anti")
    # of rows with words and equal id and text, the one that comes first as JSON
    twice = found.groupBy("rid").agg(F.count("*").alias("k")).where("k > 1").select(F.col("rid").alias("twice_rid"))
    if twice.isEmpty():
        return held.select("row.*")
    held, twice = cut(held), cut(twice)
    again = F.col("rid") == F.col("twice_rid")
    one = held.join(twice, again, "left_semi").groupBy("rid").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return held.join(twice, again, "left_anti").select("row.*").union(one.select("row.*"))
