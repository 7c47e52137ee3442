"""Benchmark decontamination: documents that hold benchmark items, word for word or with other numbers, names and units.

Template canonicalisation: a text's words (runs of letters and digits) keep their place and lose their case; those that begin with a digit
become a number slot, those that begin with a capital a name slot (not in a text without small letters, where capitals tell nothing), and
units of measure a unit slot. Windows of WINDOW template words are hashed, and windows of the plain words beside them, which find copies
in any case. All windows of all documents are joined with the items' windows, matches are gathered by document, item and diagonal (place
in the document less place in the item), and a match counts as a leak if at least MIN_WORDS words (or the whole item, if that is shorter)
are covered by windows whose slots are consistent: each value of the item stands for one value of the document, which holds for copies
and for re-parameterised questions, not for chance meetings of templates. Where a value stands for several, either the windows over all
but its most frequent one are left out, like those over any changed word, or a stretch within which it stands for one is taken, whichever
covers more. Template windows of items that have slots and less than half of WINDOW words besides are left out as too vague, unless an item of
WINDOW words or more has no other; their plain windows count. Items of fewer than WINDOW words have one window of their whole length, and
documents have windows of each such length.

Nulls and edges: null and empty texts have no windows and never match; null ids are carried; rows repeated in full are reported once, as
are items; of several texts of one item id, the best match is; of matches that tie in words, the one of more windows, then the one with
other values in its slots; empty tables give an empty result; extra columns are ignored, whatever their names. What is joined is a few
numbers for each window, never words, so a very long text costs in proportion to its length.

Everything is DataFrame functions. The items' windows are broadcast only while they are at most BROADCAST_ROWS, counted first; beyond that
the join shuffles. Matches are aggregated per document before any shuffle; words are fetched for the diagonals that are long enough alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.lines import row_id
from kvlake.llm.store import cut

WINDOW = 8
MIN_WORDS = 12
BROADCAST_ROWS = 200_000

# Units of measure, in lower case.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "ms", "min", "h", "hz", "w", "kw", "v", "j", "k", "b", "kb", "mb", "gb", "tb", "usd", "eur", "gbp", "percent")

NUMBER, NAME, UNIT = -1, -2, -3


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_words(rows: DataFrame) -> DataFrame:
    """rows with words (of text, without case), plain (their hashes) and names (the same with slots as negative numbers)."""
    rows = rows.withColumn("cased", tokens(F.col("text"))).withColumn("telling", F.col("text").rlike(r"\p{Ll}"))
    rows = rows.withColumn("words", F.transform("cased", lambda w: F.lower(F.upper(w))))
    rows = rows.withColumn("plain", F.transform("words", lambda w: F.shiftrightunsigned(F.xxhash64(w), 1)))

    def slot(cased: Column, i: Column) -> Column:
        first = F.ascii(cased)
        return (
            F.when(first.between(48, 57) | (first > 127) & cased.rlike(r"^\p{N}"), F.lit(NUMBER).cast("long"))
            .when(F.col("telling") & (first.between(65, 90) | (first > 127) & cased.rlike(r"^[\p{Lu}\p{Lt}]")), F.lit(NAME).cast("long"))
            .when(F.get("words", i).isin(*UNITS), F.lit(UNIT).cast("long"))
            .otherwise(F.get("plain", i))
        )

    return rows.withColumn("names", F.transform("cased", slot)).drop("text", "cased", "telling")


def with_windows(rows: DataFrame) -> DataFrame:
    """rows with windows: the hash of the WINDOW names from each place that has as many, and then of the WINDOW plain words (null where equal).

    Rows of fewer words have no windows; an outer explode keeps Spark from computing them once more as a filter. Hashes of pairs, then of pairs of pairs, and so on; each level is a column of its own, so that it is computed once.
    """
    rows, step = rows.withColumn("typed", F.col("names")).withColumn("verbatim", F.col("plain")), 1
    while step < WINDOW:
        rows = rows.withColumn("size", F.greatest(F.size("typed") - step, F.lit(0)))
        for c in ("typed", "verbatim"):
            rows = rows.withColumn(c, F.zip_with(F.slice(c, F.lit(1), F.col("size")), F.slice(c, F.lit(step + 1), F.col("size")), lambda a, b: F.xxhash64(a, b)))
        step *= 2
    return rows.withColumn("windows", F.concat("typed", F.zip_with("typed", "verbatim", lambda a, b: F.when(a != b, b)))).withColumn("size", F.size("typed")).drop("typed", "verbatim")


def short_windows(n: int) -> Column:
    """The windows of n words, under WINDOW, as with_windows has them."""
    starts = F.when(F.size("names") >= n, F.sequence(F.lit(1), F.size("names") - n + 1)).otherwise(F.array().cast("array<int>"))
    of = lambda c: F.transform(starts, lambda i: F.xxhash64(F.lit(n), F.slice(c, i, n)))
    typed, verbatim = of("names"), of("plain")
    return F.concat(typed, F.zip_with(typed, verbatim, lambda a, b: F.when(a != b, b)))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (a key of its id and text), item_id, and the words of each item, as with_words has them."""
    return with_words(benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"]))


def item_windows(items: DataFrame) -> DataFrame:
    """window, item, item_words and at of each window of the items."""
    items = with_windows(items)
    n = F.size("words")
    short = n.between(1, WINDOW - 1)
    typed, verbatim = F.xxhash64(n, "names"), F.xxhash64(n, "plain")
    items = items.withColumn("windows", F.when(short, F.array(typed, F.when(typed != verbatim, verbatim))).otherwise(F.col("windows"))).withColumn("size", F.when(short, 1).otherwise(F.col("size")))
    rows = items.select("item", n.alias("item_words"), "names", "size", F.posexplode("windows").alias("pos", "window"))
    rows = rows.withColumn("at", F.col("pos") % F.col("size")).withColumn("verbatim", F.col("pos") >= F.col("size"))
    clear = F.size(F.filter(F.slice("names", F.col("at") + 1, WINDOW), lambda x: x >= 0))
    vague = ~F.col("verbatim") & (clear < WINDOW // 2) & (clear < F.least(F.lit(WINDOW), F.col("item_words")))
    rows = rows.withColumn("vague", vague).where("window is not null")
    all_vague = rows.groupBy("item").agg(F.min(F.when(~F.col("verbatim"), F.col("vague"))).alias("all_vague"))
    rows = rows.join(all_vague, "item").where(f"not vague or all_vague and item_words >= {WINDOW}")
    return rows.select("window", "item", "item_words", "at").dropDuplicates(["window", "item", "at"])


def covered(places: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(places, lambda at: F.sequence(at, at + F.col("width") - 1))))


def consistent(runs: DataFrame) -> DataFrame:
    """runs (places of windows on a diagonal, and pairs of values a of the item and b of the document at slots p) with n_words and n_windows, and pairs of what is consistent.

    n_words is the number of words covered by windows without the lesser pairs of values, or the longest stretch of covered words without a conflict.
    """
    runs = runs.withColumn("width", F.least(F.lit(WINDOW), F.col("item_words")))
    value = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))
    runs = runs.withColumn("values", F.array_distinct(F.transform("pairs", value)))
    clash = F.size(F.array_distinct(F.transform("values", lambda v: v["a"]))) < F.size("values")
    counted = F.transform("values", lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"), F.size(F.filter("pairs", lambda x: value(x) == v)).alias("n")))
    runs = runs.withColumn("counted", F.when(clash, counted))
    more = lambda v, w: (v["a"] == w["a"]) & ((w["n"] > v["n"]) | ((w["n"] == v["n"]) & (w["b"] < v["b"])))
    runs = runs.withColumn("lesser", F.transform(F.filter("counted", lambda v: F.exists("counted", lambda w: more(v, w))), value))
    runs = runs.withColumn("bad", F.transform(F.filter("pairs", lambda x: F.array_contains("lesser", value(x))), lambda x: x["p"]))
    runs = runs.withColumn("left", F.when(F.col("bad").isNull(), F.col("places")).otherwise(F.filter("places", lambda at: ~F.exists("bad", lambda p: p.between(at, at + F.col("width") - 1)))))
    runs = runs.withColumn("all_words", F.array_sort(covered(F.col("places"))))

    # a word's stretch begins after the last gap, and after the last earlier pair that conflicts with one of the stretch
    def step(state: Column, p: Column) -> Column:
        here = F.filter("pairs", lambda x: x["p"] == p)
        against = F.filter("pairs", lambda y: (y["p"] < p) & F.exists(here, lambda x: (x["a"] == y["a"]) & (x["b"] != y["b"])))
        first = F.greatest(F.when(state["last"] == p - 1, state["first"]).otherwise(p), F.array_max(F.transform(against, lambda y: y["p"] + 1)))
        longer = p - first + 1 > state["to"] - state["from"]
        return F.struct(p.alias("last"), first.alias("first"), F.when(longer, first).otherwise(state["from"]).alias("from"), F.when(longer, p + 1).otherwise(state["to"]).alias("to"))

    zero = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("first"), F.lit(0).alias("from"), F.lit(0).alias("to"))
    runs = runs.withColumn("stretch", F.when(F.col("bad").isNotNull(), F.aggregate("all_words", zero, step)))
    runs = runs.withColumn("n_left", F.when(F.col("bad").isNull(), F.size("all_words")).otherwise(F.size(covered(F.col("left")))))
    runs = runs.withColumn("n_stretch", F.coalesce(F.col("stretch.to") - F.col("stretch.from"), F.lit(0)))
    by_stretch = F.col("n_stretch") > F.col("n_left")
    inside = lambda at: (at >= F.col("stretch.from")) & (at + F.col("width") <= F.col("stretch.to"))
    left = F.when(by_stretch, F.filter("places", inside)).otherwise(F.col("left"))
    held = lambda x: F.when(by_stretch, (x["p"] >= F.col("stretch.from")) & (x["p"] < F.col("stretch.to"))).otherwise(F.exists("left", lambda at: x["p"].between(at, at + F.col("width") - 1)))
    return runs.withColumn("n_words", F.greatest("n_left", "n_stretch")).withColumn("n_windows", F.size(left)).withColumn("pairs", F.filter("pairs", held))


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """rid, doc_id, item_id, n_windows, n_words (of the longest match), share (of the item), reparameterised, for each leaked pair."""
    items = cut(benchmark_items(benchmark))
    windows = cut(item_windows(items))
    lengths = [r[0] for r in windows.where(F.col("item_words") < WINDOW).select("item_words").distinct().collect()]
    few = windows.count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    texts = docs.select("doc_id", row_id().alias("rid"), "text")
    windowed = with_windows(with_words(texts))
    places = windowed.select("doc_id", "rid", "size", F.posexplode_outer("windows").alias("pos", "window"))
    for n in lengths:
        places = places.union(windowed.select("doc_id", "rid", F.greatest(F.size("words") - n + 1, F.lit(0)).alias("size"), F.posexplode_outer(short_windows(n)).alias("pos", "window")))
    places = places.select("doc_id", "rid", "window", (F.col("pos") % F.col("size")).alias("place"))
    met = places.join(small(windows), "window").select("rid", "doc_id", "item", "item_words", "at", (F.col("place") - F.col("at")).alias("diagonal"))
    # a diagonal whose windows cover too little is none, whatever its slots hold
    runs = met.groupBy("rid", "doc_id", "item", "item_words", "diagonal").agg(F.collect_set("at").alias("places")).withColumn("width", F.least(F.lit(WINDOW), F.col("item_words")))
    enough = F.least(F.lit(min_words), F.col("item_words"))
    runs = cut(runs.where(F.size(covered(F.col("places"))) >= enough))
    # the words of the documents and items of the diagonals left, each once, to see what stands in the slots
    met_texts = texts.join(runs.select("rid").distinct(), "rid", "left_semi").dropDuplicates(["rid"])
    words = cut(with_words(met_texts.select("rid", "text")).select("rid", F.col("words").alias("of_doc")))
    of_item = items.select("item", "item_id", F.col("words").alias("of_item"), "names")
    runs = runs.join(small(of_item), "item").join(words, "rid")
    slots = F.filter(covered(F.col("places")), lambda p: F.get("names", p) < 0)
    pairs = F.transform(slots, lambda p: F.struct(p.alias("p"), F.get("of_item", p).alias("a"), F.get("of_doc", p + F.col("diagonal")).alias("b")))
    # written, as Spark would put the pairs into each of the many expressions that use them
    runs = cut(runs.select("rid", "doc_id", "item_id", "item_words", "places", pairs.alias("pairs")))
    runs = consistent(runs).where(F.col("n_words") >= enough)
    other = F.exists("pairs", lambda x: x["a"] != x["b"])
    best = runs.groupBy("rid", "doc_id", "item_id").agg(F.max(F.struct("n_words", "n_windows", F.round(F.col("n_words") / F.col("item_words"), 4).alias("share"), other.alias("other"))).alias("best"))
    return best.select("rid", "doc_id", "item_id", F.col("best.n_windows").cast("long").alias("n_windows"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.share").alias("share"), F.col("best.other").alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    bad = leaks(docs, benchmark, min_words).select(F.col("rid").alias("leaked_rid")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("rid"))
    return held.join(bad, F.col("rid") == F.col("leaked_rid"), "left_anti").select("row.*")
