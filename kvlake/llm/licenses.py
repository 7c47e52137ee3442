"""License scans by diagonal voting.

Words are lower-case runs of letters and digits (any byte beyond ASCII counts as a letter). All rolling hashes of 2 and of NOTICE_GRAM words
are joined with the places of the templates' hashes; matches vote for diagonals (place in the text less place in the template). A phrase
stands wherever a diagonal has the votes of all its word pairs. For notices (license_texts.py: whole licenses, and first parts that often
stand alone), diagonals at most GAP apart are merged, which bridges words put in or left out, and the merged span is verified: going through
its votes by place, those that go on in the template count the template's words that they cover; the span is a notice if these are at least
NOTICE_SHARE of the template, and if it isn't longer than LONGEST times the template, which bounds the drift of merged diagonals.

The base is the four phrases; the notices and further phrases are this method's own. The templates are constants, so their table, which is
broadcast, has a fixed size. Votes are summed per document and diagonal before anything is shuffled.

Nulls and edges: a null text is empty: no words, no labels, score 0; null ids are carried; each of several equal rows gets its own result;
of votes that tie in place, the earlier in the template comes first; very long texts are worked on as a whole in a task; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.llm import arrays as A
from kvlake.llm.license_texts import TEXTS
from kvlake.llm.lines import row_id

NOTICE_GRAM = 5
NOTICE_SHARE = 0.5
LONGEST = 1.5
GAP = 4

# Phrases and their labels. The first four are the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
PHRASES = {"gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "bsd license": "bsd", "creative commons attribution": "cc-by", "eclipse public license": "epl", "all rights reserved": "proprietary"}


def _hashes(words: np.ndarray, k: int) -> np.ndarray:
    return A.grams(words, k) ^ A.VALUES[k]


def _word_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    begin, end, _ = A.words(data, np.array([0, len(data)]), A.LETTERS)
    return A.word_hashes(data, begin, end)


def templates(spark: SparkSession) -> DataFrame:
    """gram, template, label, kind (base, phrase, notice, or row: a mark that each document has), at, grams (how many the template has)."""
    rows, number = [(0, -1, "", "row", 0, 1)], 0
    for kind, held, k in (("base", BASE.items(), 2), ("phrase", PHRASES.items(), 2), ("notice", [(t, label) for label, t in TEXTS], NOTICE_GRAM)):
        for text, label in held:
            hashes = _hashes(_word_hashes(text), k).view(np.int64).tolist()
            rows += [(h, number, label, kind, i, len(hashes)) for i, h in enumerate(hashes)]
            number += 1
    return spark.createDataFrame(rows, "gram long, template int, label string, kind string, at int, grams int")


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, rid, n_words, template, label, kind, grams, diagonal, ats (template places that voted), rows for all diagonals of all documents; one row of kind row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in A.texts(batch["text"]):
                low = A.LOWER[data]
                begin, end, doc = A.words(low, bounds, A.LETTERS)
                words = A.word_hashes(low, begin, end)
                count = np.bincount(doc, minlength=j - i)
                # for each document: the mark, its pairs, its longer runs; a place without enough words holds 1, which is no template's hash
                first = np.cumsum(2 * count + 1) - 2 * count - 1
                out = np.ones(int(2 * count.sum() + (j - i)), dtype=np.int64)
                out[first] = 0
                within = np.arange(len(words)) - (np.cumsum(count) - count)[doc]
                for lot, k in enumerate((2, NOTICE_GRAM)):
                    h = _hashes(words, k)
                    inside = np.flatnonzero(doc[: len(h)] == doc[k - 1 :]) if len(h) else np.zeros(0, int)
                    out[first[doc[inside]] + 1 + lot * count[doc[inside]] + within[inside]] = h[inside].view(np.int64)
                offsets = np.append(first, len(out)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["rid"].slice(i, j - i), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))], ["doc_id", "rid", "n_words", "grams_of"])

    held = docs.select("doc_id", row_id().alias("rid"), "text").mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, rid long, n_words long, grams_of array<long>")
    places = held.select("doc_id", "rid", "n_words", F.posexplode("grams_of").alias("i", "gram"))
    met = places.join(F.broadcast(templates(docs.sparkSession)), "gram")
    place = F.when(F.col("i") == 0, 0).otherwise((F.col("i") - 1) % F.col("n_words")).cast("int")
    met = met.withColumn("place", place).withColumn("diagonal", F.col("place") - F.col("at"))
    keys = ["doc_id", "rid", "n_words", "template", "label", "kind", "grams", "diagonal"]
    return met.groupBy(*keys).agg(F.collect_set("at").alias("ats"), F.count("*").alias("rows"))


def _in_order(spans: Column) -> Column:
    """Words of the template covered by the votes that go on in it, going through all votes of merged diagonals by place."""
    votes = F.array_sort(F.flatten(F.transform(spans, lambda d: F.transform(d["ats"], lambda a: F.struct((a + d["diagonal"]).alias("place"), a.alias("at"))))))
    on = lambda s, v: v["at"] > s["last"]
    new = lambda s, v: v["at"] + NOTICE_GRAM - F.greatest(v["at"], s["last"] + NOTICE_GRAM)
    zero = F.struct(F.lit(-NOTICE_GRAM).alias("last"), F.lit(0).alias("words"))
    step = lambda s, v: F.struct(F.when(on(s, v), v["at"]).otherwise(s["last"]).alias("last"), (s["words"] + F.when(on(s, v), new(s, v)).otherwise(0)).alias("words"))
    return F.aggregate(votes, zero, step)["words"]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (of notices: label, first, last, share) of every row."""
    found = votes(docs)
    whole = F.size("ats") == F.col("grams")
    phrases = found.where("kind <> 'notice'").where(whole).select("doc_id", "rid", "n_words", "kind", "label", F.col("diagonal").alias("first"), F.lit(1.0).alias("share"), F.when(F.col("kind") == "row", F.col("rows")).alias("rows"), F.lit(None).cast("int").alias("last"))
    on = Window.partitionBy("doc_id", "rid", "template").orderBy("diagonal")
    notices = found.where("kind = 'notice'").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(on) > GAP).cast("int"), F.lit(0)))
    notices = notices.withColumn("span", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    notices = notices.groupBy("doc_id", "rid", "n_words", "kind", "label", "template", "grams", "span").agg(
        F.collect_list(F.struct("diagonal", "ats")).alias("held"), F.min(F.col("diagonal") + F.array_min("ats")).alias("first"), F.max(F.col("diagonal") + F.array_max("ats") + NOTICE_GRAM - 1).alias("last")
    )
    size = F.col("grams") + NOTICE_GRAM - 1
    notices = notices.withColumn("share", _in_order(F.col("held")) / size).where((F.col("share") >= NOTICE_SHARE) & (F.col("last") - F.col("first") + 1 <= LONGEST * size))
    notices = notices.select("doc_id", "rid", "n_words", "kind", "label", "first", "share", F.lit(None).cast("long").alias("rows"), "last")
    base = F.col("kind") == "base"
    label = F.when(F.col("kind") != "row", F.col("label"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = phrases.union(notices).groupBy("doc_id", "rid", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, label)).alias("base_labels"), joined(label).alias("labels"), F.coalesce(F.max(F.when(F.col("kind") != "row", F.col("share"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "notice", F.struct("label", "first", "last", "share")))).alias("spans"), F.max("rows").alias("rows"),
    )
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("rid", "rows", "row")
