"""Line dedup: repeated runs of lines, found by prefix doubling over line numbers, lose their later copies.

A suffix is a place in a document's sequence of lines. Its name at level k stands for the 2**k lines from there: level 0 names the line
itself, and a name at level k + 1 is made of the names at level k of the place and of the place 2**k lines on. Suffixes of equal name form
an interval of common prefix of at least 2**k lines; only those in intervals of two or more go on to the next level, so the work shrinks
with the length that still repeats. Names are hashes, since equality is all that matters here, not the order of the intervals.

A run of lines, of any length, with at least `min_chars` characters that also stands at an earlier place is deleted; places are ordered by
doc_id, then by the hash of the row, then by line. It is enough to judge the shortest such run from each line on and the shortest one up to
each line: every line of a longer run lies in one of those that are inside the run. A run of n lines is named by the two runs of 2**k lines
at its ends, for the largest 2**k up to n, so levels go on as far as the longest of the shortest runs. Copies inside one document count.
Lines are judged on the input. First copies stay.

Nulls and edges: a null text has no lines and stays null; an empty text is one empty line and stays; a null doc_id sorts first; nulls
elsewhere are carried through. Rows repeated in full are judged as one and fare alike. An empty table gives an empty result. Extra columns
are kept, whatever their names, as the working columns live in their own tables.

Everything is DataFrame functions. No step holds more than one document or one aggregated interval per row; joins are plain equi-joins
that Spark can split where a line is very frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.store import cut

#: A repeated run has to have as many characters to be deleted.
MIN_CHARS = 50


def row_id() -> F.Column:
    """A key of a row that is never null and is shared by rows of equal id and text alone."""
    return F.xxhash64("doc_id", "text")


def place() -> F.Column:
    return F.struct("doc_id", "rid", "line")


def _intervals(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name occurs more than once, with the first place that has it.

    The first places are written before the join, so that it has an exchange on either side and Spark can split a very frequent name.
    """
    first = suffixes.groupBy("name").agg(F.count("*").alias("n"), F.min(place()).alias("first")).where("n > 1").drop("n")
    return suffixes.join(cut(first), "name")


def _with_runs(lines: DataFrame, min_chars: int) -> DataFrame:
    """lines with ahead and back: how many lines the shortest run of min_chars characters has from the line on, and up to it (null if none)."""
    of = Window.partitionBy("rid")
    lines = lines.withColumn("after", F.sum("chars").over(of.orderBy("line").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("chars"))
    end = F.max(F.struct("line", "after")).over(of.orderBy("before").rangeBetween(0, min_chars - 1))
    begin = F.min(F.struct("line", "before")).over(of.orderBy("after").rangeBetween(1 - min_chars, 0))
    lines = lines.withColumn("end", end).withColumn("begin", begin)
    ahead = F.when(F.col("end.after") - F.col("before") >= min_chars, F.col("end.line") - F.col("line") + 1)
    back = F.when(F.col("after") - F.col("begin.before") >= min_chars, F.col("line") - F.col("begin.line") + 1)
    return lines.withColumn("ahead", ahead).withColumn("back", back).drop("after", "before", "end", "begin", "chars")


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """rid, first, last: the lines [first, last) of each document to delete, merged into maximal runs."""
    lines = docs.select("doc_id", row_id().alias("rid"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.select("doc_id", "rid", "line", F.xxhash64("content").alias("name"), F.length("content").alias("chars"))
    suffixes = _with_runs(lines.repartition("rid").dropDuplicates(["rid", "line"]), min_chars)
    level = cut(_intervals(suffixes))
    marks = [level.where((place() > F.col("first")) & (F.col("ahead") == 1)).select("rid", F.col("line").alias("first"), (F.col("line") + 1).alias("last"))]
    runs = level.where("ahead > 1").select("doc_id", "rid", "line", F.col("ahead").alias("n"))
    runs = cut(runs.union(level.where("back > 1").select("doc_id", "rid", F.col("line") - F.col("back") + 1, "back")).distinct())
    longest, step = runs.agg(F.max("n")).first()[0] or 0, 1
    level = level.select("doc_id", "rid", "line", "name")
    while 2 * step <= longest:
        on = Window.partitionBy("rid").orderBy("line")
        ahead = F.lead(F.struct("line", "name"), step).over(on)
        longer = level.select("doc_id", "rid", "line", "name", ahead.alias("ahead")).where(F.col("ahead.line") == F.col("line") + step)
        longer, step = longer.select("doc_id", "rid", "line", F.xxhash64("name", "ahead.name").alias("name")), step * 2
        level = cut(_intervals(longer).drop("first"))
        head, tail = (level.select("rid", F.col("line").alias(at), F.col("name").alias(x)) for at, x in (("line", "head"), ("end", "tail")))
        here = runs.where(F.col("n").between(step, 2 * step - 1)).withColumn("end", F.col("line") + F.col("n") - step)
        named = here.join(head, ["rid", "line"]).join(tail, ["rid", "end"]).select("doc_id", "rid", "line", "n", F.xxhash64("n", "head", "tail").alias("name"))
        again = _intervals(cut(named)).where(place() > F.col("first"))
        marks.append(again.select("rid", F.col("line").alias("first"), (F.col("line") + F.col("n")).alias("last")))
    found = marks[0]
    for more in marks[1:]:
        found = found.union(more)
    on = Window.partitionBy("rid").orderBy("first", "last")
    reach = F.max("last").over(on.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.groupBy("rid", "first").agg(F.max("last").alias("last")).withColumn("new", (F.col("first") > F.coalesce(reach, F.lit(-1))).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(on.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("rid", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A struct `row` of each row as it was, kept (its text without the deleted lines), n_lines, n_removed."""
    runs = repeated_runs(docs, min_chars).groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id().alias("rid"))
    lines = F.split("row.text", "\n")
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"] - 1)))
    n = F.coalesce(F.size(lines), F.lit(0))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i))
    kept = F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    n_removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"]), F.lit(0))
    return held.join(runs, "rid", "left").select(
        "row", kept.alias("kept"), F.when(F.col("row.text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed")
    )
