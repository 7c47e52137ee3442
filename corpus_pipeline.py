"""A training corpus from documents, in stages. Each takes (spark, docs, sf_dir); its rows are written as Parquet and read as the next one's docs.

All stages but the last return the columns of documents, with whatever extra columns there are. Rows with nulls or empty texts take part
in every stage as the operators define it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import decontaminate, lines, packing, quality, setjoin
from kvlake.llm.store import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, docs.columns).where(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated runs of lines; documents of which nothing is left go."""
    out = lines.dedup(docs).where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = F.col("n_removed") > 0
    columns = {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return out.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return setjoin.one_of_each(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality", keep_good), ("lines", drop_repeated_lines), ("near_copies", keep_one_of_each), ("benchmark", keep_clean), ("packing", pack)]

#: The stages are learned models, line runs, set similarity and a tokenizer: not SQL. Tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
