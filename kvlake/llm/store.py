"""Tables between stages, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at once while a table is written: texts are long, and both sides hold a batch in memory.
BATCH_ROWS = 1_500


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where it is unset and Spark runs in this process alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="kvlake-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def folder(spark: SparkSession) -> str:
    """Where the tables of this application are."""
    return f"{shared_dir(spark)}/kvlake/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the tables of this application, when no result of it is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: the lineage ends, and a lost executor costs only the reading.

    The shuffle files of the write are released when it has ended.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    cleanup, batch = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH, "10000")
    spark.conf.set(CLEANUP, "true")
    spark.conf.set(BATCH, str(min(BATCH_ROWS, int(batch)) if int(batch) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, cleanup)
        spark.conf.set(BATCH, batch)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote, when nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/kvlake/{spark.sparkContext.applicationId}/" in path:
                there = spark._jvm.org.apache.hadoop.fs.Path(path)
                there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
