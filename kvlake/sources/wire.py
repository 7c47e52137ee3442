"""Data source and codec for the wire format: a message of projects, each with a token and a map of texts.

Two messages one after the other are their merger: repeated fields are joined, and the last value of a key counts.

Field numbers: database.tokens = 1; project.token = 1, project.key_values = 2; entry.key = 1, entry.value = 2. All are of wire type 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "project string, key string, value string"


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 != 2:
            raise ValueError(f"wire type {tag & 7} is not part of this format")
        size = varint()
        if at + size > len(data):
            raise ValueError("the message is cut short")
        yield tag >> 3, data[at : at + size]
        at += size


def decode(data: bytes) -> Iterator[tuple[str, str, str]]:
    """project, key, value; the last value of a repeated key comes last."""
    for number, project in fields(data):
        if number == 1:
            held = list(fields(project))
            token = next((v.decode() for k, v in reversed(held) if k == 1), "")
            for _, entry in (x for x in held if x[0] == 2):
                parts = dict(fields(entry))
                yield token, parts.get(1, b"").decode(), parts.get(2, b"").decode()


def encode_projects(tier: DataFrame) -> DataFrame:
    """body: the message of each project (project, key, value), in parts whose concatenation is a database message."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, part in batch.groupby("project", sort=True):
                entries = b"".join(field(2, field(1, k.encode()) + field(2, v.encode())) for k, v in zip(part["key"], part["value"], strict=True))
                yield pd.DataFrame({"body": [field(1, field(1, project.encode()) + entries)]})

    return tier.select("project", "key", "value").repartition("project", "key").sortWithinPartitions("project", "key").mapInPandas(rows, "body binary")


def decode_messages(messages: DataFrame) -> DataFrame:
    """project, key, value of messages (body)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for body in batch["body"]:
                yield pd.DataFrame(list(decode(bytes(body))), columns=["project", "key", "value"], dtype=str)

    return messages.select("body").mapInPandas(rows, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """project, key, value of all files under a path of any store that Spark reads; each file is a message of its own."""
    return decode_messages(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("content").alias("body")))


def delimited(bodies: list[bytes]) -> bytes:
    """Messages one after the other, each after its length."""
    return b"".join(_varint(len(b)) + b for b in bodies)


def split_delimited(data: bytes) -> Iterator[bytes]:
    """The messages of such a text."""
    at = 0
    while at < len(data):
        size = shift = 0
        while True:
            byte = data[at]
            at += 1
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        if at + size > len(data):
            raise ValueError("the message is cut short")
        yield data[at : at + size]
        at += size


def row_hash(tier: DataFrame) -> DataFrame:
    """One row: the number of rows and a hash of them that doesn't depend on their order."""
    return tier.agg(F.count("*").alias("n"), F.sum(F.xxhash64("project", "key", "value").cast("decimal(38,0)")).alias("h"))


class WireSource(DataSource):
    """spark.read.format("kvwire").load(path): a file, or a folder of files, of which each is a task of its own."""

    @classmethod
    def name(cls) -> str:
        return "kvwire"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WireReader(self.options["path"])


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WireReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        from pathlib import Path

        top = Path(self.path)
        return [FilePart(str(p)) for p in (sorted(x for x in top.iterdir() if x.is_file()) if top.is_dir() else [top])]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from decode(f.read())
