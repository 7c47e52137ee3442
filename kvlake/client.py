"""A session handle: collects commands and runs them as one log.

A toy for scripts and tests: each lookup folds all commands so far, and any project is taken as granted. Bulk work builds its DataFrames
itself and passes logins through operators/session.py.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from kvlake.operators import fold
from kvlake.sources.files import parse_commands


class Response(NamedTuple):
    success: bool
    message: str | None
    data: str | None


class NotAuthenticated(Exception):
    pass


class Client:
    """get, set, delete and update on one project; `DELETE` is taken as `DEL`."""

    def __init__(self, spark: SparkSession, project: str | None = None):
        self.spark, self.project, self.lines = spark, project, []

    def authenticate(self, project: str) -> None:
        self.project = project

    def send(self, line: str) -> int:
        """The seq of a line of the command language."""
        if not self.project:
            raise NotAuthenticated("choose a project first")
        if line.split(" ", 1)[0].upper() == "DELETE":
            line = "DEL" + line[6:]
        self.lines.append((len(self.lines), self.project, line))
        return len(self.lines) - 1

    def set(self, key: str, value: str, *flags: str) -> int:
        return self.send(" ".join(["SET", key, value, *flags]))

    def update(self, key: str, value: str) -> int:
        return self.send(f"UPDATE {key} {value}")

    def delete(self, key: str, *flags: str) -> int:
        return self.send(" ".join(["DEL", key, *flags]))

    def commands(self) -> DataFrame:
        rows = self.spark.createDataFrame(self.lines, "seq long, session string, line string")
        return parse_commands(rows).withColumnRenamed("session", "project")

    def get(self, key: str, *flags: str) -> Response:
        seq = self.send(" ".join(["GET", key, *flags]))
        row = fold.answers(self.commands()).where(f"seq = {seq} and verb = 'GET'").first()
        return Response(row["value"] is not None, None if row["value"] is not None else row["reply"], row["reply"] if row["value"] is not None else None)
