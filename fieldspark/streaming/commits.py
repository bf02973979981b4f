"""A commit log beside a table of written folders.

A commit is one empty file whose name says all: sequence, run, batch and folder. Creating it
is the atomic step that makes a folder count, so a folder half written by a lost job never
does, and a batch that already is in the log is not written twice. A compaction is a commit
of a folder that stands for all earlier ones; readers take the last compaction and what
came after it. One job writes a table at a time; any number may read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

_NAME = re.compile(r"(\d{12})~(add|all)~([^~]*)~(\d+)~([^~]+)$")


@dataclass(frozen=True, order=True)
class Commit:
    sequence: int
    kind: str
    run: str
    batch: int
    folder: str

    @property
    def name(self) -> str:
        return f"{self.sequence:012d}~{self.kind}~{self.run}~{self.batch}~{self.folder.replace('/', '@')}"


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def history(spark: SparkSession, path: str) -> list[Commit]:
    """All commits in order; none where the table was never written."""
    files, where = _at(spark, f"{path}/_commits")
    if not files.exists(where):
        return []
    found = [_NAME.match(s.getPath().getName()) for s in files.listStatus(where)]
    return sorted(Commit(int(m[1]), m[2], m[3], int(m[4]), m[5].replace("@", "/")) for m in found if m)


def commit(spark: SparkSession, path: str, kind: str, run: str, batch: int, folder: str) -> Commit:
    done = history(spark, path)
    new = Commit(done[-1].sequence + 1 if done else 0, kind, run, batch, folder)
    files, where = _at(spark, f"{path}/_commits/{new.name}")
    if not files.createNewFile(where):
        raise RuntimeError(f"another job writes {path}")
    return new


def live(done: list[Commit]) -> list[Commit]:
    """The last compaction and the commits after it."""
    start = max((i for i, c in enumerate(done) if c.kind == "all"), default=0)
    return done[start:]


def expire(spark: SparkSession, path: str) -> int:
    """Delete the folders that a compaction has replaced; readers of older states must have ended."""
    done = history(spark, path)
    kept = {c.folder for c in live(done)}
    gone = {c.folder for c in done} - kept
    for folder in gone:
        files, where = _at(spark, f"{path}/{folder}")
        files.delete(where, True)
    return len(gone)
