"""A table with one row for each key, into which several writers may put rows at once.

Rows are written to a folder of their own and count from the moment a commit names it. Commits are numbered files, and creating one that exists
fails, so of two writers that saw the same state one comes second: it drops the keys the other has put, writes the rest, and tries the
next number. A writer that fails before its commit leaves a folder that no reader looks at.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class KeyedTable:
    """The table in ``folder`` (any path of Spark's), whose rows have ``schema`` and are known by the columns ``key``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        self.jvm = spark.sparkContext._jvm
        self.files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def commits(self) -> list[str]:
        """The folders that count, in the order of their commits."""
        log = self._path("_commits")
        if not self.files.exists(log):
            return []
        names = sorted(s.getPath().getName() for s in self.files.listStatus(log))
        return [json.loads(self._text(f"_commits/{n}"))["rows"] for n in names if n.isdigit()]

    def _text(self, name: str) -> str:
        stream = self.files.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, number: int, rows: str) -> bool:
        """Whether this call made the commit; False where there is one of that number. A commit is complete when it appears."""
        name, text = f"_commits/{number:012d}", json.dumps({"rows": rows}).encode()
        self.files.mkdirs(self._path("_commits"))
        if self.files.getScheme() == "file":  # Hadoop's local files are looked for and then made; a link is one step
            target = unquote(urlparse(str(self.files.makeQualified(self._path(name)).toUri())).path)
            whole = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
            with open(whole, "wb") as out:
                out.write(text)
            try:
                os.link(whole, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(whole)
        try:
            stream = self.files.create(self._path(name), False)  # one step on a distributed file system
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        stream.write(bytearray(text))
        stream.close()
        return True

    def read(self, commits: list[str] | None = None) -> DataFrame:
        """The rows of the commits, by default of all."""
        commits = self.commits() if commits is None else commits
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{c}" for c in commits])

    def put(self, rows: DataFrame, order: list | None = None, most_tries: int = 100) -> int:
        """Puts rows whose key isn't there, and returns how many; of rows that share a key the first in ``order`` counts (or any). Null keys are a
        key like any other. Only the keys of commits that came in between are read again."""
        rows = rows.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        first = F.row_number().over(Window.partitionBy(*self.key).orderBy(*(order or self.key)))
        new, seen = rows.withColumn("__first", first).where("__first = 1").drop("__first"), 0
        for _ in range(most_tries):
            commits = self.commits()
            if commits[seen:]:
                held = self.read(commits[seen:]).select(*[F.col(f"`{k}`").alias(f"__{k}") for k in self.key]).distinct()
                match = F.lit(True)
                for k in self.key:
                    match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`"))
                new = new.join(held, match, "left_anti")
            seen = len(commits)
            name = f"rows-{uuid.uuid4().hex}"
            new.write.parquet(f"{self.folder}/{name}")
            new = self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}")
            count = new.count()
            if not count or self._create(seen, name):
                return count
        raise RuntimeError(f"other writers came first {most_tries} times")
