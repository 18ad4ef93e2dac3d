"""Versioned tables: what was written shows all together, once its manifest is there, or not at all.

A folder holds data under names that are never reused, and a manifest for each version: rows (kind, part, path, seq) that name
the data in it, and the numbers that go with them. A version is published by writing its manifest under the next number,
which fails if another writer was first; readers take the manifest of the highest number that is complete. So a writer that
fails half-way leaves data that no manifest names, and no reader sees it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROW = "kind string, part int, path string, seq long, facts string"


class Versions:
    """The versions of a set of tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> Versions:
        """A new folder, whose first version has no data."""
        made = cls(spark, folder)
        made._put(0, [("begin", 0, "", 0, None)])
        return made

    def current(self) -> tuple[int, list]:
        """Number and rows (kind, part, path, seq, facts) of the last version."""
        number = self._last()
        rows = self.spark.read.schema(ROW).json(self._manifest(number)).where("kind <> 'begin'")
        return number, rows.select("kind", "part", "path", "seq", "facts").collect()

    def fresh(self, kind: str) -> str:
        """A path that nothing else is written to."""
        return f"{self.folder}/data/{kind}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, kind: str, by: list[str] | None = None) -> tuple[str, int]:
        """Writes rows to a fresh path, partitioned by columns if any, and counts what is there against what was to be written."""
        path = self.fresh(kind)
        seen = self._observed(df)
        (seen[0].write.partitionBy(*by) if by else seen[0].write).parquet(path)
        wanted, n = seen[1].get["n"], self.read([path], df.schema).count()
        if n != wanted:
            raise ValueError(f"{path} holds {n} rows, not the {wanted} that were written")
        return path, n

    def publish(self, after: int, rows: list[tuple]) -> int:
        """Makes (kind, part, path, seq, facts) the version that follows `after`; an error if there's one already."""
        if self._last() != after:
            raise RuntimeError(f"{self.folder} has changed since version {after}")
        self._put(after + 1, [tuple(r) for r in rows] or [("begin", 0, "", 0, None)])
        return after + 1

    def read(self, paths: list[str], schema=None) -> DataFrame:
        base = self.spark.read if schema is None else self.spark.read.schema(schema)
        return base.parquet(*paths)

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/manifests/version={number:09d}"

    def _put(self, number: int, rows: list[tuple]) -> None:
        frame = self.spark.createDataFrame(rows, ROW)
        frame.coalesce(1).write.mode("errorifexists").json(self._manifest(number))  # one file, which its commit renames

    def _last(self) -> int:
        """The greatest number with a committed file; names alone are listed."""
        names = self.spark.read.schema(ROW).json(f"{self.folder}/manifests").inputFiles()
        return max(int(n.split("/version=")[1].split("/")[0]) for n in names)

    @staticmethod
    def _observed(df: DataFrame):
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("n")), seen
