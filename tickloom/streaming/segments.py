"""A table that grows by batches and stays small in files: merged segments and a manifest.

Each batch is a segment of level 0. Once a level has ``fan`` segments they are merged into one of the next
level, so after n batches there are at most (fan - 1) * log(n) segments, each with one file for each value of
the partition columns. A manifest per batch names the live segments; it is written last, so what a failed
batch left behind is never read, and a batch that runs again starts from the manifest before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import list_names, remove_path

Segment = tuple[int, int, int]  # level, first and last batch


class Segments:
    """``shrink`` may drop rows of a merged segment that no reader needs."""

    def __init__(
        self, spark: SparkSession, root: str, parts: list[str], fan: int = 8, shrink: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.spark, self.root, self.parts, self.fan, self.shrink = spark, root, parts, fan, shrink

    @staticmethod
    def _name(s: Segment) -> str:
        return f"seg=L{s[0]}-{s[1]:012d}-{s[2]:012d}"

    def manifest(self, before: int | None = None) -> list[Segment]:
        """The live segments as of the newest complete batch (before a given one)."""
        ids = sorted(int(n) for n in list_names(self.spark, f"{self.root}/manifest"))
        for k in reversed([i for i in ids if before is None or i < before]):
            path = f"{self.root}/manifest/{k:012d}"
            if "_SUCCESS" in list_names(self.spark, path):
                rows = self.spark.read.schema("level INT, first LONG, last LONG").json(path).collect()  # (fan - 1) a level
                return sorted((r["level"], r["first"], r["last"]) for r in rows)
        return []

    def _open(self, segments: list[Segment], schema: str) -> DataFrame:
        base = f"{self.root}/data"
        paths = [f"{base}/{self._name(s)}" for s in segments]
        # Partition columns go last, as Spark reads them.
        return self.spark.read.schema(schema).option("basePath", base).parquet(*paths).drop("seg")

    def read(self, schema: str, before: int | None = None) -> DataFrame:
        """All rows as of the newest batch (before a given one)."""
        segments = self.manifest(before)
        return self._open(segments, schema) if segments else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, s: Segment) -> None:
        if self.parts:
            rows = rows.repartition(*self.parts)
        rows.write.mode("overwrite").partitionBy(*self.parts).parquet(f"{self.root}/data/{self._name(s)}")

    def add(self, rows: DataFrame, batch: int, schema: str) -> DataFrame:
        """Store a batch, merge full levels, publish the manifest; returns the batch as stored (until the next one)."""
        before = self.manifest(batch)
        own = (0, batch, batch)
        self._write(rows, own)
        live, level = [*before, own], 0
        while sum(s[0] == level for s in live) >= self.fan:
            full = [s for s in live if s[0] == level]
            merged = (level + 1, min(s[1] for s in full), max(s[2] for s in full))
            union = self._open(full, schema)
            self._write(self.shrink(union) if self.shrink else union, merged)
            live, level = [s for s in live if s[0] != level] + [merged], level + 1
        path = f"{self.root}/manifest/{batch:012d}"
        self.spark.createDataFrame(live, "level INT, first LONG, last LONG").coalesce(1).write.mode("overwrite").json(path)
        self._clean(batch, {*before, *live, own})
        return self._open([own], schema)

    def _clean(self, batch: int, keep: set[Segment]) -> None:
        """Drop segments that neither this manifest nor the one before it names, and older manifests."""
        names = {self._name(s) for s in keep}
        for name in list_names(self.spark, f"{self.root}/data"):
            if name.startswith("seg=") and name not in names:
                remove_path(self.spark, f"{self.root}/data/{name}")
        older = sorted(int(n) for n in list_names(self.spark, f"{self.root}/manifest") if int(n) < batch)
        for k in older[:-1]:
            remove_path(self.spark, f"{self.root}/manifest/{k:012d}")


def files_of(spark: SparkSession, root: str, column: str) -> DataFrame:
    """(value, files): how many data files each value of a partition column has now."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/data").select("path")
    value = F.regexp_extract("path", f"{column}=([^/]+)/", 1).alias("value")
    return paths.groupBy(value).agg(F.count("*").alias("files"))
