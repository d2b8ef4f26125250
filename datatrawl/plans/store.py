"""The stored catalogue: Parquet folders by batch, made visible by a marker.

A batch writes all its tables, and its marker last. Readers take batches with a marker only, so
a batch shows whole or not at all. A batch that is run again before its marker overwrites its
own folders; after it, nothing is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from datatrawl import schemas
from datatrawl.operators.status import apply_status
from datatrawl.operators.url_filter import build_filter, merge_filters
from datatrawl.plans.counts import COUNTS, RunCounts

_MARKERS = "batch_id BIGINT, committed_at TIMESTAMP"
_STATUS = "url STRING, status INT"
_FILTER = "word BIGINT, bits BIGINT"
_COUNTS = ", ".join(f"{name} BIGINT" for name in COUNTS)


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """A partitioned folder, or an empty table before its first batch."""
        full = schema if "batch_id" in schema else f"{schema}, batch_id BIGINT"
        try:
            return self.spark.read.schema(full).parquet(f"{self.base}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], full)

    def _write(self, name: str, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}/batch_id={batch_id}")

    def _mark(self, kind: str, batch_id: int) -> None:
        row = self.spark.range(1).select(F.current_timestamp().alias("committed_at"))
        self._write(kind, batch_id, row.coalesce(1))

    def _marked(self, kind: str) -> DataFrame:
        return self._read(kind, _MARKERS).select("batch_id").distinct()

    def is_committed(self, batch_id: int, kind: str = "commits") -> bool:
        return not self._marked(kind).filter(F.col("batch_id") == batch_id).isEmpty()

    def table(self, name: str, without: int | None = None) -> DataFrame:
        """Rows of all committed batches, with their batch_id.

        A batch that is about to write leaves itself out: what an earlier try of it left behind
        is not read while it is overwritten.
        """
        rows = self._read(name, schemas.CATALOGUE[name])
        if without is not None:
            rows = rows.filter(F.col("batch_id") != without)
        return rows.join(self._marked("commits"), "batch_id", "left_semi")

    def commit_batch(self, batch_id: int, tables: dict[str, DataFrame], counts: RunCounts | None = None) -> bool:
        """Write all tables of a batch or none; false if the batch was there already."""
        if self.is_committed(batch_id):
            return False
        for name, df in tables.items():
            self._write(name, batch_id, df)
        if "tab_url" in tables:
            own = build_filter(self._read("tab_url", schemas.CATALOGUE["tab_url"]).filter(F.col("batch_id") == batch_id))
            # A row without bits tells that the batch has a filter, if it has no URL.
            empty = self.spark.createDataFrame([(0, 0)], _FILTER)
            self._write("url_filter", batch_id, own.unionByName(empty).coalesce(1))
        if counts is not None:
            row = self.spark.createDataFrame([tuple(counts.total().values())], _COUNTS)
            self._write("run_counts", batch_id, row)
        self._mark("commits", batch_id)
        return True

    def run_counts(self) -> DataFrame:
        """The counts of each committed batch, with its batch_id."""
        return self._read("run_counts", _COUNTS).join(self._marked("commits"), "batch_id", "left_semi")

    def url_filter(self) -> DataFrame | None:
        """The merged filter of all committed URLs, or none if a batch has URLs and no filter.

        Each batch keeps its own, of at most WORDS rows, so a commit never rewrites one.
        """
        marked = self._marked("commits")
        parts = self._read("url_filter", _FILTER).join(marked, "batch_id", "left_semi")
        stored = self._read("tab_url", schemas.CATALOGUE["tab_url"]).select("batch_id").distinct().join(
            marked, "batch_id", "left_semi")
        if not stored.join(parts.select("batch_id").distinct(), "batch_id", "left_anti").isEmpty():
            return None
        return merge_filters(parts)

    def _newest_status(self, upto: int | None = None) -> DataFrame:
        """`url`, `status`: the last merged table and the versions behind it, the newest of each URL."""
        merged = self._marked("status_merges").agg(F.max("batch_id")).first()[0]
        versions = self._read("status", _STATUS).join(
            self._marked("status_commits"), "batch_id", "left_semi")
        if upto is not None:
            versions = versions.filter(F.col("batch_id") <= upto)
        if merged is not None:
            old = self._read("status_merged", _STATUS).filter(F.col("batch_id") == merged)
            versions = versions.filter(F.col("batch_id") > merged).unionByName(old)
        return versions.groupBy("url").agg(F.max_by("status", "batch_id").alias("status"))

    def current_tab_url(self) -> DataFrame:
        """`tab_url` with the newest status of each URL."""
        return apply_status(self.table("tab_url").drop("batch_id"), self._newest_status())

    def merge_status(self, version: int) -> bool:
        """Merge all versions up to this one to one table; readers take it and what came later.

        The table is marked when it is whole, so a merge that breaks off changes nothing.
        """
        if not self.is_committed(version, "status_commits") or self.is_committed(version, "status_merges"):
            return False
        self._write("status_merged", version, self._newest_status(version))
        self._mark("status_merges", version)
        return True

    def commit_status(self, version: int, changes: DataFrame) -> bool:
        """Store changed statuses as a new version; only changed rows are written."""
        if self.is_committed(version, "status_commits"):
            return False
        self._write("status", version, changes.select("url", F.col("status").cast("int")))
        self._mark("status_commits", version)
        return True
