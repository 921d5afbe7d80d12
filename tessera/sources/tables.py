"""Parquet tables as snapshots: a change writes a new version beside the old and then moves a pointer file.

A reader sees a whole version or the one before it. The pointer is written by Spark too, so any file system that Spark can
write to holds a store.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """Named tables under one folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self, name: str) -> str:
        return f"{self.root}/{name}/_pointers"

    def version(self, name: str) -> str | None:
        try:
            row = self.spark.read.schema("seq long, version string").json(self._pointers(name)).orderBy(F.desc("seq")).first()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return row["version"] if row else None

    def read(self, name: str) -> DataFrame:
        version = self.version(name)
        if version is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, rows: DataFrame, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
        """Writes a new version, then points at it. rows may be made of the version before."""
        version = uuid.uuid4().hex
        if sort_by:
            rows = rows.sortWithinPartitions(*sort_by)
        (rows.write.partitionBy(*partition_by) if partition_by else rows.write).parquet(f"{self.root}/{name}/{version}")
        now = self.spark.sql("SELECT unix_micros(current_timestamp()) AS seq")
        now.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").json(self._pointers(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to the present version, or begins one."""
        version = self.version(name)
        if version is None:
            self.write(name, rows)
        else:
            rows.write.mode("append").parquet(f"{self.root}/{name}/{version}")


def graph_views(pages: DataFrame, anchors: DataFrame, citations: DataFrame) -> dict[str, DataFrame]:
    """The graph as views of the tables: what has pages, what has anchors, what cites what."""
    return {
        "has_page": pages.select("doc_id", "page_no").distinct(),
        "has_anchor": anchors.select("doc_id", "page_no", "anchor_no").distinct(),
        "cites": citations.filter("resolved AND target_doc_id IS NOT NULL").select(F.col("source_doc_id").alias("src"), F.col("target_doc_id").alias("dst"), "citation_type", "page_no"),
    }


def feedback(rows: DataFrame) -> DataFrame:
    """Feedback with its nested columns as JSON; what is empty becomes null."""
    nested = [c for c in ("sources", "history", "settings") if c in rows.columns]
    text = lambda c: F.when(~F.to_json(c).isin("[]", "{}"), F.to_json(c))
    return rows.withColumns({c: text(c) for c in nested})


def cache_misses(asked: DataFrame, cache: DataFrame, now) -> DataFrame:
    """asked (key) without what the cache (key, expires_at) still holds."""
    return asked.join(cache.filter(F.col("expires_at") > now).select("key").distinct(), "key", "left_anti")
