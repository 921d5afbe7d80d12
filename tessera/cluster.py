"""What driver and executors share: the package, sent along with the work, and a folder for tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def shipped(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors of a session, once for each application."""
    context = (spark or SparkSession.active()).sparkContext
    if context.applicationId in _SENT:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-code-"), "tessera_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    context.addPyFile(path)
    _SENT.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session of one process that has none gets one; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()  # a running session takes no new value of the setting itself
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder and reads them again: what several steps read is made once, and a lost executor costs none of it."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows over all cores. A small file is one split, and so one task, whatever is done with its texts; a large one has splits enough and stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows
