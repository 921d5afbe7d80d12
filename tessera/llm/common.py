"""What the training-data operators share: text helpers, fresh names and tables that cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that separates words in every contract of this package.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; none for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def let(value: Column, body) -> Column:
    """Evaluates value once for all of its uses in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unpack(rows: DataFrame, row: str = "row") -> list[Column]:
    """The fields of a packed row, each under its own name."""
    return [F.col(row)[name].alias(name) for name in rows.schema[row].dataType.names]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is set here only where the session has none and runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        folder = spark.sparkContext.getCheckpointDir()  # a running session takes no new value of the setting itself
    return folder


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """Writes rows to the shared folder and reads them again: a lost executor costs no recomputation, and the lineage ends here."""
    spark = rows.sparkSession
    path = path or fresh(spark, name)
    rows.write.options(**options).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark can."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables that a run needs while it lasts: `with Scratch(spark, name) as scratch` removes them at the end, whatever happens.

    What a result still reads must be written elsewhere before that.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.made = spark, fresh(spark, name), 0
        self.tables: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        removed(self.spark, self.path)
        self.tidy()

    def written(self, rows: DataFrame, name: str, **options: str) -> DataFrame:
        self.made += 1
        return written(rows, name, f"{self.path}/{self.made}-{name}", **options)

    def bucketed(self, rows: DataFrame, name: str, key: str, **options: str) -> DataFrame:
        """A table dealt by a key once: joins and groups by it don't shuffle its rows again."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        table = f"tessera_{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(n, key).options(**options).option("path", f"{self.path}/{table}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, rows: DataFrame) -> None:
        """Removes a written table that nothing reads any more."""
        for path in {file.rpartition("/")[0] for file in rows.inputFiles()}:
            removed(self.spark, path)

    def tidy(self) -> None:
        """Shuffle files go when the driver's garbage is collected; called where large ones have just been read for the last time."""
        for _ in range(2):  # what Python lets go of in the first round, Java finds in the second
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)
