"""Ingest that counts every row once, whatever stops it: batches carry their number into the table's own log.

A batch is judged, its good rows are merged into a table of `sources.lake` and the others into a table of dead letters; both commits carry
the number that the stream gave the batch. Spark gives a batch that was not checkpointed the same number and rows again, and a commit of a
number that the log has already changes nothing. So a stop between the two commits, or between them and the checkpoint, loses nothing and
repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tessera.sources.lake import Table

#: Tries after which a dead letter is given up.
TRIES = 3
DEAD = "letter string, payload string, reason string, tries int, given_up boolean"


def dead_letters(spark: SparkSession, path: str, buckets: int = 16) -> Table:
    """An empty table of dead letters, by a hash of their payload."""
    return Table.create(spark, path, "letter", StructType.fromDDL(DEAD), buckets)


def judged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with `reason`: the first rule that a row breaks, null for good rows. A rule that is null counts as broken."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]
    return rows.withColumn("reason", F.coalesce(*broken, F.lit(None).cast("string")))


def buried(rows: DataFrame) -> DataFrame:
    """Letters of rows that broke a rule: equal payloads are one letter."""
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "reason"]))
    letters = rows.filter("reason IS NOT NULL").select(payload.alias("payload"), "reason")
    return letters.select(F.sha2("payload", 256).alias("letter"), "payload", "reason").groupBy("letter").agg(F.min("payload").alias("payload"), F.min("reason").alias("reason"))


def _again(old: DataFrame, new: DataFrame, tries: int) -> DataFrame:
    """Letters after new ones came: one that was there has been tried once more."""
    both = old.join(new.select("letter", F.col("payload").alias("p"), F.col("reason").alias("r")), "letter", "full_outer")
    tried = F.coalesce("tries", F.lit(0)) + F.when(F.col("p").isNotNull(), 1).otherwise(0)
    return both.select("letter", F.coalesce("payload", "p").alias("payload"), F.coalesce("r", "reason").alias("reason"), tried.alias("tries"), (tried >= tries).alias("given_up"))


def taken(batch: DataFrame, number: int, writer: str, table: Table, dead: Table, rules: dict[str, Column], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tries: int = TRIES) -> None:
    """One batch into both tables. It is kept while that lasts, since both read it."""
    rows = judged(batch, rules).persist()
    try:
        good = rows.filter("reason IS NULL").drop("reason")
        table.upsert(good, merge, {writer: number})
        letters = buried(rows)
        dead.upsert(letters, lambda old, new: _again(old, new, tries), {writer: number})
    finally:
        rows.unpersist()


def ingest(stream: DataFrame, writer: str, table: Table, dead: Table, rules: dict[str, Column], checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tries: int = TRIES) -> StreamingQuery:
    """Takes in all that a stream has now. `writer` names it in the logs; it must be of this checkpoint alone."""
    save = lambda batch, number: taken(batch, number, writer, table, dead, rules, merge, tries)
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retried(table: Table, dead: Table, schema: StructType, rules: dict[str, Column], merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tries: int = TRIES) -> int:
    """Judges the letters that aren't given up again: good ones move to the table, the others have been tried once more. How many moved.

    The table comes first. A stop after it leaves letters whose rows are there already; trying again merges them again, to the same end.
    """
    open_ = dead.read().filter("NOT given_up").select("letter", "payload", F.from_json("payload", schema).alias("row"))
    rows = judged(open_.select("letter", "payload", "row.*"), rules).persist()
    try:
        good = rows.filter("reason IS NULL")
        moved = good.count()
        if moved:
            table.upsert(good.drop("letter", "payload", "reason"), merge)
            dead.delete(good.select("letter"))
        worse = rows.filter("reason IS NOT NULL").select("letter", "payload", "reason")
        dead.upsert(worse, lambda old, new: _again(old, new, tries))
        return moved
    finally:
        rows.unpersist()
