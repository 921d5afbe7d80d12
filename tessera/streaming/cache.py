"""A cache in streaming state: entries expire by themselves, so its size follows what was asked lately and not what was ever asked."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tessera.cluster import shipped

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _entries(seconds: int, value: str, order: str) -> StatefulProcessor:
    """The processor. Its class is made here so that it goes to Python's workers by value: the one that sets up a stream has no way to this package."""

    class Entries(StatefulProcessor):
        """One value for each key, dropped `seconds` after it was stored. Within a batch a key's rows come in order."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.entry = handle.getValueState("entry", f"{value} string", seconds * 1000)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            held = self.entry.get()
            now = held[0] if held is not None else None
            known = held is not None
            out = []
            for row in pd.concat(rows).sort_values(order, kind="stable").itertuples(index=False):
                hit = known
                if not known:
                    now, known = getattr(row, value), True
                    self.entry.update((now,))
                out.append((key[0], getattr(row, order), now, hit))
            yield pd.DataFrame(out, columns=["key", order, value, "cached"])

        def close(self) -> None:
            pass

    return Entries()


def cached(asked: DataFrame, key: str, value: str, order: str, seconds: int) -> DataFrame:
    """(key, order, value, cached) for each row of a stream: the value held for its key, or its own, which is then held for `seconds`.

    value is what an answer would be if it were made anew (a string); a hit gives the one that is held. State is in RocksDB: the session's
    provider is set here, since expiry needs it. Null keys are a key. A stream that should end by itself (availableNow) needs
    spark.sql.streaming.noDataMicroBatches.enabled off: expiry asks for one more batch for ever.
    """
    spark = asked.sparkSession
    shipped(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = asked.select(asked[key].alias("key"), asked[order], asked[value].cast("string").alias(value))
    schema = StructType([rows.schema["key"], rows.schema[order], rows.schema[value]]).add("cached", "boolean")
    return rows.groupBy("key").transformWithStateInPandas(_entries(seconds, value, order), schema, "Append", "ProcessingTime")
